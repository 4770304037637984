"""Scans (test tables, raw listing CSV), the ``sales`` role view, and sinks."""

from comparo.sources.tables import read_table, TABLES  # noqa: F401
from comparo.sources.sales import sales, SALES_SQL  # noqa: F401
