"""Operators: plain functions DataFrame -> DataFrame built on the DataFrame API."""
