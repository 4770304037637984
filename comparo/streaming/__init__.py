"""Structured Streaming form of the scoring job.

The reference is batch-only (SURVEY §2.19); the one operator that naturally
runs on arriving data is pricing new listings from past sales, so that is the
only streaming job here.
"""

from comparo.streaming.scoring import score_stream  # noqa: F401
