"""Structured Streaming form of the daily metrics (the reference itself has no streaming code)."""

from postlab.streaming.daily import daily_metrics_stream, start_daily_metrics  # noqa: F401
