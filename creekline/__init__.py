"""Leakage-safe analytics for field-monitoring time series, on Spark DataFrames."""

from creekline.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
