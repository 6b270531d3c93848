"""Catalogue curation on Spark: functions from DataFrames to DataFrames."""

from tidyshelf.session import build_session, pin, shared_path

__all__ = ["build_session", "pin", "shared_path"]
