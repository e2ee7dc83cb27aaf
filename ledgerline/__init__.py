"""Point-in-time company analytics on Spark DataFrames."""

from ledgerline.session import build_session

__all__ = ["build_session"]
