"""marketloom: collectible-market analytics as Spark DataFrame jobs."""

from marketloom.session import get_session, tune

__all__ = ["get_session", "tune"]
