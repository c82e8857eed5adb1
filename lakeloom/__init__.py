"""lakeloom: a DataFrame-first analytics engine on Apache Spark."""

from lakeloom.session import build_session

__all__ = ["build_session"]
