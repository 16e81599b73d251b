"""Citation screening on Spark: from raw records to explained verdicts."""

from sieve.session import apply_defaults, get_session

__all__ = ["apply_defaults", "get_session"]
