"""Named queries over the test tables, each with the SQL another engine must agree with."""

from sieve.queries import explanation, exchange, learning, relational, robust, sampling, text  # noqa: F401
from sieve.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
