"""All registered queries."""

from catalogue import classification, flows, latency, scoring, searching, serving, texts  # noqa: F401
from catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
