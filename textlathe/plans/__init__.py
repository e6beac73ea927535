"""The registered queries of the library, and their SQL."""

from . import corpus, graphs, segments
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "graphs", "segments"]
