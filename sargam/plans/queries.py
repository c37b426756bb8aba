"""All core queries by name."""

from . import catalog_queries, listening_queries, merge_queries, state_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
