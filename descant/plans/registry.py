"""All queries of the library; importing the plan modules fills the register."""

from . import contents, library, lyrics, records, state, stored, words  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
