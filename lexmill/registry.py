"""All named queries of the library: importing the catalogs fills the tables."""

from . import catalog_analogy, catalog_lexicon, catalog_more, catalog_quiz, catalog_rules  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
