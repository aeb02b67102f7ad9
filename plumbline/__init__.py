"""Measure what is true about a set of tables: profiles, joins, data problems, verdicts and what moved since."""

from plumbline.settings import Settings
from plumbline.sources.catalog import Catalog, Relation

__all__ = ["Catalog", "Relation", "Settings"]
