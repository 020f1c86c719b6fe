"""Queries over derived fixtures, one per operator."""

from figweave.plans import box_queries, mol_queries, more_queries, text_queries  # noqa: F401
from figweave.plans.registry import ORACLES, QUERIES  # noqa: F401
