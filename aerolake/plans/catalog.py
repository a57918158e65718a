"""All registered queries: importing the modules fills the registry."""

from aerolake.plans import queries_align  # noqa: F401
from aerolake.plans import queries_chunks  # noqa: F401
from aerolake.plans import queries_eval  # noqa: F401
from aerolake.plans import queries_graph  # noqa: F401
from aerolake.plans import queries_io  # noqa: F401
from aerolake.plans import queries_masks  # noqa: F401
from aerolake.plans import queries_sampling  # noqa: F401
from aerolake.plans import queries_partition  # noqa: F401
from aerolake.plans import queries_spatial  # noqa: F401
from aerolake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
