"""Queries by name; importing this package registers all of them."""

from loomgraph.plans import answers, flows, retrieval  # noqa: F401
from loomgraph.plans.registry import QUERIES  # noqa: F401
