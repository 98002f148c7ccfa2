"""All queries of the library outside the optional subpackage, with their SQL."""

from tesserae.plans import extra_plans, graph_plans, inventory_plans, measure_plans, relational_plans, save_plans, store_plans, streaming_plans  # noqa: F401
from tesserae.plans.registry import ORACLES, QUERIES  # noqa: F401
