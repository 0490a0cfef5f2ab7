"""All registered queries (importing the modules fills the registry)."""

from obsfuse.plans import q_evidence, q_fusion, q_geometry, q_groups, q_models, q_scores  # noqa: F401
from obsfuse.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
