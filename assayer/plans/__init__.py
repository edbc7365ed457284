"""Named queries over the given tables, each next to its SQL twin."""

from assayer.plans.registry import ORACLES, QUERIES  # noqa: F401
from assayer.plans import q_sources, q_audit, q_text, q_flow, q_training, q_policy, q_patterns  # noqa: F401,E402
