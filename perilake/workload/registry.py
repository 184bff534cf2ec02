"""All registered queries."""

from perilake.workload import corpus, gold, ingest, risk, rules  # noqa: F401
from perilake.workload.base import REGISTRY

__all__ = ["REGISTRY"]
