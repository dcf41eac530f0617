"""Every registered query; importing the modules fills the registry."""

from ..registry import ORACLES, QUERIES
from . import audit, experiments, models, signals, sources_scalars

__all__ = ["ORACLES", "QUERIES", "audit", "experiments", "models", "signals", "sources_scalars"]
