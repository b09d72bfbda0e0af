"""All registered queries: importing the modules fills the registry."""

from __future__ import annotations

from . import q_evaluate, q_models, q_neural, q_prepare, q_profile, q_select  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
