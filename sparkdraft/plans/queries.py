"""All registered queries."""

from sparkdraft.plans import (  # noqa: F401
    chat,
    corpus,
    dashboard,
    regeneration,
    scoring,
    shaping,
    stores,
    training,
    vocabulary,
)
from sparkdraft.plans.registry import QUERIES

__all__ = ["QUERIES"]
