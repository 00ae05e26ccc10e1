from . import evaluation, learning_q, parsing_q, relational, scoring, trial_q  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
