"""Crowd-label consensus on Spark: votes in, calibrated subject scores out."""
from .params import Params

__all__ = ["Params"]
