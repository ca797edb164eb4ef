"""Measurement identification and regression analytics on Spark."""

from .params import Params
from .session import tune

__all__ = ["Params", "tune"]
