"""Analysis of execution traces of parallel programs as Spark DataFrames."""

from .functions.options import get_option, reset_option, set_option
from .trace import Trace

__all__ = ["Trace", "get_option", "reset_option", "set_option"]
