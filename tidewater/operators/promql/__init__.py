"""PromQL as DataFrame plans."""

from tidewater.operators.promql.evaluator import PromQL
from tidewater.operators.promql.parser import PromQLError, parse

__all__ = ["PromQL", "PromQLError", "parse"]
