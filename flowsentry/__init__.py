"""Network-traffic analytics and intrusion detection on Spark DataFrames."""

from .params import CustomRule, Thresholds

__all__ = ["CustomRule", "Thresholds"]
