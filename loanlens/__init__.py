"""loanlens: loan-risk profiling, preparation, modelling and model comparison
on Spark DataFrames and Spark ML."""

from .config import RiskSchema, RunConfig

__all__ = ["RiskSchema", "RunConfig"]
