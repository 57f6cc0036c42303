"""tablevec: tables to tokens, graphs and vectors, as Spark DataFrame jobs."""

from tablevec.session import get_spark, settle

__all__ = ["get_spark", "settle"]
