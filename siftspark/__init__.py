"""siftspark: hybrid retrieval and content analytics over personal collections, on Spark."""

from siftspark.session import get_spark

__all__ = ["get_spark"]
