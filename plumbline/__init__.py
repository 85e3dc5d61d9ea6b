"""Trust checks for a registry of metrics, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
