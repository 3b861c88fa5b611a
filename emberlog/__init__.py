"""Security-log analytics as DataFrame operators on Apache Spark."""

__version__ = "0.1.0"
