"""quire: page order recovery, scoring and learning for whole libraries, on Spark."""

__version__ = "0.1.0"
