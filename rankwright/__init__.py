"""Learning-to-rank over search sessions, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
