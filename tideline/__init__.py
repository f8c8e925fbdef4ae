"""tideline: point-in-time market research operators as Spark jobs."""

__version__ = "0.1.0"
