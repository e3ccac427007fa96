"""tessera — item analytics and recommendation as Spark jobs (see README.md)."""

__version__ = "0.1.0"
