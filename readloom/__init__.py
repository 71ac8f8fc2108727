"""readloom: alignment-file analytics and relational audit operators on Spark."""

__version__ = "0.1.0"
