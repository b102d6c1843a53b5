"""playgraph: a Spark-first engine that turns ordered activity logs into a multi-relational entity graph."""

__version__ = "0.1.0"
