"""termloom: knowledge-graph, market and corpus analytics on PySpark."""

__version__ = "0.1.0"
