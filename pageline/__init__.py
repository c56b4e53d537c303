"""pageline: a Spark-native engine that turns positioned text into validated, queryable articles."""

__version__ = "0.1.0"
