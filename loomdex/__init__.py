"""loomdex: a Spark-native crawl-to-search analytics engine."""

__version__ = "0.1.0"
