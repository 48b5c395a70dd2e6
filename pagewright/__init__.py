"""Page analytics on Spark: a crawl corpus is a DataFrame."""

__version__ = "0.1.0"
