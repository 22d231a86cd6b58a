"""tickerloom: IPO research and forecast-evaluation jobs as Spark DataFrame functions."""

__version__ = "0.1.0"
