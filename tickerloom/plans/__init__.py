"""Job plans over whole tables: test-data views, registered queries and their SQL checks."""

from importlib import import_module

MODULES = ["source_queries", "discovery_queries", "record_queries", "forecast_queries", "publish_queries", "document_queries", "stream_queries", "landed_queries"]


def load_all() -> None:
    """Import every query module so that its plans are registered."""
    for name in MODULES:
        import_module(f"tickerloom.plans.{name}")
