"""All registered queries of the package's own operators."""

from . import document_queries, geometry_queries, ocr_queries, raster_queries, stream_queries, svg_queries  # noqa: F401  registers them
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
