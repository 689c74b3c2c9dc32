"""The registered queries, in the order of the operator inventory."""

from skytable.plans import (  # noqa: F401
    blob_queries,
    capture_queries,
    fits_queries,
    frame_queries,
    input_queries,
    match_queries,
    object_queries,
    pixel_queries,
    sky_queries,
    spike_queries,
    stream_queries,
)
from skytable.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
