"""aerolake: aerial-mapping analytics (poses, pixels, point clouds, view graphs, chunks, rasters) on Spark."""

from aerolake.session import get_session, materialize

__all__ = ["get_session", "materialize"]
