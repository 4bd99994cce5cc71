"""Structured Streaming form of the load step (S1-S3 for arriving files)."""

from legation.streaming.incremental import incremental_load

__all__ = ["incremental_load"]
