"""Maps that grow with a stream."""

from .incremental import accumulate, compact, snapshot, windowed_counts

__all__ = ["accumulate", "compact", "snapshot", "windowed_counts"]
