"""Sources and sinks of maps."""

from .maps import concatenate_files, format_of, read_coverage, read_map, write_map

__all__ = ["concatenate_files", "format_of", "read_coverage", "read_map", "write_map"]
