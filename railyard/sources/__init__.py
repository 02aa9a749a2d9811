"""Sources and sinks."""

from railyard.sources.readers import (
    scan_ctrl_a_kv,
    scan_delimited,
    scan_json_lines,
    scan_properties,
    scan_segments,
)
from railyard.sources.sinks import read_hashed_layout, write_hashed_layout, write_sorted_blocks

__all__ = ["scan_ctrl_a_kv", "scan_delimited", "scan_json_lines", "scan_properties",
           "scan_segments", "read_hashed_layout", "write_hashed_layout", "write_sorted_blocks"]
