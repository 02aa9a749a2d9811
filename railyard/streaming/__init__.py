"""Structured Streaming forms of the keyed-state and live-signal rules."""

from railyard.streaming.runner import (
    files_of_a_slice,
    read_stream,
    rows_dropped,
    run_available,
    run_foreach_batch,
    share_of_files,
    stage_end,
    stage_files,
    with_end,
)
from railyard.streaming.stateful import (
    late_events,
    lifecycle_from_changes,
    registry_from_changes,
    stream_idle_verdicts,
    stream_lifecycle_state,
    stream_match_responses,
    stream_reassemble,
    stream_registry_state,
    stream_state_changes,
)
from railyard.streaming.windowed import (
    listener_sink,
    stream_first_answer,
    stream_idle_sessions,
    stream_report_once,
    stream_timed_join,
)

__all__ = [
    "files_of_a_slice", "read_stream", "rows_dropped", "run_available", "run_foreach_batch", "share_of_files",
    "stage_end", "stage_files", "with_end",
    "late_events", "lifecycle_from_changes", "registry_from_changes", "stream_idle_verdicts",
    "stream_lifecycle_state", "stream_match_responses", "stream_reassemble", "stream_registry_state",
    "stream_state_changes", "listener_sink", "stream_first_answer", "stream_idle_sessions", "stream_report_once",
    "stream_timed_join",
]
