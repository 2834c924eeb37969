"""Structured Streaming forms of the operators."""

from .controls import (
    is_member_stream,
    pack_by_value_stream,
    pack_flush_stream,
    with_rules_stream,
    zip_clear_stream,
)
from .learning import learn_stream, read_params
from .panes import average_stream, histogram_stream, timeseries_stream
from .runs import run_available
from .stateful import (
    cache_lookup_stream,
    pack_by_count_stream,
    queue_stream,
    sync_stream,
    toggle_stream,
    zip_stream,
)
from .windows import (
    count_stream,
    dedupe_stream,
    pack_by_interval_stream,
    session_stream,
)

__all__ = [
    "average_stream", "cache_lookup_stream", "count_stream", "dedupe_stream", "histogram_stream", "is_member_stream",
    "learn_stream", "pack_by_count_stream", "pack_by_interval_stream", "pack_by_value_stream", "pack_flush_stream",
    "queue_stream", "read_params", "run_available", "session_stream", "sync_stream", "timeseries_stream", "toggle_stream",
    "with_rules_stream", "zip_clear_stream", "zip_stream",
]
