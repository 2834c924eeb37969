"""Message-stream analytics on Spark: every operator is a function from DataFrame to DataFrame."""

from .functions import exists_key, label_text, micros, num, parse_duration, path
from .operators.aggregate import (
    cache_snapshot,
    cardinality,
    cardinality_at,
    count_at,
    dedupe,
    histogram_at,
    histogram_changes,
    kl_divergence,
    kl_divergence_arrays,
    last_message,
    last_message_at,
    last_n,
    message_rate_at,
    moving_average_at,
    rolling_average,
    rolling_count,
    timeseries_at,
)
from .operators.joins import (
    cache_lookup,
    cache_lookup_keys,
    drop_members,
    is_member,
    keep_members,
    merge,
    with_rules,
    zip_join,
)
from .operators.models import gradient, learn, learn_at, learn_linear, linear_model, logistic_model, moments
from .operators.packs import (
    pack_by_count,
    pack_by_interval,
    pack_by_value,
    session_summary,
    sessions,
)
from .operators.project import (
    dft_by_key,
    fft,
    filter_messages,
    map_messages,
    mask,
    render_mail,
    script,
    to_messages,
    unpack,
)
from .operators.samplers import (
    with_categorical,
    with_exponential,
    with_gaussian,
    with_poisson,
    with_zipf,
)
from .operators.sequence import every_nth, fire_at_ticks, queue_peek, queue_pops, sync, toggle
from .sinks.writers import batch_payloads, bulk_docs, publish, show_messages, write_messages
from .sources.messages import (
    csv_records,
    decode_messages,
    parse_csv,
    parse_xml,
    read_messages,
    split_frames,
)
from .sources.responses import enrich_by_url
from .sources.ticks import bang, tick_grid, tick_stream, ticks_over

__all__ = [name for name in dir() if not name.startswith("_")]
