from tapewire.sources.readers import (
    decode_articles,
    malformed,
    read_archive,
    read_category_commands,
    read_category_json,
    read_keywords,
    read_metric_events,
    read_raw_articles,
    read_scored,
    stream_articles,
    where_requested,
)
from tapewire.sources.sinks import (
    append_archive,
    append_audit,
    checkpoint_id,
    compact,
    ensure_table,
    export_keywords,
    look_up,
    publish,
    read_upserted,
    run_number,
    sentiment_audit,
    to_messages,
    upsert,
    work_dir,
)

__all__ = [name for name in dir() if not name.startswith("_")]
