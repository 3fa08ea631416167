"""Default thresholds. Every operator takes them as parameters; nothing is read from the environment."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # catalogue pages
    page_size: int = 50
    files_per_result: int = 10
    sample_peers: int = 50
    sample_size: int = 100
    # ingest
    max_record_bytes: int = 10 * 1024 * 1024
    batch_rows: int = 500
    flush_seconds: int = 60
    ids_per_response: int = 100
    nodes_per_response: int = 256
    # streams: seconds of event time after which an idle key is forgotten
    forget_seconds: int = 30 * 86_400
    # content filter
    keyword_threshold: int = 8
    regex_threshold: int = 9
    heuristic_threshold: int = 5
    default_weight: int = 5
    # key space
    distant_first_byte: int = 128
    distant_fresh_seconds: int = 60
    close_fresh_seconds: int = 300
    sample_interval: int = 60
    empty_sample_penalty: int = 300
    max_failures: int = 3
    bucket_capacity: int = 100
    min_evict_age: int = 60
    cooldown_seconds: int = 3
    submit_percent: int = 17
    # peers
    peers_per_key: int = 50
    ready_peers: int = 10
    max_attempts: int = 3
    retry_tick: int = 100
    request_seconds: int = 8
    # monitoring
    ema_alpha: float = 0.3
    critical_nodes: int = 10
    warning_nodes: int = 50
    action_gap_seconds: int = 600


DEFAULTS = Settings()
