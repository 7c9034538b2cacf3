from .pool_store import PoolStore, table_version
from .readers import read_json, read_json_or_reject, read_parquet, read_profiles, read_reviews
from .sinks import (
    preview, rewrite_json, sample_dump, write_if_absent, write_results, write_text,
)
from .shared import materialize, shared_path, temporary_tables
