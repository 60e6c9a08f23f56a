"""Job parameters."""

from dataclasses import dataclass

MIB = 1024 * 1024


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    retrieval_candidates: int = 50
    rerank_top_k: int = 5
    search_k: int = 4
    question_min_chars: int = 3
    question_max_chars: int = 2000
    question_rate_limit: int = 10
    chat_rate_limit: int = 20
    rate_window_seconds: int = 60
    max_file_bytes: int = 10 * MIB
    max_upload_bytes: int = 50 * MIB
    max_files_per_upload: int = 10
    max_json_bytes: int = 10 * MIB
    sql_max_chars: int = 20000
    sql_max_rows: int = 200
    sql_timeout_ms: int = 5000
    history_messages: int = 4
    source_snippet_chars: int = 200
    chip_chars: int = 100
    recent_log_lines: int = 200


DEFAULTS = Settings()
