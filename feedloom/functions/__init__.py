from feedloom.functions.predicates import (
    any_pattern,
    has_required_keys,
    hashtag_cs,
    keyword_ci,
    non_blank,
    not_blocked,
)
from feedloom.functions.text import (
    clean_handle,
    clean_target,
    file_target,
    parse_time,
    preview_text,
    strip_ws,
)
from feedloom.functions.urls import host_of, target_urls

__all__ = [
    "any_pattern",
    "clean_handle",
    "clean_target",
    "file_target",
    "has_required_keys",
    "hashtag_cs",
    "host_of",
    "keyword_ci",
    "non_blank",
    "not_blocked",
    "parse_time",
    "preview_text",
    "strip_ws",
    "target_urls",
]
