"""Column functions: text comparison, metadata extraction, keyword scores, globs and counts of calls."""

from .globs import glob_regex, matches_any, matches_glob
from .text import call_count, compare, content_type, keyword_score, metadata_text, metadata_typed, number

__all__ = ["call_count", "compare", "content_type", "glob_regex", "keyword_score", "matches_any", "matches_glob", "metadata_text", "metadata_typed", "number"]
