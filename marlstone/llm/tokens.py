"""Token counts of public tokenizers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_tokens(text: Column) -> Column:
    """Tokens of the byte-level ByT5 tokenizer: one per UTF-8 byte and one end token; NULL text counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
