"""Column expressions over text: tokens, patch keys, null handling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A token is a maximal run of letters, digits and underscores, taken
# after lower-casing; the patch key starts at the first occurrence of this marker.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
PATCH_MARKER = "+++ b"
MAX_TOKENS = 512


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(c: str | Column) -> Column:
    """Lower-cased word tokens of a text column as ``array<string>``."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), 0)


def null_to_empty(c: str | Column) -> Column:
    """Null text becomes the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def fill_text(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """``null_to_empty`` over several columns, keeping their names."""
    return df.na.fill("", subset=list(cols))


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Fail before any action if a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def patch_key(c: str | Column) -> Column:
    """Text from the first patch marker on, newlines removed; '' without marker."""
    text = null_to_empty(c)
    pos = F.instr(text, PATCH_MARKER)
    tail = F.substr(text, pos)
    return F.when(pos == 0, F.lit("")).otherwise(F.replace(tail, F.lit("\n"), F.lit("")))


def same_patch_key(a: str | Column, b: str | Column) -> Column:
    """Candidate and query carry the same non-empty patch key."""
    ka, kb = patch_key(a), patch_key(b)
    return (ka == kb) & (kb != F.lit(""))


def truncate_tokens(tokens: str | Column, n: int = MAX_TOKENS) -> Column:
    """Keep at most ``n`` leading tokens of an array column."""
    return F.slice(_col(tokens), 1, n)


def patch_key_hashes(c: str | Column) -> tuple[Column, Column, Column]:
    """Identity of a patch key as two 64-bit hashes plus a non-empty flag.

    Used to compare keys where the texts themselves are not at hand (inside the
    similarity blocks); two keys are taken as equal when both hashes agree.
    """
    k = patch_key(c)
    return (F.xxhash64(k).alias("pk1"), F.xxhash64(F.concat(k, F.lit("#"))).alias("pk2"),
            (k != F.lit("")).alias("pk_set"))
