"""Vector columns: text parsing, flattening, channel fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_vector_text(c, dim: int) -> tuple[Column, Column]:
    """Vector text -> ``(array<float>, error)`` (S3).

    Blanks and newlines are removed; text without a leading ``[`` is wrapped; a
    tuple of lists such as ``[0.1],[0.2]`` is wrapped as well; Python float forms
    ``1.``/``.5`` are normalised to JSON; a 2-D array is flattened. Null, blank,
    ``nan`` and ``None`` give a zero vector of width ``dim``. Any other text that does
    not parse gives a null vector and ``error = true`` (quarantine); the reference
    raises instead.
    """
    raw = _col(c)
    s = F.regexp_replace(raw, r"\s", "")
    empty = raw.isNull() | s.isin("", "nan", "None")
    s = F.when(~s.startswith("["), F.concat(F.lit("["), s, F.lit("]"))).otherwise(s)
    tuple_of_lists = s.startswith("[") & ~s.startswith("[[") & s.contains("],[")
    s = F.when(tuple_of_lists, F.concat(F.lit("["), s, F.lit("]"))).otherwise(s)
    s = F.regexp_replace(s, r"(^|[^0-9])\.([0-9])", "$10.$2")
    s = F.regexp_replace(s, r"([0-9])\.([^0-9]|$)", "$1.0$2")
    two_d = F.flatten(F.from_json(s, "array<array<float>>"))
    one_d = F.from_json(s, "array<float>")
    # the JSON reader stops at the first closing bracket and lets nulls pass: the text counts
    # only if it is numbers and separators throughout
    nested = s.startswith("[[")
    inner = F.when(nested, F.replace(F.regexp_extract(s, r"^\[\[([^\n]*)\]\]$", 1), F.lit("],["), F.lit(","))).otherwise(
        F.regexp_extract(s, r"^\[([^\n]*)\]$", 1))
    numbers = F.forall(F.split(inner, ","), lambda x: x.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"))
    parsed = F.when(numbers | s.isin("[]", "[[]]"), F.when(nested, two_d).otherwise(one_d))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    vec = F.when(empty, zero).otherwise(parsed)
    err = (~empty) & parsed.isNull()
    return vec, err


def flatten_vector(c) -> Column:
    """2-D vector (sequence of rows) -> 1-D."""
    return F.flatten(_col(c))


def check_width(df: DataFrame, c: str) -> int:
    """Width of a vector column; raise if the rows differ (the reference's stack fails)."""
    r = df.agg(F.min(F.size(c)).alias("lo"), F.max(F.size(c)).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"vector widths differ in {c}: {r['lo']}..{r['hi']}")
    return int(r["lo"] or 0)


def fuse_channels(a, b) -> Column:
    """Concatenate two channel vectors (F3). For sequences of vectors use
    ``fuse_channel_sequences``."""
    return F.concat(_col(a), _col(b))


def fuse_channel_sequences(a, b) -> Column:
    """Position by position concatenation of two sequences of vectors, both cut to the
    shorter length (F3, the reference's fusion of per-token outputs)."""
    n = F.least(F.size(_col(a)), F.size(_col(b)))
    z = F.arrays_zip(F.slice(_col(a), 1, n).alias("x"), F.slice(_col(b), 1, n).alias("y"))
    return F.transform(z, lambda e: F.concat(e["x"], e["y"]))
