"""Document fingerprints by SimHash, in DataFrame operations only (operator 9).

A text's terms are its distinct words (runs without ASCII white space); a term weighs its length in characters,
so rare long words outvote common short ones. Each bit of a term's 64-bit hash votes with that
weight, for 1 or against; the fingerprint has the signs. Two bits share a 64-bit sum (32 bits each: a
text's words weigh less than 2**31 together), so 32 sums in one aggregation make a fingerprint.

``successors`` gives each row the next row by ascending id without a global sort in one task: ids are
cut into buckets at approximate quantiles, and the first row of each bucket also goes, as a
ghost, to the bucket before. ``near_pairs`` finds all fingerprints within a Hamming radius by
permuted block tables: with ``radius + 2`` blocks, two such fingerprints agree in two blocks at
least, so every pair of blocks is a table keyed by their bits.

Defined results: null text is empty; a text without words has fingerprint 0; equal texts have
equal fingerprints; the row after the last is the first; a single row follows itself;
rows with one id follow in the order of their texts' hashes; null ids come first; texts are read whole.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import read

BITS = 64
BUCKET_ROWS, MOST_BUCKETS = 500, 20_000
_PAIR = 0x0000000100000001
_SPLIT = r"[\x20\x09-\x0D]+"


def fingerprints(terms: DataFrame, keys: list[str], term: str = "term", into: str = "fp") -> DataFrame:
    """One row per ``keys`` with the fingerprint of its terms (null terms don't count)."""
    weight = F.coalesce(F.char_length(term), F.lit(0)).cast("long")
    hashed = terms.select(*keys, F.xxhash64(term).alias("h"), weight.alias("w"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_PAIR)) * F.col("w")).alias(f"v{j}") for j in range(BITS // 2)]
    voted = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)
    bit = lambda votes, k: F.when(2 * votes > F.col("w"), F.lit((1 << k) - (1 << 64) * (k == 63))).otherwise(F.lit(0))
    fp = F.lit(0).cast("long")
    for j in range(BITS // 2):
        fp = fp.bitwiseOR(bit(F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), j).cast("long"))
        fp = fp.bitwiseOR(bit(F.shiftrightunsigned(f"v{j}", 32), j + 32).cast("long"))
    return voted.select(*keys, fp.alias(into))


def terms_of(text: Column) -> Column:
    """Distinct words of a text; '' may be among them and weighs nothing."""
    return F.array_distinct(F.split(text, _SPLIT))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine that the share of differing bits stands for, not below 0."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (3.141592653589793 / BITS)))


def _bucket(id_col: str, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie below the id: a binary search in the row."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds)
    step = 1
    while step * 2 <= len(bounds):
        step *= 2
    steps = F.lit([step >> k for k in range(step.bit_length())])
    probe = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < F.col(id_col)), at + s).otherwise(at)
    return F.coalesce(F.aggregate(steps, F.lit(0), probe), F.lit(0))


def successors(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(bucket, place, ghost, id, text, next_text): rows in order of (id, hash of the text).

    ``place`` numbers a bucket's rows. Ghosts repeat the first row of the following bucket.
    ids: a numeric column.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = rows.count()
    count = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = [k / count for k in range(1, count)]
    got = rows.agg(F.percentile_approx("id", F.lit(cuts), max(10_000, 5 * count))).first()[0] if cuts else None
    bounds = sorted(set(got or []))
    placed = rows.withColumn("h", F.xxhash64("text")).withColumn("bucket", _bucket("id", bounds))
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("first")).orderBy("bucket").collect()  # at most MOST_BUCKETS rows
    found = [(r["bucket"], r["first"]["id"], r["first"]["h"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    first = spark.createDataFrame(found, "of int, first_id long, first_h long, before int")
    both = placed.join(F.broadcast(first), placed["bucket"] == first["of"])
    is_first = F.col("id").eqNullSafe(F.col("first_id").cast(dict(rows.dtypes)["id"])) & (F.col("h") == F.col("first_h"))
    own = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("ghost"))
    dealt = both.select("id", "text", "h", F.explode(F.when(is_first, F.array(own, F.struct(F.col("before").alias("to"), F.lit(1).alias("ghost")))).otherwise(F.array(own))).alias("at"))
    order = Window.partitionBy("bucket").orderBy("ghost", "id", "h")
    return dealt.select("id", "text", "h", F.col("at.to").alias("bucket"), F.col("at.ghost").alias("ghost")).select(
        "bucket", F.row_number().over(order).alias("place"), "ghost", "id", "text", F.lead("text").over(order).alias("next_text"))


def edited(docs: DataFrame) -> DataFrame:
    """``successors`` rows with n_chars and the edited text: the last quarter of the characters
    gives way to as many first characters of the next row's text."""
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), quarter))).drop("next_text")


def near_pairs(fps: DataFrame, radius: int = 3, fp: str = "fp") -> DataFrame:
    """(a, b, distance): all pairs a < b of different fingerprints within ``radius`` bits."""
    blocks = radius + 2
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    part = lambda k: F.shiftrightunsigned(F.col("fp"), edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    keys = [F.struct(F.lit(t).alias("table"), part(i).alias("x"), part(j).alias("y")) for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    tables = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct().select("fp", F.explode(F.array(*keys)).alias("key"))
    a, b = tables.select(F.col("fp").alias("a"), "key.*"), tables.select(F.col("fp").alias("b"), "key.*")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = a.join(b, ["table", "x", "y"]).where((F.col("a") < F.col("b")) & (distance <= radius))
    return near.select("a", "b", distance.alias("distance")).distinct()


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(successors(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
    keys = ["bucket", "place", "ghost", "id", "n_chars", "sha"]
    both = F.array(F.struct(F.lit(0).alias("which"), terms_of(F.col("text")).alias("terms")), F.struct(F.lit(1).alias("which"), terms_of(F.col("edited")).alias("terms")))
    split = rows.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, F.explode(both).alias("x"))
    terms = split.select(*keys, "x.which", F.explode("x.terms").alias("term"))
    fps = fingerprints(terms, [*keys, "which"])
    one = fps.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    order = Window.partitionBy("bucket").orderBy("place")
    with_next = one.withColumn("next_fp", F.lead("fp").over(order)).where("ghost = 0")
    return with_next.select(F.col("id").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
                            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
