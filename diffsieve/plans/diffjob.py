"""Before/after text -> structure sequences -> rendered edit script (Q5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffsieve.functions.structure import structure_seq
from diffsieve.operators.edits import edit_quarantine, edit_script, render_edit_script
from diffsieve.session import materialize


def diff_versions(pairs: DataFrame, old_code: str = "neg_code", new_code: str = "pos_code",
                  key: str = "pair_id", dialect="html", keep=None, max_edits: int | None = None,
                  quarantine: bool = False):
    """All columns of ``pairs`` but the two code columns, plus ``ast_seq`` (Q5).

    The structure sequences are computed by Spark expressions (or the user dialect in
    Arrow batches), the script by the edits kernel, the text by a grouped aggregate.
    Rows that share a key must be the same pair: each key is diffed once and its text joined
    to all its rows. Pairs over ``max_edits`` get no text: they are left out, and with
    ``quarantine`` returned as a second table, with a ``reason``.
    """
    seqs = (pairs.dropDuplicates([key])
            .select(F.col(key), structure_seq(old_code, dialect, keep).alias("old_seq"),
                    structure_seq(new_code, dialect, keep).alias("new_seq")))
    edits = edit_script(seqs, key=key, max_edits=max_edits)
    rest = pairs.drop(old_code, new_code)
    if max_edits is None:
        text = render_edit_script(edits, seqs, key=key)
        good = rest.join(text.withColumnRenamed("pair_id", key), key)
        return (good, rest.limit(0).withColumn("reason", F.lit(""))) if quarantine else good
    edits = materialize(edits, "edits")
    scripts, bad = edit_quarantine(edits)
    text = render_edit_script(scripts, seqs.join(bad.select(F.col("pair_id").alias(key)), key, "left_anti"), key=key)
    good = rest.join(text.withColumnRenamed("pair_id", key), key)
    return (good, rest.join(bad.withColumnRenamed("pair_id", key), key)) if quarantine else good
