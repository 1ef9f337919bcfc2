"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query's whole plan is executed through the ``noop`` sink (no rows travel to the
driver) after one untimed warm-up (the flagship on sf0.001) has started the JVM code
paths and the Python workers. Every query runs ``$BENCH_REPEATS`` times (default 3) and
its median wall time is reported. Prints one JSON line; ``value`` is the sum of the
per-query medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from diffsieve.plans import catalog  # noqa: E402
from diffsieve.session import get_session  # noqa: E402

HEADLINE = [
    "retrieve_hybrid",     # flagship: BM25 + cosine + fuse + top-2 + exclusion + payload
    "bm25_topk",           # lexical retrieval of benchmark items over all documents
    "cosine_topk",         # block cosine top-2
    "augment",             # whole query table pass with vector-text parsing
    "edit_script",         # edit scripts of consecutive page pairs
    "diff_versions",       # text -> sequences -> rendered script
    "hash_features",       # hashed token vectors of all documents
    "term_stats",          # index statistics
    "split_exact",         # exact seeded split
    "pair_versions",       # version pairing
    "profile_similarity",  # batch profile similarity
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g",
                               "spark.local.dir": tempfile.mkdtemp(prefix="bench-")})
    # warm-up: the flagship on the smallest tables starts the JVM code paths and the
    # Python workers once; it is not timed
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm):
        warm = sf_dir
    catalog.QUERIES["retrieve_hybrid"](spark, warm).write.format("noop").mode("overwrite").save()
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "3")))
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "repeats": repeats}))


if __name__ == "__main__":
    main()
