"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line.  Each query writes its whole result to Spark's ``noop``
sink, so nothing is pruned away and nothing is collected.  A query runs once
untimed (class loading, code generation) and once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sealtrail.plans.queries import QUERIES
from sealtrail.session import local_session

HEADLINE = (
    "seal_turns",
    "seal_samples",
    "seal_exchanges",
    "ledger_root",
    "leaf_index",
    "ledger_append",
    "sync_ingest",
    "union_ledgers",
    "count_by_device",
    "recent_leaves",
    "verify_rows",
    "dangling_parents",
    "cosine_pairs",
    "minmax_scale",
    "peptide_stats",
    "confidence_mean",
    "residue_confidence",
    "text_chunks",
    "chat_history",
    "stream_sync",
)


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = timed(spark, name, sf_dir)
    spark.stop()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
