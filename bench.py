"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced end to end with the ``noop`` sink (full computation, no
driver collect) and run twice: ``queries_cold`` is the first run (includes
code generation and compilation of the query's expressions), ``queries`` the
faster of the two runs (steady state, as on a long job where compilation is
amortised).  ``value`` is the sum of the steady-state times.  Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexivec.plans.catalog import queries  # noqa: E402
from lexivec.session import build_session  # noqa: E402

HEADLINE = [
    "lex_block_uni", "neg_mark", "lex_block_bi", "lex_block_pair", "syntax_features", "word_ngrams",
    "vocab", "word_index", "pad_sequences", "cosine_knn", "closest_class_score", "retrofit_class",
    "retrofit_graph", "ir_summary", "classification_report", "stream_label",
    "retrofit_repel", "retrofit_spill", "train_word2vec", "word_ngram_features", "trec_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    t0 = time.time()
    spark = build_session(f"local[{cpus}]", app="lexivec-bench", shuffle_partitions=int(cpus))
    startup = time.time() - t0
    qs = queries()
    # JVM/JIT warm-up on the smallest scale (untimed, reported separately).
    t = time.time()
    qs["lex_block_uni"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    warmup = time.time() - t
    times, cold = {}, {}
    for name in HEADLINE:
        if name not in qs:
            continue
        runs = []
        for _ in range(2):
            t = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        cold[name] = round(runs[0], 3)
        times[name] = round(min(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold_total": round(sum(cold.values()), 3), "queries_cold": cold, "sf": sf, "cpus": int(cpus), "session_startup_sec": round(startup, 3),
                      "warmup_sec": round(warmup, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
