"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query runs to completion through the no-op sink (nothing is
collected to the driver): one untimed warm run, then $BENCH_REPS timed runs
(default 3); the value is the sum of the per-query medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notewise.plans import catalog  # noqa: E402
from notewise.plans.flagship import step_rouge_l  # noqa: E402
from notewise.session import local_session  # noqa: E402

HEADLINE = [
    "corpus_rouge", "rouge2", "rouge_lsum", "corpus_rouge_bootstrap", "generate_flow", "step_history",
    "length_report", "supervision_audit", "within_token_budget", "clean_text", "null_patterns",
    "read_records", "export_sft_dataset", "compare_steps", "parse_diagnosis_list",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="notewise-bench")
    # warm-up: JVM, Python workers, parquet footers
    run(step_rouge_l(spark, sf_dir))
    times: dict[str, float] = {}
    jobs = {"step_rouge_l": lambda: step_rouge_l(spark, sf_dir)}
    jobs.update({n: (lambda n=n: catalog.QUERIES[n](spark, sf_dir)) for n in HEADLINE})
    for name, make in jobs.items():
        run(make())          # one untimed warm run per query (JIT, Python workers)
        samples = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(make())
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    from notewise.sources import testdata as td
    n_docs = td.table(spark, sf_dir, "documents").count()
    n_pairs = td.scored_answers(spark, sf_dir).count()
    n_records = td.records(spark, sf_dir).count()
    throughput = {
        "clean_text_docs_per_sec": round(n_docs / times["clean_text"], 1),
        "corpus_rouge_pairs_per_sec": round(n_pairs / times["corpus_rouge"], 1),
        "generate_flow_record_steps_per_sec": round(5 * n_records / times["generate_flow"], 1),
        "supervision_audit_docs_per_sec": round(n_docs / times["supervision_audit"], 1),
    }
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "throughput": throughput, "sf": sf,
                      "cpus": cpus, "reps": reps}))


if __name__ == "__main__":
    main()
