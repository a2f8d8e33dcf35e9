"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Every query runs $BENCH_RUNS times (default 3) in one warm session and writes
all its columns to the noop sink; the median counts.
"""

import json
import os
import statistics
import time

import checks.all_checks  # noqa: F401
from checks import fixture as X
from checks.local import session
from checks.registry import QUERIES
from nearshelf.operators.search import cosine_topk

HEADLINE = [
    "free_text_capped", "similar_items", "recommend_by_item", "weighted_vector_topk", "resolve_names",
    "resolve_names_exact", "ingest_records", "product_fields", "query_variants", "brand_rule",
    "autocomplete", "feedback_filter", "pair_prompts", "upsert_latest", "ingest_vectors", "recommend_from_prompt",
]


def nearest_480(spark, sf_dir):
    requests = X.requests(spark, sf_dir).drop("price_min", "price_max")
    return cosine_topk(requests, X.spread(X.catalog(spark, sf_dir), "item_no"), 480, dim=X.DIM)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session()
    queries = {"nearest_480": nearest_480, **{name: QUERIES[name] for name in HEADLINE}}
    X.catalog(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, run in queries.items():
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": os.environ.get("BENCH_CPUS", "8"), "runs": runs,
    }))


if __name__ == "__main__":
    main()
