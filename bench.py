"""Bench: run the headline catalog queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line.

Each query is executed in full with the ``noop`` sink (every row and column
is produced, nothing is collected to the driver). ``--all`` times every
catalog key instead of the headline set. Indexes that searches reuse are built
first and timed on their own (``build_vector_index``, ``build_document_index``), so
a search's time is the search alone.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from qanat.session import build_session  # noqa: E402

HEADLINE = [
    "hash_embed", "cosine_topk", "topk_with_metadata", "ann_topk", "batch_ask", "build_index",
    "upsert_embeddings", "migrate_backup", "fold_favorite_events", "dense_ids", "stride_sample",
    "shard_health", "recent_n_per_key", "flatten_nested", "chunk_text", "stream_ask_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys_arg = [a for a in sys.argv[1:] if not a.startswith("--")]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="qanat-bench")
    from qanat.plans import q_ask, q_vectors
    from qanat.plans.catalog import QUERIES
    from qanat.sources.tables import table

    prepare = {"build_vector_index": q_vectors.vector_index, "build_document_index": q_ask.doc_index}
    keys = list(QUERIES) if "--all" in sys.argv else (keys_arg or HEADLINE)
    spark.range(1000).selectExpr("sum(id)").collect()
    # warm-up (not timed): JVM JIT and Python workers, by running every timed
    # query once on the smallest scale. Nothing carries over to the timed
    # runs: written artifacts (fixtures, indexes) are keyed by input path.
    warm_sf = os.environ.get("BENCH_WARMUP_SF_DIR", "/root/testdata/sf0.001")
    if "--no-warmup" not in sys.argv and warm_sf.rstrip("/") != sf_dir:
        for fn in prepare.values():
            fn(spark, warm_sf)
        for k in keys:
            try:
                QUERIES[k](spark, warm_sf).write.format("noop").mode("overwrite").save()
            except Exception:  # noqa: BLE001 -- the timed run reports failures
                pass

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for k, fn in prepare.items() if not keys_arg else ():
        t0 = time.perf_counter()
        fn(spark, sf_dir)
        times[k] = round(time.perf_counter() - t0, 3)
        print(f"# {k}: {times[k]}", file=sys.stderr, flush=True)
    for k in keys:
        t0 = time.perf_counter()
        try:
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[k] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[k] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"# {k}: {times.get(k, 'FAILED')}", file=sys.stderr, flush=True)

    n_docs = table(spark, sf_dir, "documents").count()
    n_vec = table(spark, sf_dir, "embeddings").count()
    n_q = table(spark, sf_dir, "conversations").where("role = 'user'").count()
    derived = {}
    if "hash_embed" in times:
        derived["hash_embed_docs_per_sec"] = round(n_docs / times["hash_embed"], 1)
    if "cosine_topk" in times:
        derived["cosine_topk_pairs_per_sec"] = round(n_vec * n_vec / times["cosine_topk"], 1)
        derived["cosine_topk_ms_per_query"] = round(1000 * times["cosine_topk"] / n_vec, 3)
    if "ann_topk" in times:
        derived["ann_topk_ms_per_query"] = round(1000 * times["ann_topk"] / n_vec, 3)
    if "batch_ask" in times:
        derived["batch_ask_questions_per_sec"] = round(n_q / times["batch_ask"], 1)
    if "upsert_embeddings" in times:
        derived["upsert_embeddings_rows_per_sec"] = round(n_vec / times["upsert_embeddings"], 1)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": cpus,
        "derived": derived,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
