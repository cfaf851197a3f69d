"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated, default: the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayfind.plans.catalogue import QUERIES  # noqa: E402
from wayfind.session import build_session  # noqa: E402

HEADLINE = (
    "keyword_topk", "document_scores", "token_frequency", "field_term_index", "best_snippets", "chunk_documents",
    "hash_embedding_cells", "edge_resolution", "dependency_hints", "edges_both_endpoints", "coverage_first_cap",
    "verify_symbol_lines", "code_blocks", "source_symbols", "symbol_hits", "primary_owner_scores",
    "file_contributions", "ranked_files", "pack_evidence", "vector_topk_dot", "weighted_rrf", "semantic_rerank",
    "rated_events", "risk_state", "quality_counts", "mode_stats", "usage_totals", "missed_file_resolution",
    "suffix_dedup", "orphan_files", "stale_packs", "upper_median_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    spark = build_session(
        "wayfind-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "16m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executors outside the clock
    seconds: dict[str, float] = {}
    for name in chosen:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
