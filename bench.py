"""Wall-clock seconds per registered query; prints one JSON line.

A given table is one small file, which one task would read. Before the clock
starts every table is copied as it would lie on a cluster: in several files,
so that the timed plans are those of large tables.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names, or ``all`` (default: the headline set)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from weftline.plans import registry
from weftline.session import build_session

HEADLINE = (
    "activity_totals", "posts_per_user", "top_channels", "user_activity_matrix", "keyword_mentions", "summary_feed", "snippets_every_user",
    "activity_report_lines", "chat_flatten", "news_inventory", "news_dedup", "news_balanced", "document_elements", "clean_text", "clean_changes",
    "log_blocks", "stack_traces", "fragment_merge", "patch_apply", "patch_audit", "reorder_texts", "chunk_pack", "chunk_pack_segmented", "glossary_match",
    "glossary_fill", "settle_attempts", "memory_lookup", "document_render", "concat_chunks", "resume_plan", "merged_states", "mask_secrets",
)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spread(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in ``files`` files each, in a new folder."""
    folder = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), os.path.basename(sf_dir.rstrip("/")))
    for name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows = df.count()
        df.repartition(files if rows >= 1000 else 1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    every = registry.queries()
    names = list(every) if wanted == "all" else (wanted.split(",") if wanted else list(HEADLINE))
    spark = build_session(
        "weftline-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    data = spread(spark, sf_dir, int(cpus))
    spark.read.parquet(f"{data}/documents.parquet").selectExpr("max(length(text))").collect()
    seconds: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        every[name](spark, data).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
