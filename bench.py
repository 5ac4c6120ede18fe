"""Wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and DuckDB's on the same SQL; one JSON line."""

from __future__ import annotations

import json
import os
import threading
import time
from pathlib import Path

from sketchloom.plans import proxies
from sketchloom.session import build_session

HEADLINE = ["flagship", "hash_sample_counts", "sample_hash_counts", "left_minus_rights", "venn_counts", "topn_sample_lists", "hashes_in_percentile", "hash_sample_lists_sharded", "histogram_counts", "index_probe", "kmer_sketch", "contig_annotation", "murmur_kmers"]


#: Seconds after which DuckDB's run of a query is broken off, so that the yardstick doesn't outlast what it measures.
PATIENCE = 30


def yardstick(folder: str, cpus: str) -> dict[str, float | None]:
    """DuckDB's seconds for the SQL of the queries that have it, on as many threads; None: more than PATIENCE."""
    try:
        import duckdb
    except ImportError:
        return {}
    c = duckdb.connect(config={"threads": int(cpus)} if cpus.isdigit() else {})
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    sql, times = proxies.oracle_sql(), {}
    for name in HEADLINE:
        if name not in sql:
            continue
        start, timer = time.perf_counter(), threading.Timer(PATIENCE, c.interrupt)
        timer.start()
        try:
            c.execute(f"CREATE OR REPLACE TEMP TABLE found AS {sql[name]}")
            times[name] = round(time.perf_counter() - start, 3)
        except duckdb.InterruptException:
            times[name] = None
        finally:
            timer.cancel()
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, driver_memory="8g", conf={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        proxies.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "duckdb": yardstick(folder, cpus), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
