"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from crowdtide.plans import registry
from crowdtide.scratch import clear
from crowdtide.session import build_session

HEADLINE = (
    "daily_sentiment",
    "join_stats",
    "fill_calendar",
    "column_stats",
    "post_score",
    "total_dataset",
    "train_dataset",
    "shorten_long_texts",
    "tfidf",
    "char_ngrams",
    "build_vocab",
    "vectorize_text",
    "naive_bayes_multinomial",
    "naive_bayes_gaussian",
    "stratified_kfold",
    "random_forest",
    "write_edgelist_csv",
    "accumulate_weights",
    "email_edges",
    "degrees_all",
    "pagerank",
    "hits",
    "fit_power_law",
    "bootstrap_fit",
    "incremental_graph",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{folder}/region.parquet").count()  # start-up is not a query
    seconds = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    clear(spark)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
