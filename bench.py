"""Time the headline queries; print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = [
    "document_cues", "tokens", "detect", "fuzzy_matches", "censor", "profanity_summary", "mute_windows", "muted_time", "active_cue", "mute_state",
    "asof_position", "renumber", "substitute_silly", "merge_cues", "next_cues", "redetect", "ingest_cues", "url_predicates", "dedupe_tracks", "page_links",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from hushline.plans import catalog

    # start the engine and the code paths all queries share
    catalog.CASES["document_cues"][0](spark, sf_dir).limit(10).collect()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(QUERIES)).split(","):
        start = time.time()
        catalog.CASES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
