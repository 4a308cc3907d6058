"""Headline queries over one data folder; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up, the median counts (default 3;
               a query that has taken 4 seconds is not repeated further)
BENCH_QUERIES  comma list of query names, or "all"
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pressgrid.plans.registry import all_queries  # noqa: E402
from pressgrid.session import local_session  # noqa: E402

HEADLINES = (
    "feed_entries discover_new_urls latest_wins_upsert article_main_text_articles page_image_url hash_embedding "
    "nearest_predecessor assign_stories story_rollup enrich_candidates compare_candidates diverse_sample "
    "overview_counts trend_series outlet_30d_stats stories_page story_detail positive_stories bias_distribution "
    "story_images home_sections framing_by_outlet outlet_emphasis source_totals quoted_sources entity_rollup "
    "fts_tokens search_ranked grounding_rate run_touched_articles constraint_violations stream_daily_counts stream_attempts"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINES
    spark = local_session(cores, app="bench")

    def once(name: str) -> float:
        start = time.perf_counter()
        # The noop sink computes every column of every row without bringing any to the driver.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in names:
        once(name)  # warm-up
        taken = [once(name)]
        while len(taken) < runs and sum(taken) < 4:
            taken.append(once(name))
        times[name] = round(statistics.median(taken), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cores, "runs": runs,
    }))


if __name__ == "__main__":
    main()
