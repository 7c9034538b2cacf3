"""Headline queries over clean tables at one scale; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import fixtures as fx  # noqa: E402
from placerank import sources  # noqa: E402
from placerank.operators import locality, preference  # noqa: E402
from placerank.plans import clean_business, recommend_batch  # noqa: E402


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="placerank-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    raw = sources.materialize(fx.business_raw(spark, sf), "raw")
    reviews = sources.materialize(fx.review(spark, sf), "review")
    queries = sources.materialize(fx.queries(spark, sf), "asked")
    business = sources.materialize(clean_business(raw), "business")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    jobs = {
        "clean_business": lambda: run(clean_business(raw)),
        "latest_stars": lambda: run(preference.latest_stars(reviews)),
        "radial_join": lambda: run(locality.radial_join(queries, business)),
        "recommend_batch": lambda: run(recommend_batch(queries, business, reviews)[0]),
    }
    times = {}
    for name, job in jobs.items():
        start = time.time()
        job()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
