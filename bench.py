"""Headline queries on the driver tables; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from skysonde.catalog import PERIODS, QUERIES, obs, stored_grid  # noqa: E402
from skysonde.plans import views  # noqa: E402

#: Views of thirty days, over the half-hour grid that is stored first.
VIEWS = (
    "v1_scatter_2d",
    "v2_scatter_3d",
    "v3_contour_2d",
    "v4_contour_3d",
    "v5_density",
    "v6_heatmap",
    "v7_temperature",
    "v8_wind_direction",
    "v9_temperature_profile",
    "v10_hodograph",
)
HEADLINE = (
    "a7_half_hour_grid",
    "a14_anchored_bins",
    "j1_nearest_time_position",
    "j5_altitude_cascade",
    "j6_register_pairs",
    "j9_cross_source_discrepancies",
    "a17_outlier_flags",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # One process, so its folder may be local; on a cluster the session names a shared one.
    with tempfile.TemporaryDirectory(prefix="skysonde-bench-") as shared:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .appName("skysonde-bench")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.driver.memory", "16g")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.dataFrameQueryContext.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.checkpoint.dir", shared)
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
        seconds = {}

        def timed(name, make):
            started = time.perf_counter()
            made = make()
            if made is not None:
                made.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)

        grids = {}
        timed("stored_half_hour_grid", lambda: grids.update(half_hour=stored_grid(spark, sf_dir, "half_hour")))
        request = views.Request(obs(spark, sf_dir), *PERIODS["half_hour"], grids)
        for name in VIEWS:
            timed(name, lambda n=name: views.view(n.split("_", 1)[1], request))
        for name in HEADLINE:
            timed(name, lambda n=name: QUERIES[n](spark, sf_dir))
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
