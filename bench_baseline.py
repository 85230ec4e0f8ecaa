"""The exchangeability test on a made-up ensemble of the shape of a published run: 72 x 144 cells, 62 members, 33 times, 200 permutations. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cellwise.operators import exchange  # noqa: E402

CELLS, MEMBERS, TIMES, REPS, BINS = int(os.environ.get("BENCH_CELLS", 72 * 144)), 62, 33, 200, 3


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench-baseline").config("spark.sql.shuffle.partitions", "96").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    path = tempfile.mkdtemp(prefix="cellwise-bench-")
    place = spark.range(CELLS * MEMBERS * TIMES)
    rows = place.select(F.floor(F.col("id") / (MEMBERS * TIMES)).cast("int").alias("cell"), (F.floor(F.col("id") / TIMES) % MEMBERS).cast("int").alias("member"), (F.col("id") % TIMES).cast("int").alias("t"), F.randn(1).alias("f"))
    rows.write.mode("overwrite").parquet(path)
    members = spark.read.parquet(path)
    perms = exchange.label_permutations(spark, REPS, TIMES, list(range(MEMBERS)))
    seconds = {}
    for name, detrended in (("plain", False), ("detrended", True)):
        began = time.time()
        tested = exchange.test_statistics(members, perms, BINS, detrended=detrended)
        exchange.significance(tested).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 1)
        print(json.dumps({"metric": "exchangeability_seconds", "shape": [CELLS, MEMBERS, TIMES, REPS], "seconds": seconds}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
