"""Ensembles as long tables: members(cell, member, t, f), obs(cell, t, o), grid(cell, lat, lon, w)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """The value as double, null if it isn't a number: Spark's aggregates skip nulls, but not NaN."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_case(spark: SparkSession, path: str, var: str, case: str) -> DataFrame:
    """One case of a table that is partitioned by var and case; only its files are read."""
    return spark.read.parquet(path).where((F.col("var") == var) & (F.col("case") == case))


def from_embeddings(spark: SparkSession, sf_dir: str, members: int = 10) -> tuple[DataFrame, DataFrame]:
    """Each vector is a map of one member at one time, its components the cells; member 0 is the observed series."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("cell", "x"))
    rows = rows.select("cell", (F.col("vec_id") % members).cast("int").alias("member"), F.expr(f"int(vec_id div {members})").alias("t"), known(F.col("x")).alias("f"))
    return rows.where("member > 0"), rows.where("member = 0").select("cell", "t", F.col("f").alias("o"))


def from_lineitem(spark: SparkSession, sf_dir: str, members: int = 10) -> DataFrame:
    """Monthly mean prices in thousands: a cell per return flag and line status, a member per group of suppliers. Ragged; months as index."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("cell"), (F.col("l_suppkey") % members).cast("int").alias("member"), month.alias("t")
    )
    return rows.agg((F.avg(F.col("l_extendedprice").cast("double")) / 1000).alias("f"))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean order totals as an observed series: (t, o)."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("int")
    return table(spark, sf_dir, "orders").groupBy(month.alias("t")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("o"))


def with_grid(df: DataFrame, columns: int = 8, rows: int = 8) -> DataFrame:
    """Add lat, lon and the area weight w of cells that number a grid row by row, from south to north."""
    lat = -90 + (F.floor(F.col("cell") / columns) + 0.5) * (180 / rows)
    lon = F.pmod(F.col("cell"), F.lit(columns)) * (360 / columns)
    return df.withColumns({"lat": lat, "lon": lon.cast("double"), "w": F.cos(F.radians(lat))})


def read_month_blocks(spark: SparkSession, path: str, lons: int, scale: float = 100.0) -> DataFrame:
    """Rows (year, month, lat_idx, lon_idx, value) of text files (also gzipped) of blocks: a line "year month", then a map as integers.

    Rows of a map go from north to south and come out from south to north; values are scaled.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\n").alias("lines"))
    lines = text.select("file", F.posexplode("lines").alias("line", "text"))
    words = lines.withColumn("words", F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: w.cast("int")))
    # a map's lines take the head above them: one pass over a file's lines in order
    head = F.last(F.when(F.size("words") == 2, F.struct(F.col("line").alias("head"), F.col("words")[0].alias("year"), F.col("words")[1].alias("month"))), ignorenulls=True)
    headed = words.withColumn("at", head.over(Window.partitionBy("file").orderBy("line"))).where((F.size("words") > 2) & F.col("at").isNotNull())
    joined = headed.select("file", "at.*", "line", F.posexplode("words").alias("place", "x"))
    maps = joined.groupBy("file", "head", "year", "month").agg(F.array_sort(F.collect_list(F.struct("line", "place", "x"))).alias("cells"))
    cells = maps.select("year", "month", F.size("cells").alias("n"), F.posexplode("cells").alias("at", "cell"))
    north = F.floor(F.col("at") / lons)
    return cells.select("year", "month", (F.col("n") / lons - 1 - north).cast("int").alias("lat_idx"), (F.col("at") % lons).alias("lon_idx"), (F.col("cell.x") * scale).alias("value"))


def normalise(rows: DataFrame, value: str, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(t, lat, lon, o): longitudes from 0 to 360 and values in the ensemble's unit."""
    return rows.select("t", "lat", F.pmod(F.col("lon"), F.lit(360.0)).alias("lon"), (known(F.col(value)) * scale + offset).alias("o"))


def exactly(series: DataFrame, want: DataFrame, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Rows of ``series`` at the times ``want(t)``, of those groups alone that have every one of them."""
    total = want.select("t").distinct().agg(F.count("*").alias("_want"))
    kept = series.join(want.select("t").distinct(), "t", "left_semi")
    full = kept.groupBy(*by).agg(F.count_distinct("t").alias("_has")).join(F.broadcast(total), F.col("_has") == F.col("_want"))  # one row
    return kept.join(full.select(*by), list(by), "left_semi")


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written there if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
