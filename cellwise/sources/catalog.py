"""Manifests, chunk spans, lead windows and figure sets as tables."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One row per file.
ROW = "struct<title:string,url:string,urls:array<string>,size:bigint,start:string,member:string,first_month:string,last_month:string,replica:boolean,checksum:string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(model, var, fields of a file) from JSON of the form {model: {var: [file, ...]}}."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,array<{ROW}>>>").alias("m"))
    models = text.select(F.explode("m").alias("model", "vars"))
    files = models.select("model", F.explode("vars").alias("var", "files"))
    return files.select("model", "var", F.explode("files").alias("file")).select("model", "var", "file.*")


def read_flat_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest that is one JSON list."""
    return spark.read.schema(schema).json(path, multiLine=True)


def spans_of(files: DataFrame, title: str = "title") -> DataFrame:
    """Add start, member, lo and hi (month indices) read from names like ..._s1960-r1i1p1f1_gn_196011-197012.nc."""
    pattern = r"_s(\d{4})-(r\d+i\d+p\d+f\d+)_.*_(\d{4})(\d{2})-(\d{4})(\d{2})\.nc$"
    part = lambda i: F.regexp_extract(title, pattern, i)
    month = lambda y, m: (part(y).cast("int") * 12 + part(m).cast("int") - 1)
    named = files.where(F.col(title).rlike(pattern))
    return named.withColumns({"start": part(1).cast("int"), "member": part(2), "lo": month(3, 4), "hi": month(5, 6)})


def index_of(files: DataFrame) -> DataFrame:
    """(model, var, start, member, lo, hi, chunks): each member's files in order, and the months that they span."""
    chunks = F.array_sort(F.collect_list(F.struct("lo", "hi", "title")))
    return files.groupBy("model", "var", "start", "member").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), chunks.alias("chunks"))


def overlapping(files: DataFrame, windows: DataFrame, by: Sequence[str], months: int = 120) -> DataFrame:
    """Files (lo, hi) with the windows (w_lo, w_hi) of the same ``by`` that they overlap.

    Both are dealt to blocks of ``months``, so the join is by equality; a pair counts in the first block that both touch.
    """
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / months), F.floor(F.col(hi) / months)))
    joined = files.withColumn("_block", blocks("lo", "hi")).join(windows.withColumn("_block", blocks("w_lo", "w_hi")), [*by, "_block"])
    first = F.col("_block") == F.floor(F.greatest("lo", "w_lo") / months)
    return joined.where((F.col("lo") <= F.col("w_hi")) & (F.col("hi") >= F.col("w_lo")) & first).drop("_block")


def plan(files: DataFrame) -> DataFrame:
    """(model, var, files, bytes, members, starts, first_month): what a download would fetch."""
    return files.groupBy("model", "var").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("member").alias("members"), F.count_distinct("start").alias("starts"), F.min("first_month").alias("first_month")
    )


def planned_starts(files: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """(model, var, init_months, on_disk): the calendar months in which a model's starts begin, in order, and how many of its files are there.

    ``files(model, var, title, start, first_month)`` with months like 1960-11; a start begins with its earliest month, so one month means that all starts agree.
    ``on_disk(title)`` lists the files that are there.
    """
    month = F.substring("first_month", 6, 2).cast("int")
    firsts = files.where("first_month <> ''").groupBy("model", "var", "start").agg(F.min_by(month, "first_month").alias("month"))
    months = firsts.groupBy("model", "var").agg(F.array_join(F.array_sort(F.collect_set("month")), ",").alias("init_months"))  # at most twelve
    there = on_disk.select("title").distinct().withColumn("_there", F.lit(1)) if on_disk is not None else None
    counted = files.join(there, "title", "left") if there is not None else files.withColumn("_there", F.lit(None).cast("int"))
    return counted.groupBy("model", "var").agg(F.count("_there").alias("on_disk")).join(months, ["model", "var"], "left").select("model", "var", "init_months", "on_disk")


def canonical(var: Column) -> Column:
    """A variable's one name: PSL is SLP."""
    return F.when(F.upper(var) == "PSL", "SLP").otherwise(F.upper(var))


def merged_manifest(documents: DataFrame) -> DataFrame:
    """(model, var, title, urls, size, checksum): replicas folded into one row per file, the primary's url first; retracted ones left out."""
    kept = documents.where(~F.coalesce("retracted", F.lit(False)))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("replica", F.lit(False)).alias("replica"), "url")))
    best = lambda c: F.min_by(c, F.struct(F.coalesce("replica", F.lit(False)), F.col("url")))
    return kept.groupBy("model", "var", "title").agg(F.array_distinct(F.transform(order, lambda x: x["url"])).alias("urls"), best("size").alias("size"), best("checksum").alias("checksum"))


def first_months(files: DataFrame) -> DataFrame:
    """(model, start, month): absolute index of a start's earliest month."""
    index = F.substring("first_month", 1, 4).cast("int") * 12 + F.substring("first_month", 6, 2).cast("int") - 1
    return files.where("first_month <> ''").groupBy("model", "start").agg(F.min(index).alias("month"))


def start_constants(firsts: DataFrame) -> DataFrame:
    """(model, init_month, offset_years): calendar month of lead 1 and its year less the start's, null where starts disagree."""
    only = lambda x: F.when(F.count_distinct(x) == 1, F.min(x))
    year = F.regexp_extract("start", r"(\d+)", 1).cast("int")
    return firsts.groupBy("model").agg(only(F.pmod(F.col("month"), F.lit(12)) + 1).alias("init_month"), only((F.floor(F.col("month") / 12) - year)).alias("offset_years"))


def lead_windows(starts: DataFrame, series: DataFrame, leads: Sequence[tuple[int, int]], value: str = "o", by: Sequence[str] = ()) -> DataFrame:
    """(init, lead_from, lead_to, by, value): means of ``series(by, t, value)`` over each start's lead window, only where every month is there."""
    windows = starts.select("init", F.explode(F.array(*[F.struct(F.lit(a).alias("lead_from"), F.lit(b).alias("lead_to")) for a, b in leads])).alias("l")).select("init", "l.*")
    months = windows.withColumn("t", F.explode(F.sequence(F.col("init") + F.col("lead_from") - 1, F.col("init") + F.col("lead_to") - 1)))
    keys = ["init", "lead_from", "lead_to", *by]
    found = months.join(series, "t").groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    return found.where(F.col("n") == F.col("lead_to") - F.col("lead_from") + 1).drop("n")


def common_keys(rows: DataFrame, key: str, of: str, by: Sequence[str] = ()) -> DataFrame:
    """Values of ``key`` that every value of ``of`` has; within each of ``by`` if there is any."""
    if by:
        totals = rows.groupBy(*by).agg(F.count_distinct(of).alias("_total"))
        return rows.groupBy(*by, key).agg(F.count_distinct(of).alias("n")).join(totals, list(by)).where("n = _total").select(*by, key)
    total = rows.agg(F.count_distinct(of).alias("_total"))
    return rows.groupBy(key).agg(F.count_distinct(of).alias("n")).join(F.broadcast(total), F.col("n") == F.col("_total")).select(key)  # one row


def dropped_keys(rows: DataFrame, key: str, of: str) -> DataFrame:
    """(of, dropped): how many of its keys the others lack."""
    return rows.select(of, key).distinct().join(common_keys(rows, key, of), key, "left_anti").groupBy(of).agg(F.count("*").alias("dropped"))


def complete_starts(pairs: DataFrame, starts: DataFrame, members: DataFrame) -> DataFrame:
    """Of ``starts`` those that all ``members`` have; the same with the roles changed gives complete members."""
    n = members.agg(F.count("*").alias("_n"))
    there = pairs.join(members, "member").join(starts, "start").groupBy("start").agg(F.count_distinct("member").alias("_m"))
    return there.join(F.broadcast(n), F.col("_m") == F.col("_n")).select("start")  # one row


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the shared checkpoint folder; from a folder of our own only where none is set, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or (context.master or "").startswith("local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="cellwise-"))
    return df.checkpoint()


def largest_block(pairs: DataFrame, least_starts: int = 20, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(starts, members) of the largest complete rectangle of ragged coverage ``pairs(start, member)``.

    Three ways: drop starts that lack a member, members that lack a start, or members and starts in turn until nothing changes. The
    largest with at least ``least_starts`` starts wins, else the largest; of equals the first way. Only counts reach the driver.
    """
    # read once; and cut in every round, as plans that hold all rounds fill the driver
    pairs = pairs.select("start", "member").distinct()
    pairs = cut(pairs)
    every_start, every_member = pairs.select("start").distinct(), pairs.select("member").distinct()

    def members_of(starts: DataFrame, members: DataFrame) -> DataFrame:
        flip = lambda df: df.select(*[F.col(c).alias({"start": "member", "member": "start"}[c]) for c in df.columns])
        return flip(complete_starts(flip(pairs), flip(members), flip(starts)))

    ways = [(complete_starts(pairs, every_start, every_member), every_member), (every_start, members_of(every_start, every_member))]
    starts, members, size = every_start, every_member, None
    for _ in range(rounds):
        members = cut(members_of(starts, members))
        starts = cut(complete_starts(pairs, starts, members))
        now = (starts.count(), members.count())
        if now == size or not all(now):
            break
        size = now
    ways.append((starts, members))
    sizes = [(s.count(), m.count()) for s, m in ways]
    full = [i for i, (s, m) in enumerate(sizes) if s and m]
    good = [i for i in full if sizes[i][0] >= least_starts] or full
    return ways[max(good, key=lambda i: sizes[i][0] * sizes[i][1])] if good else (every_start.limit(0), every_member.limit(0))


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new``, which win by key. Of several new rows of a key the last by ``order`` counts (without one, by their JSON)."""
    once = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order if order is not None else F.to_json(F.struct(*new.columns))).alias("_row")).select("_row.*")
    return old.join(once, key, "left_anti").unionByName(once)


def verified(entries: DataFrame, files: DataFrame, key: str = "dest") -> DataFrame:
    """(key, state): for each entry ok, changed (by SHA-256, or by size if both list one), missing, or unrecorded where it has no hash; orphan for each file without an entry."""
    sized = "size" in entries.columns and "size" in files.columns
    listed = entries.select(key, F.col("sha256").alias("_want"), (F.col("size") if sized else F.lit(None)).alias("_size"), F.lit(True).alias("_listed"))
    found = files.select(key, F.col("sha256").alias("_have"), (F.col("size") if sized else F.lit(None)).alias("_bytes"), F.lit(True).alias("_found"))
    state = (
        F.when(F.col("_listed").isNull(), "orphan")
        .when(F.col("_found").isNull(), "missing")
        .when(F.col("_size") != F.col("_bytes"), "changed")
        .when(F.col("_want").isNull(), "unrecorded")
        .when(F.col("_want") == F.col("_have"), "ok")
        .otherwise("changed")
    )
    return listed.join(found, key, "full").select(key, state.alias("state"))


def set_problems(entries: DataFrame, files: DataFrame, sources: DataFrame, name: str, most_mb: float = 50.0, only: str | None = None) -> DataFrame:
    """(dest, problem), a row per problem of a set of copied files; nothing is opened, only listings meet.

    ``entries(dest, source, section, sha256)``, ``files(dest, size, sha256)`` that lie in the set, ``sources(source, sha256)``. A dest lies in the
    folder of the set's name and in the entry's section there, equals its source and its recorded hash, and is no larger than ``most_mb``.
    ``only`` takes the entries that hold it, and leaves orphans out; an error if it matches none.
    """
    chosen = selected(entries, only)
    if only is not None and chosen.isEmpty():
        raise ValueError(f"{only!r} matches no entry")
    have = files.select("dest", F.col("size").alias("_size"), F.col("sha256").alias("_have"), F.lit(True).alias("_found"))
    origin = sources.select("source", F.col("sha256").alias("_origin"), F.lit(True).alias("_source"))
    rows = chosen.join(have, "dest", "left").join(origin, "source", "left")
    found, parts = F.col("_found").isNotNull(), F.split("dest", "/")
    problems = {
        "outside": ~F.col("dest").startswith(f"{name}/"),
        "section": (F.col("section") != "") & ((F.size(parts) < 3) | (F.get(parts, F.lit(1)) != F.col("section"))),
        "missing": ~found,
        "source missing": found & F.col("_source").isNull(),
        "differs from source": F.col("_have") != F.col("_origin"),
        "unrecorded": found & F.col("sha256").isNull(),
        "changed": F.col("_have") != F.col("sha256"),
        "too large": F.col("_size") / 1e6 > most_mb,
    }
    listed = rows.select("dest", F.explode(F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in problems.items()]), lambda x: x.isNotNull())).alias("problem"))
    if only is not None:
        return listed
    orphans = files.where(F.col("dest").startswith(f"{name}/")).join(entries, "dest", "left_anti").select("dest", F.lit("orphan").alias("problem"))
    return listed.unionByName(orphans)


def refreshed(entries: DataFrame, files: DataFrame, only: str | None = None) -> DataFrame:
    """``entries`` with the hashes of the ``files`` that are there; others, and those that don't hold ``only``, keep theirs."""
    have = files.select("dest", F.col("sha256").alias("_have"))
    chosen = F.lit(True) if only is None else F.col("dest").contains(only)
    return entries.join(have, "dest", "left").withColumn("sha256", F.when(chosen, F.coalesce("_have", "sha256")).otherwise(F.col("sha256"))).select(entries.columns)


def hashes(spark: SparkSession, path: str, name: str = "dest") -> DataFrame:
    """(name, size, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias(name), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def uncovered(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a chunked job has yet to write, or wrote more than once, with the number of times."""
    counted = done.groupBy(*keys).count()
    return expected.select(*keys).join(counted, list(keys), "left").fillna(0, ["count"]).where("count <> 1")


def selected(entries: DataFrame, only: str | None, key: str = "dest") -> DataFrame:
    return entries if only is None else entries.where(F.col(key).contains(only))


def members_of_model(rows: DataFrame, labels: DataFrame, model: str, members: int, verified: bool = True) -> DataFrame:
    """Rows of one model's members, by ``labels(member, model)``; an error if the labels were not ``verified``, or don't fit the ``members`` of the case."""
    if not verified:
        raise ValueError("the labels were not checked against the case")
    counts = labels.agg(F.count("*").alias("n"), F.count_if(F.col("model") == model).alias("m")).first()
    if counts["n"] != members:
        raise ValueError(f"{counts['n']} labels for {members} members")
    if not counts["m"]:
        raise ValueError(f"no member of {model}")
    return rows.join(labels.where(F.col("model") == model).select("member"), "member", "left_semi")


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_n = 1").drop("_n")
