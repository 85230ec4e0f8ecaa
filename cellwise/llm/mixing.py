"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.llm.store import keep

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """Add ``weight`` and ``target`` to ``sources(source, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn and share the part ``share`` (a fraction) of all sizes; a
    target stops at ``most`` times the source's size, and the excess goes to the others by weight until none is above. That end is
    reached at once: a source stops exactly if, of those in order of most * size / weight, it and all before it
    stop. All sums are whole numbers, so the one division decides the last digit.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    up, down = share
    top = F.col("source_size") * most
    filled = weighed.withColumns({
        "stopped": F.coalesce(F.sum(top).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(whole),
    })
    # at equal ratios of size to weight all stop or none does, so the level of the first open source holds for all
    rest = F.col("total") * up - F.col("stopped") * down
    filled = filled.withColumn("stops", top * down * F.col("open") <= rest * F.col("weight"))
    level = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    first = F.min_by(F.struct(rest.alias("rest"), F.col("open")), F.when(~F.col("stops"), level)).over(whole)
    filled = filled.withColumn("first", first)
    shared = F.col("weight") * F.col("first.rest") / (F.col("first.open") * down)
    target = F.when(F.col("stops"), top.cast("double")).otherwise(shared)
    return filled.withColumn("target", target.cast("double")).select("source", "source_size", "weight", "target")


def offset(source: Column, seed: int) -> Column:
    """The source's one random offset in [0, 1): 32 bits of a digest of its name and the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 17) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken), one per row of ``docs(doc_id, text, source)``.

    Size is the number of words (null: 0). Each document of a source expects target / source_size copies. In the order of size and
    doc_id the expected copies are summed up, one offset is added, and a document comes once per whole number that its part of
    the sum crosses. By that order a source's words miss its target by no more than its largest document, and no
    document comes more than ``most`` times. The order is global, so reruns agree however the rows are dealt; the sums are
    made from counts per range of rows, so a source that holds most rows is spread over tasks like any other. Repeated rows
    are documents of their own. A source without words has target 0 and gives nothing; a null source is a source. Other
    columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"))
    return _sampled(slim, weights, share, most, seed)


def _sampled(slim: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int, seed: int) -> DataFrame:
    """``mix`` of rows (doc_id, source, size, ...): further columns, which can be sorted, come first and decide among rows of equal size and doc_id."""
    more = [c for c in slim.columns if c not in ("doc_id", "source", "size")]
    ranged = slim.repartitionByRange(*[F.col(c) for c in ("source", "size", "doc_id", *more)])
    kept = keep(ranged.withColumn("range", F.spark_partition_id()), "sizes")
    sums = kept.groupBy("source", "range").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    sums = keep(sums, "ranges")
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    before = F.sum("rows").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("source", "range", F.coalesce(before, F.lit(0)).alias("before"))
    plan = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(starts["source"].alias("plan_source"), "range", "before", "source_size", "target")
    place = F.row_number().over(Window.partitionBy("source", "range").orderBy("size", "doc_id", *more))
    ranked = kept.withColumn("place", place)
    same = ranked["source"].eqNullSafe(plan["plan_source"]) & (ranked["range"] == plan["range"])
    rows = ranked.join(plan, same).withColumn("rank", F.col("before") + F.col("place"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = offset(F.col("source"), seed)
    crossed = F.floor(F.col("rank") * expected + start) - F.floor((F.col("rank") - 1) * expected + start)
    rows = rows.withColumn("copies", F.least(crossed, F.lit(most)).cast("long"))
    return rows.select(*more, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 17) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, all columns as they are, whatever their names.

    Rows are told by doc_id, source and text. Those that agree in all three are taken together, their copies dealt out evenly, first to the first by
    their other columns' JSON; so rows of one doc_id or of null ones with different texts keep their own copies. Words are counted once; texts move once, to
    meet the copies. Nulls, long texts and repeated rows as in ``mix``; an empty table gives an empty result.
    """
    row = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.unhex(F.sha2(docs["text"], 256)), F.unhex(F.lit(""))).alias("digest"), docs["source"].alias("source"))
    slim = docs.select(row.alias("row"), word_count(docs["text"]).alias("size")).select("row.doc_id", "row.source", "row.digest", "size")
    copies = _sampled(slim, weights, share, most, seed).groupBy("doc_id", "source", "digest").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    copies = keep(copies.where("copies > 0"), "copies")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("kept"), row.alias("row"))
    same = rows["row.doc_id"].eqNullSafe(copies["doc_id"]) & rows["row.source"].eqNullSafe(copies["source"]) & (rows["row.digest"] == copies["digest"])

    def taken(of: DataFrame) -> DataFrame:
        return rows.join(of, same).select("kept", "row", "copies", "rows")

    alone = taken(copies.where("rows = 1")).withColumn("each", F.col("copies"))
    out = [alone]
    many = copies.where("rows > 1")
    if not many.isEmpty():
        nth = F.row_number().over(Window.partitionBy("row").orderBy(F.to_json("kept")))
        each = F.floor(F.col("copies") / F.col("rows")) + F.when(nth <= F.pmod(F.col("copies"), F.col("rows")), 1).otherwise(0)
        out.append(taken(many).withColumn("each", each))
    out = [x.where("each > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("each").cast("int")))).select("kept.*") for x in out]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
