"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Each source has a share of all words (its target) and a weight schedule over training time t in [0, 1]. The
integral of the schedule is the cumulative demand for its words; its documents, in an order fixed by a hash of
their id, meet that demand one after the other, pass by pass. A document's position is the time at which the
demand reaches its middle word: the inverse of the integral. Sorting by position by range gives the training order.

Targets: sources in code-point order, null last, weigh 5, 2, 1 and so on repeating, and share all words in
proportion; a target stops at max_repeats times its source's words and the excess is shared again by weight.
A document is taken once for each pass in which its middle word lies below the target, so at most max_repeats times,
and a source misses its target by half a document at most.

Rules: null text has size 0 and is emitted in the passes that reach it; a null id is hashed with its text; rows
repeated in full are separate documents to ``assign``. A text of any length is taken or left whole. No rows give no rows. Other columns
are ignored. What is done for each source alone (``source_plan``) runs in one task, on a row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sha256_hex, text_or_empty, written

WEIGHTS = (5, 2, 1)
#: Weight over time by the same turn as WEIGHTS, as (time, weight) knots joined by straight lines.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))
ROWS_PER_BUCKET = 1_000
#: Sources up to this many are broadcast; more are joined by sort-merge.
MAX_BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence = SCHEDULES, max_repeats: int = 3) -> DataFrame:
    """A row per source: source, source_size, n_rows, target and its schedule (knots t, weights w, demand d at the knots)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("__turn", turn % len(weights))
    pick = lambda values: F.element_at(F.array(*values), F.col("__turn") + 1)
    per = per.withColumn("__w", pick([F.lit(w) for w in weights]))
    by_ratio = Window.orderBy((F.lit(max_repeats) * F.col("source_size") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    full = F.lit(max_repeats) * F.col("source_size")
    per = per.withColumn("__total", F.sum("source_size").over(Window.partitionBy()))
    per = per.withColumn("__before", F.coalesce(F.sum(full).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("__from", F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("__total") - F.col("__before")) / F.col("__from")
    per = per.withColumn("__level", level).withColumn("__nth", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("__level") <= full / F.col("__w"), F.struct("__nth", "__level"))).over(Window.partitionBy())
    per = per.withColumn("target", F.least(full.cast("double"), first["__level"] * F.col("__w")))
    knots = [[float(t) for t, _ in s] for s in schedules]
    areas = [[0.0] for _ in schedules]
    for s, a in zip(schedules, areas, strict=True):
        for (t0, w0), (t1, w1) in zip(s, s[1:], strict=False):
            a.append(a[-1] + (w0 + w1) / 2 * (t1 - t0))
    unit = [a[-1] for a in areas]
    rows = [F.array(*[F.lit(x) for x in k]) for k in knots]
    shape = [F.array(*[F.lit(float(w) / u) for _, w in s]) for s, u in zip(schedules, unit, strict=True)]
    done = [F.array(*[F.lit(x / u) for x in a]) for a, u in zip(areas, unit, strict=True)]
    return per.select("source", "source_size", "n_rows", "target", pick(rows).alias("t"), pick(shape).alias("w"), pick(done).alias("d"))


def invert_demand(share: Column) -> Column:
    """The time at which a source's demand has reached this share of its target; columns t, w, d are its schedule."""
    k = F.least(F.greatest(F.size(F.filter("d", lambda x: x <= share)), F.lit(1)), F.size("d") - 1)
    at = lambda c, i: F.element_at(F.col(c), i)
    t0, w0, w1, long = at("t", k), at("w", k), at("w", k + 1), at("t", k + 1) - at("t", k)
    y = share - at("d", k)
    return t0 + F.lit(2.0) * y / (w0 + F.sqrt(w0 * w0 + F.lit(2.0) * (w1 - w0) / long * y))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, key: Column | None = None, **plan) -> DataFrame:
    """A row per document: id, source, size, source_size, target, copies int and positions array<double> (a time for each copy).

    The running word count of a source is cut into buckets of about ROWS_PER_BUCKET documents by their hash: sums
    of buckets first, then within a bucket, so a source with a third of all rows is spread like any other.
    """
    key = F.lit(None).cast("binary") if key is None else key
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.md5(text_or_empty(text_col))))
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(ident).alias("__h"), key.alias("__key"))
    sized = written(sized, "sized")  # texts are read and counted once
    sources = source_plan(sized, max_repeats=max_repeats, **plan)
    few = sources.count() <= MAX_BROADCAST_SOURCES
    small = sources.withColumnRenamed("source", "__s")
    rows = sized.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("__s")), "inner").drop("__s")
    u = F.conv(F.substring("__h", 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    rows = rows.withColumn("__b", F.floor(u * F.ceil(F.col("n_rows") / ROWS_PER_BUCKET)))
    sums = rows.groupBy("source", "__b").agg(F.sum("size").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("__s"), F.col("__b").alias("__sb"), before.alias("__before"))
    rows = rows.join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__sb"))).drop("__s", "__sb")
    within = Window.partitionBy("source", "__b").orderBy("__h", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__start", F.col("__before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    starts = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda p: F.lit(2) * (p * F.col("source_size") + F.col("__start")) + F.col("size"))
    rows = rows.withColumn("__twice", F.filter(starts, lambda x: x <= F.lit(2.0) * F.col("target")))
    times = F.transform("__twice", lambda x: invert_demand(F.when(F.col("target") > 0, x / (F.lit(2.0) * F.col("target"))).otherwise(F.lit(0.0))))
    return rows.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", F.size("__twice").alias("copies"), times.alias("positions"), F.col("__key").alias("key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, range-sorted by position. The columns are those of docs.

    Rows repeated in full are taken as often as all of them together.
    """
    cols = docs.columns
    taken = assign(docs, id_col, text_col, source_col, key=F.unhex(sha256_hex(text_col)), **options)
    taken = taken.groupBy(F.col(id_col).alias("__tw_id"), F.col("key").alias("__tw_key"), F.col("source").alias("__tw_source")).agg(F.flatten(F.collect_list("positions")).alias("__tw_at"))
    rows = docs.withColumn("__tw_digest", F.unhex(sha256_hex(text_col))).withColumn("__tw_src", F.col(source_col).cast("string"))
    on = (F.col("__tw_digest") == F.col("__tw_key")) & F.col(id_col).eqNullSafe(F.col("__tw_id")) & F.col("__tw_src").eqNullSafe(F.col("__tw_source"))
    rows = rows.join(taken.hint("merge"), on).dropDuplicates(["__tw_digest", id_col, "__tw_src"])
    rows = rows.withColumn("__tw_pos", F.explode("__tw_at"))
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartitionByRange(int(n), "__tw_pos", id_col).sortWithinPartitions("__tw_pos", id_col)
    return rows.select(*[F.col(f"`{c}`") for c in cols])


def with_order(mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a mix that has been written as Parquet files, with their place in it: part (number of the file), row (in the
    file), and copy, which of the copies of this document it is (0, 1 ..) in training order, whatever the files."""
    order = mixed.withColumn("part", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")).withColumn("row", F.col("_metadata.row_index"))
    of = Window.partitionBy(id_col, F.xxhash64(text_or_empty(text_col))).orderBy("part", "row")
    return order.withColumn("copy", F.row_number().over(of) - 1)
