"""From band keys to classes of near copies: candidates, verification, components.

Items with the same content key are one node, so copies cost a row. Of the nodes that share a band key each is
compared with the smallest and the largest of them; verified pairs are linked and components taken. In a bucket whose
nodes are still in several components, every node outside its largest component is then compared with all nodes of
the others, so every pair that shares a band key is either compared or already in one class. That is done block by
block within tasks, which return links alone; a pair of several common bands is compared in the smallest key of them.
Lists of bands may have any length and order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import discard, join_hot, trimmed, written
from .components import components

#: Nodes of a bucket that are held in a task at a time, of either side.
BLOCK = 256


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted keys, weights): scale-free, Jaccard for equal weights."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = a[1].astype(float), b[1].astype(float)
    if wa.max() == wa.min() and wb.max() == wb.min():
        return len(ia) / (len(wa) + len(wb) - len(ia))
    both_a, both_b = wa[ia], wb[ib]
    order = np.argsort(both_a / both_b, kind="stable")
    x, y = both_a[order], both_b[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # of the common keys, those with a larger ratio count by a, the others by b
    over = (only_a + x.sum() - np.cumsum(x)) / x
    under = (only_b + np.cumsum(y)) / y
    return float((1 / (over + under)).sum())


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return common / max(len(a[0]) + len(b[0]) - common, 1)


@dataclass
class Measure:
    """similarity(features(x), features(y)) >= least links two texts. sets: features are (sorted keys, weights) and the
    similarity is at most the share of either's weight that is common. pairs: the similarities of two lists of texts."""

    features: Callable
    similarity: Callable
    least: float
    sets: bool = False
    pairs: Callable | None = None


def verified(pairs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """The pairs a, b whose texts are linked. nodes: node, text, and size where sets that differ too much in it cannot be."""
    sized = [c for c in nodes.columns if c == "size"]
    of = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("text", *sized)])
    rows = pairs.join(of("a"), "a").join(of("b"), "b")
    if sized:
        rows = rows.where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * measure.least - 1e-9)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}

        def of(node: int, text: pa.Scalar) -> tuple:
            if node not in seen:
                if len(seen) >= 128:
                    seen.clear()
                seen[node] = measure.features(text.as_py())
            return seen[node]

        for batch in batches:
            x, y = batch.column("text_a"), batch.column("text_b")
            if measure.pairs:
                yield batch.select(["a", "b"]).filter(pa.array(measure.pairs(x.to_pylist(), y.to_pylist()) >= measure.least))
                continue
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = [measure.similarity(of(i, x[k]), of(j, y[k])) >= measure.least for k, (i, j) in enumerate(zip(a, b, strict=True))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(verify), "a long, b long")


def compare_block(measure: Measure, band: int, few: list[tuple], rest: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links between rows (node, root, is_few, bands, features) of few and of rest in different components that have no
    smaller band key in common than this one. A pair of two few rows is left to the smaller one."""
    node, root = np.array([x[0] for x in rest]), np.array([x[1] for x in rest])
    is_few = np.array([x[2] for x in rest], dtype=bool)
    before = [x[3][x[3] < band] for x in rest]
    owner, before = np.repeat(np.arange(len(rest)), [len(x) for x in before]), np.concatenate(before)
    if measure.sets:
        sizes = np.array([len(x[4][0]) for x in rest])
        keys, place = np.unique(np.concatenate([x[4][0] for x in rest]), return_inverse=True)
        weight = np.concatenate([x[4][1] / x[4][1].sum() for x in rest])
        at = np.cumsum(sizes) - sizes
    for n, r, _, own, features in few:
        fit = (root != r) & (~is_few | (node > n))
        if not fit.any():
            continue
        fit[owner[np.isin(before, own[own < band])]] = False
        if measure.sets and fit.any():
            found = np.isin(keys, features[0])
            share = np.add.reduceat(weight * found[place], at)
            fit &= share >= measure.least - 1e-9
        for k in np.flatnonzero(fit):
            if measure.similarity(features, rest[k][4]) >= measure.least:
                yield min(n, int(node[k])), max(n, int(node[k]))


def across(rows: DataFrame, measure: Measure) -> DataFrame:
    """Links a, b between components within buckets. rows: band, node, root, main (the bucket's largest component), bands, text."""
    few = F.col("root") != F.col("main")
    size = rows.groupBy("band").agg(F.count("*").alias("n"), F.count(F.when(few, 1)).alias("m"))
    rows = rows.join(written(size, "block_sizes"), "band").withColumn("few", few)
    mine = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / BLOCK)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK).cast("int") - 1)
    cells = F.transform(all_of("m"), lambda f: F.struct(f.alias("f"), mine("n").alias("g"), F.lit(False).alias("left")))
    of_few = F.transform(all_of("n"), lambda g: F.struct(mine("m").alias("f"), g.alias("g"), F.lit(True).alias("left")))
    rows = rows.withColumn("c", F.explode(F.when(F.col("few"), F.concat(cells, of_few)).otherwise(cells)))
    rows = rows.select("band", "c.f", "c.g", "c.left", "few", "node", "root", "bands", "text")
    names = ["band", "f", "g", "left", "few", "node", "root", "bands", "text"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, seen = None, ([], []), {}

        def links() -> pa.RecordBatch:
            found = list(compare_block(measure, now[0], sides[1], sides[0])) if sides[0] and sides[1] else []
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for band, f, g, left, is_few, node, root, bands, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (band, f, g) != now:
                    if now:
                        yield links()
                    now, sides, seen = (band, f, g), ([], []), {}
                if node not in seen:
                    seen[node] = measure.features(text)
                sides[left].append((node, root, is_few, np.array(bands, dtype=np.int64), seen[node]))
        if now:
            yield links()

    return rows.repartition("band", "f", "g").sortWithinPartitions("band", "f", "g").mapInArrow(trimmed(compare), "a long, b long")


def with_heads(found: DataFrame, by: list[str], join: Callable = join_hot) -> DataFrame:
    """found (a written table of rows with rid and root) with head, the row of its class that is first by these columns: a
    struct of them and rid, and n, the rows of its class. Which row it is does not depend on how rows were numbered."""
    heads = written(found.groupBy("root").agg(F.min(F.struct(*by, "rid")).alias("head"), F.count("*").alias("n")), "heads")
    return join(found, heads, "root", "n")


def near_classes(items: DataFrame, measure: Measure, join: Callable = join_hot) -> DataFrame:
    """items (a written table): rid long (unique), key binary, bands array<long>, text string, size int if sets, and more.

    Returns items without bands, text and size but with root: the smallest rid of the class the item is in, null where
    it is alone in its class.
    """
    reps = items.groupBy("key").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    reps = written(reps, "nodes")  # one key, one list
    banded = reps.select("node", F.explode("bands").alias("band"))
    size = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
    size = written(size, "buckets")
    shared = written(banded.join(size, "band"), "shared")
    by_low = shared.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    by_high = shared.where("node < high AND node > low").select(F.col("node").alias("a"), F.col("high").alias("b"))
    pairs = written(by_low.unionByName(by_high).distinct(), "pairs")
    wanted = shared.select("node").distinct()
    texts = written(items.join(wanted.hint("merge"), F.col("rid") == F.col("node"), "left_semi").select(F.col("rid").alias("node"), "text", *[c for c in items.columns if c == "size"]), "texts")
    links = written(verified(pairs, texts, measure), "verified")
    discard(pairs)
    roots = components(links)

    # buckets of four or more have pairs without an end: those are made where components differ
    big = shared.where("n > 3").select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    big = written(big, "open")
    share = big.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = share.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", "main")
    main = written(main, "mains")
    discard(size, shared)
    if not main.isEmpty():
        rows = big.join(main, "band").join(texts.select("node", "text"), "node").join(reps.select("node", "bands"), "node")
        late = written(across(rows, measure), "verified")
        if not late.isEmpty():
            roots = components(links.unionByName(late))
    classes = reps.join(roots, "node", "left").where("root IS NOT NULL OR copies > 1")
    classes = written(classes.select("key", F.coalesce("root", "node").alias("root"), "copies"), "classes")
    discard(reps, texts, links, big, main)
    return join(items.drop("bands", "text", "size"), classes, "key", "copies", "left").drop("copies")
