"""MinHash near-dedup by ProbMinHash over weighted word shingles.

A shingle of weight w (how often it occurs) arrives at a text's signature by a Poisson process of rate w; each arrival
falls on one of the m places, which keeps the earliest. Its process stops as soon as its next arrival is later than
the latest place. Two signatures agree at a place with the probability Jaccard similarity of the weighted sets.
Signatures are cut into bands; texts that share a band are verified by the exact similarity and classes are components.

With 18 bands of 5 a pair of similarity 0.8 shares a band with probability 0.9992.

Rules: null text counts as empty; texts without words are one class only if identical; rows repeated in full are one
class; a null id is kept as it is. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dup, shingles
from .common import discard, keep_winners, sha256_hex, text_or_empty, trimmed, written
from .shingles import mixed

BANDS, ROWS = 18, 5
SIMILARITY = 0.8

_U = np.uint64
_NEVER = _U(0xFFFFFFFFFFFFFFFF)


def signatures(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """A row of m 32-bit values per weighted set; sets are runs of elements between offsets. Empty sets give zeros."""
    n = len(offsets) - 1
    table = np.full(n * m, _NEVER, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    rate, at, turn = weights.astype(float), np.zeros(len(elements)), 0
    while len(elements):
        turn += 1
        draw = mixed(elements + _U(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = mixed(draw ^ _U(0x5851F42D4C957F2D))
        at = at - np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate
        place = ((place >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        when = at.astype(np.float32).view(np.uint32).astype(np.uint64)  # positive floats order as their bits do
        np.minimum.at(table, owner * m + place, when << _U(32) | elements >> _U(32))
        latest = table.reshape(n, m).max(axis=1) >> _U(32)
        early = when <= latest[owner]
        elements, owner, rate, at = elements[early], owner[early], rate[early], at[early]
    out = (table & _U(0xFFFFFFFF)).astype(np.uint32).reshape(n, m)
    out[np.diff(offsets) == 0] = 0
    return out


def prepare(texts: list[str], bands: int = BANDS, rows: int = ROWS) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """By chunk of texts: index of the first, content keys, whether it has words, band keys."""
    for first, chunk in shingles.chunks(texts):
        words, offsets = shingles.word_hashes(chunk)
        keys = [shingles.content_key(words[offsets[i] : offsets[i + 1]], t) for i, t in enumerate(chunk)]
        hashes, starts = shingles.shingles(words, offsets)
        sets = [np.unique(hashes[starts[i] : starts[i + 1]], return_counts=True) for i in range(len(chunk))]
        ends = np.cumsum([0] + [len(s[0]) for s in sets])
        signed = signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), ends, bands * rows)
        yield first, keys, np.diff(ends) > 0, shingles.band_keys(signed, bands, rows)


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A written table: rid (unique), id, digest of the text, key, bands, text."""
    narrow = docs.select(F.col(id_col).alias("id"), F.unhex(sha256_hex(text_col)).alias("digest"), text_or_empty(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, keys, has, bands_of in prepare(texts, bands, rows):
                part = batch.slice(first, len(keys))
                ends = np.cumsum(np.append(0, has * bands), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands_of[has].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array(keys, pa.binary()), lists, part.column("text")], ["id", "digest", "key", "bands", "text"])

    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(trimmed(sign), f"id {kind}, digest binary, key binary, bands array<long>, text string")
    return written(out.withColumn("rid", F.monotonically_increasing_id()), "items")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: rid, id, digest and head, the row that stands for its class: the one of the smallest id."""
    items = prepared(docs, id_col, text_col)
    found = near_dup.near_classes(items, near_dup.Measure(shingles.counted, near_dup.probability_jaccard, similarity, sets=True))
    found = written(found.select("rid", "id", "digest", F.coalesce("root", "rid").alias("root")), "class_rows")
    discard(items)
    return near_dup.with_heads(found, ["id", "digest"])


def class_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, class_id (the id of the row that stands for the class), kept (whether this row is that one)."""
    found = near_classes(docs, id_col, text_col, similarity)
    return found.select(F.col("id").alias(id_col), F.col("head.id").alias("class_id"), (F.col("rid") == F.col("head.rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near copies, with all its columns."""
    heads = near_classes(docs, id_col, text_col, similarity).where("rid = head.rid").select("digest", F.col("id").alias("keep_id"))
    return keep_winners(docs, heads, id_col, text_col)
