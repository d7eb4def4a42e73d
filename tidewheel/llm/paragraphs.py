"""Substring dedup by paragraph: bottom-k MinHash, exact Jaccard, removal by components.

The paragraphs that are compared are pieces of lines, cut behind the ends of sentences, so a passage that starts or ends
within a line still has pieces of its own. Sentences of fewer than MIN_PIECE words join the next one of their line; one of
more than MAX_PIECE words is cut where its words say so (see ``cuts``), so a passage in it has the same pieces whatever
stands around it. Pieces
of the same words are one node; those of at least MIN_BANDED words are signed by the least hashes of their word shingles, those
that share one are verified by the exact Jaccard similarity of their shingles, and classes are components. Of a class the
piece that comes first (by id, line and piece) stays.

The others are removed where they follow each other in a document with min_passage words or more in all: passages go,
single common sentences stay. They are in their class all the same.

No pair of similarity s or more is left out: two such sets share at least s of the larger one, so of m shingles in one order
for all pieces the first m - ceil(s * m) + 1 hold a common one (see ``least_shingles``). Pieces of fewer than MIN_BANDED words
have one shingle, of all their words, and are compared by these alone. In that order, shingles that are frequent in a bounded
sample of the rows come last, so few pieces meet by chance; the sample decides how many pairs are verified, never the result.

Rules: null text counts as empty; a line without words is a piece of no words and a class of its own, unless other lines
have the same text (an empty line never has copies); repeated rows have repeated pieces and the later ones go; a null id comes
first. A text of any length has all its pieces; a line without the end of a sentence is cut by its words alone, and one that
repeats two words throughout stays one piece whatever its length.
No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near_dup, shingles
from .common import discard, join_spread, text_or_empty, trimmed, written
from .shingles import mixed

SIMILARITY = 0.8
#: Rows whose shingles are counted for the order of all; how often one is there at least to count as frequent; how many of these.
SAMPLE, FREQUENT, MOST_FREQUENT = 16_384, 3, 65_536
#: Words of a piece at least, but for the last one of a line; of a piece that is signed; of a run of copies that is removed;
#: of a sentence that stays whole, at most; and the words to either side among which a cut is the least.
MIN_PIECE = 6
MIN_BANDED = shingles.SHINGLE
MIN_PASSAGE = 30
MAX_PIECE = 40
CUT_REACH = 8
_END = re.compile(r"[.!?\u3002\uff01\uff1f]+\s+")

_WORD = re.compile(r"\S+")

_U = np.uint64


def distinct_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    keys, _ = shingles.counted(text)
    return keys, np.ones(len(keys))


def jaccards(a: list[str], b: list[str]) -> np.ndarray:
    """near_dup.jaccard of the shingles of a[i] and b[i] for each i."""
    out, size, first = [], 0, 0
    for i in range(len(a)):
        size += len(a[i]) + len(b[i])
        if size >= shingles.CHUNK_BYTES or i == len(a) - 1:
            out.append(_jaccards(a[first : i + 1], b[first : i + 1]))
            size, first = 0, i + 1
    return np.concatenate([np.zeros(0), *out])


def _jaccards(a: list[str], b: list[str]) -> np.ndarray:
    n = len(a)
    hashes, starts = shingles.shingles(*shingles.word_hashes(a + b))
    owner = np.repeat(np.arange(2 * n), np.diff(starts))
    order = np.lexsort((owner, hashes, owner % n))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
    hashes, pair = hashes[new], owner[new] % n
    common = np.bincount(pair[1:][(hashes[1:] == hashes[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
    return common / np.maximum(np.bincount(pair, minlength=n) - common, 1)


def frequent_shingles(docs: DataFrame, min_piece: int = MIN_PIECE, rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most pieces of a sample of about so many rows of docs (id, text) have, sorted, and in how many: at most
    MOST_FREQUENT of them."""
    total = docs.count()
    if total > rows:
        docs = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen = [np.zeros(0, dtype=np.uint64)], set()
        for batch in batches:
            for _, chunk in shingles.chunks(batch.column("text").to_pylist()):
                flat = list(dict.fromkeys(p for t in chunk for line in pieces(t, min_piece) for p in line if p not in seen))
                seen.update(flat)
                found += [np.unique(x) for x in _split(*shingles.shingles(*shingles.word_hashes(flat)))]
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)], pa.int64())], ["shingle", "n"])

    counts = docs.select("text").mapInArrow(trimmed(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toArrow()
    keys = most["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], most["n"].to_numpy().astype(np.uint64)[order]


def _split(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return [hashes[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def least_shingles(hashes: np.ndarray, starts: np.ndarray, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece (its shingles stand between two starts) the values of the least shingles that a piece as similar as this must
    share one of, where each piece's values start, and how many different shingles it has.

    A value is the shingle's hash, behind all others if it is frequent. The number of values grows with the piece, so it is
    a bottom-k sketch that misses nothing: if none of the first m - ceil(s * m) + 1 values of two sets were common, the set whose
    last such value is less would have at most ceil(s * m) - 1 in common with the other.
    """
    n = len(starts) - 1
    value, owner = mixed(hashes) >> _U(16), np.repeat(np.arange(n), np.diff(starts))
    keys, counts = frequent
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        value |= np.where(keys[at] == hashes, np.minimum(counts[at], _U(0xFFFF)), _U(0)) << _U(48)
    value = value[np.lexsort((value, owner))]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
    value, owner = value[new], owner[new]
    size = np.bincount(owner, minlength=n)
    few = np.where(size, size - np.ceil(size * similarity - 1e-9).astype(np.int64) + 1, 0)
    few = np.minimum(few, size)
    chosen = np.arange(len(value)) - (np.cumsum(size) - size)[owner] < few[owner]
    return value[chosen].view(np.int64), np.append(0, np.cumsum(few)), size


def cuts(sentence: str, reach: int = CUT_REACH) -> list[int]:
    """Where to cut a long sentence: before each word whose hash, with that of the next one, is less than those of the reach
    words before it and no more than those of the reach words behind it. Only these words decide."""
    found = list(_WORD.finditer(sentence))
    hashes = [zlib.crc32(m.group().lower().encode("utf-8", "surrogatepass")) for m in found]
    n = len(hashes) - 1
    if n < 2 * reach + 1:
        return []
    one = np.array(hashes, dtype=np.uint64)
    pair = mixed(one[:-1] * _U(0x9E3779B1) + one[1:])
    around = np.lib.stride_tricks.sliding_window_view(pair, reach)
    before, behind = around[: n - 2 * reach].min(1), around[reach + 1 :].min(1)
    here = pair[reach : n - reach]
    return [found[i + reach].start() for i in np.flatnonzero((here < before) & (here <= behind))]


def pieces(text: str, min_piece: int = MIN_PIECE, max_piece: int = MAX_PIECE) -> list[list[str]]:
    """The pieces of each line; joined they are the line again."""
    out = []
    for line in text.split("\n"):
        found, start, n = [], 0, 0
        last = 0
        for m in _END.finditer(line):
            n += len(line[last : m.end()].split())
            last = m.end()
            if n >= min_piece:
                found.append(line[start:last])
                start, n = last, 0
        if start < len(line) or not found:
            found.append(line[start:])
        out.append([x for p in found for x in (_cut(p) if len(p) > 2 * max_piece and len(p.split()) > max_piece else [p])])
    return out


def _cut(sentence: str) -> list[str]:
    at = [0, *cuts(sentence), len(sentence)]
    return [sentence[a:b] for a, b in zip(at, at[1:], strict=False)]


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_piece: int = MIN_PIECE, min_banded: int = MIN_BANDED, similarity: float = SIMILARITY) -> DataFrame:
    """A written table of pieces: rid (unique, ascending by one within a document), doc (a number, other than that of the
    documents beside it), id, line, piece, n_words, key (null for an empty piece), bands (see least_shingles), size (of the set
    of shingles), text (bands, size and text of signed ones)."""
    narrow = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    frequent = frequent_shingles(narrow, min_piece)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, chunk in shingles.chunks(texts):
                parts = [pieces(t, min_piece) for t in chunk]
                flat = [p for lines in parts for line in lines for p in line]
                line = [k for lines in parts for k, x in enumerate(lines) for _ in x]
                piece = [k for lines in parts for x in lines for k in range(len(x))]
                counts = [sum(map(len, lines)) for lines in parts]
                words, offsets = shingles.word_hashes(flat)
                n = np.diff(offsets)
                keys = [shingles.content_key(words[offsets[i] : offsets[i + 1]], p.strip()) if p.strip() else None for i, p in enumerate(flat)]
                hashes, starts = shingles.shingles(words, offsets)
                banded = n >= min_banded
                inside = np.repeat(banded, np.diff(starts))
                values, ends, size = least_shingles(hashes[inside], np.append(0, np.cumsum(np.where(banded, np.diff(starts), 0))), similarity, frequent)
                owner = np.repeat(np.arange(len(chunk)), counts)
                ids = batch.column("id").slice(first, len(chunk)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done + owner, pa.int64()), ids, pa.array(line, pa.int32()), pa.array(piece, pa.int32()), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), pa.array(size, pa.int32()), pa.array([p if b else None for p, b in zip(flat, banded, strict=True)], pa.string())],
                    ["doc", "id", "line", "piece", "n_words", "key", "bands", "size", "text"],
                )
                done += len(chunk)

    out = narrow.mapInArrow(trimmed(sign), f"doc long, id {kind}, line int, piece int, n_words int, key binary, bands array<long>, size int, text string")
    return written(out.withColumn("rid", F.monotonically_increasing_id()), "paragraphs")


def paragraph_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, min_piece: int = MIN_PIECE, min_banded: int = MIN_BANDED, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """One row per piece: id, line, piece, n_words, class_id, class_line and class_piece (those of the piece that stays), removed."""
    items = prepared(docs, id_col, text_col, min_piece, min_banded, similarity)
    place = ["id", "line", "piece"]
    columns = ["rid", "doc", *place, "n_words"]
    found = near_dup.near_classes(items.where("key IS NOT NULL"), near_dup.Measure(distinct_shingles, near_dup.jaccard, similarity, sets=True, pairs=jaccards), join_spread)
    found, empty = written(found.select(*columns, "root"), "class_rows"), written(items.where("key IS NULL").select(*columns), "empty_rows")
    discard(items)
    heads = written(near_dup.with_heads(found.where("root IS NOT NULL"), place, join_spread).select(*columns, "head"), "head_rows")
    # rows are numbered in order, so a run of copies is one of consecutive numbers in a document
    of = Window.partitionBy(F.shiftright("rid", 33), "doc").orderBy("rid")
    copies = heads.where(F.col("rid") != F.col("head.rid")).withColumn("run", F.col("rid") - F.row_number().over(of))
    copies = copies.withColumn("removed", F.sum("n_words").over(Window.partitionBy(F.shiftright("rid", 33), "doc", "run")) >= min_passage).drop("run")
    alone = empty.unionByName(found.where("root IS NULL").drop("root")).withColumn("head", F.struct(*place, "rid"))
    rows = alone.unionByName(heads.where(F.col("rid") == F.col("head.rid")).select(*columns, "head")).withColumn("removed", F.lit(False))
    rows = rows.unionByName(copies.select(*columns, "head", "removed"))
    return rows.select(F.col("id").alias(id_col), "line", "piece", "n_words", F.col("head.id").alias("class_id"), F.col("head.line").alias("class_line"), F.col("head.piece").alias("class_piece"), "removed")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_piece: int = MIN_PIECE, **options) -> DataFrame:
    """id and the text left after removal (a line goes with all its pieces), a row for each row of docs with an id that no other row has."""
    found = paragraph_classes(docs, id_col, text_col, min_piece=min_piece, **options).where("removed")
    found = found.groupBy(F.col(id_col).alias("__tw_id")).agg(F.collect_set(F.struct("line", "piece")).alias("gone"))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(found, F.col("id").eqNullSafe(F.col("__tw_id")), "left").select("id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                drop = {(x["line"], x["piece"]) for x in gone or ()}
                lines = [(x, [p for j, p in enumerate(x) if (k, j) not in drop]) for k, x in enumerate(pieces(text, min_piece))]
                out.append("\n".join("".join(left) for x, left in lines if left or not x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(cut), f"id {kind}, text string").toDF(id_col, text_col)
