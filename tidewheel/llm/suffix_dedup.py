"""Removal of every byte that lies in a long string which also starts elsewhere, by bounded interval expansion on a BWT.

Anchors. Each window of min_len bytes names one of its ANCHOR-byte strings, the one of the smallest hash (the leftmost of
equals), so equal windows name it at the same place. The windows that name an anchor follow each other; what they cover is
its region. A window that starts elsewhere too is thus found by comparing regions of equal anchors at equal offsets, and
nothing else has to meet in a task.

Groups. Anchors are grouped by hash. A region that occurs twice as a whole is repeated as a whole: counting digests
settles it. Where a group has different regions, one of each goes to the suffix machinery: the Burrows-Wheeler transform
of all regions of some groups is built, and breadth-first backward extension of intervals finds the boundaries with
common prefixes of 0, 1, 2 .. min_len - 1 bytes. What has no boundary then agrees in min_len bytes at least.

Groups of more than most_regions different regions are not put in one task: their windows are counted by digest
instead, in DataFrame operations, with the same result.

Rules: null text counts as empty; a text shorter than min_len loses nothing; rows repeated in full repeat each other; ids are only
carried along (null ones too). A text of any length is one row, scanned at once. No rows give no rows. Other columns are ignored. Equality of regions rests on two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, text_or_empty, trimmed, written
from .shingles import mixed, powers

MIN_LEN = 200
ANCHOR = 48
MOST_REGIONS = 16_384
PIECE = 1 << 20
BUNDLE = 1 << 20

_U = np.uint64
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) << _U(1) | _U(1)


class RangeHash:
    """Hashes of byte ranges by differences of a running sum."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[raw] * up[: len(raw)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(hashes: np.ndarray, begin: np.ndarray, stop: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows within the texts [begin, stop): each anchor's position, and the first and last window that name it.
    hashes are those of all ANCHOR-byte strings."""
    width, n = min_len - ANCHOR + 1, len(hashes)
    if n < width:
        return (np.zeros(0, dtype=np.int64),) * 3
    low = _U((1 << 24) - 1)
    found = []
    step = 1 << 21
    for at in range(0, n - width + 1, step):
        part = hashes[at : at + step + width - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        rows = -(-len(key) // width)
        padded = np.full(rows * width, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        padded[: len(key)] = key
        padded = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(key) - width + 1
        named = (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64)
        inside = np.zeros(m + 1, dtype=np.int32)
        first, last = np.clip(begin - at, 0, m), np.clip(stop - min_len + 1 - at, 0, m)
        some = last > first
        np.add.at(inside, first[some], 1)
        np.add.at(inside, last[some], -1)
        valid = np.flatnonzero(np.cumsum(inside[:m]) > 0)
        if not len(valid):
            continue
        named = named[valid]
        new = np.append(True, (named[1:] != named[:-1]) | (valid[1:] != valid[:-1] + 1))
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(valid)) - 1
        found.append((at + named[starts], at + valid[starts], at + valid[ends]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


def scan(texts: list[bytes], min_len: int = MIN_LEN) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk of texts: index of the first, offsets of each text's anchors, their hashes, digests of regions, places.

    A place holds the start of the region (from bit 16), the anchor's distance from it and the windows after the first.
    """
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size < PIECE and i + 1 < len(texts):
            continue
        chunk = texts[first : i + 1]
        raw = np.frombuffer(b"".join(chunk), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in chunk])
        begin = ends - [len(x) for x in chunk]
        ranges = RangeHash(raw)
        all_at = np.arange(max(len(raw) - ANCHOR + 1, 0))
        hashes = ranges(all_at, all_at + ANCHOR)
        at, low, high = anchors(hashes, begin, ends, min_len)
        owner = np.searchsorted(ends, at, "right")
        digest = mixed(ranges(low, high + min_len) + (at - low).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        place = (low - begin[owner]) << 16 | (at - low) << 8 | (high - low)
        yield first, np.searchsorted(owner, np.arange(len(chunk) + 1)), hashes[at].view(np.int64), digest.view(np.int64), place
        first, size = i + 1, 0


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a text of bytes sorted by their first depth bytes at least: by eight bytes, then by three ranks at a time."""
    n = len(text)
    if n >= 1 << 21:
        bits, times = 32, 2
    else:
        bits, times = 21, 3
    wide = np.zeros(n + 8, dtype=np.uint64)
    wide[:n] = text
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = key << _U(8) | wide[i : n + i]
    known = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        if known >= depth or fresh.all():
            return order
        rank = np.zeros(n, dtype=np.uint64)
        rank[order] = np.cumsum(fresh)
        key = rank.copy()
        for i in range(1, times):
            key <<= _U(bits)
            key[: max(n - i * known, 0)] |= rank[i * known :]
        known *= times


def boundaries(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """For each place in the suffix order the length of the prefix shared with the suffix before it, if below bound, else bound.

    Breadth-first: an interval of suffixes that start with w is extended to those of cw for each symbol c before it; the
    end of a new interval is a boundary of value |w|, and only intervals with a new end are extended in turn.
    """
    n = len(text)
    bwt = text[order - 1]  # bytes, so the stable sort below is a counting sort
    by_symbol = np.argsort(bwt, kind="stable")
    to = np.empty(n, dtype=np.int64)
    to[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after, before = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    shared = np.full(n + 1, bound, dtype=np.int32)
    shared[0] = shared[n] = 0
    open_ = np.ones(n + 1, dtype=bool)
    open_[0] = False
    low, high = np.array([0]), np.array([n])
    for length in range(bound):
        size = high - low
        if not len(size):
            break
        rows = np.repeat(low - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        first = to[rows[before[rows] < np.repeat(low, size)]]
        last = to[rows[after[rows] >= np.repeat(high, size)]] + 1
        first.sort()
        last.sort()
        new = open_[last]
        low, high = first[new], last[new]
        open_[high] = False
        shared[high] = np.where(high == n, 0, length)
    return shared[:n]


def repeated(regions: list[bytes], groups: np.ndarray, left: np.ndarray, min_len: int = MIN_LEN) -> list[list[tuple[int, int]]]:
    """For each region the ranges covered by strings of min_len that another region of its group has at the same offset from the anchor."""
    sizes = np.array([len(r) for r in regions])
    # 0xff is in no UTF-8 text; windows that reach it are left out below
    text = np.frombuffer(b"\xff".join([*regions, b""]), dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    order = suffix_order(text, min_len)
    number = np.cumsum(boundaries(text, order, min_len) < min_len)
    begin = ends - sizes
    owner = np.repeat(np.arange(len(regions)), sizes + 1)[order]
    start = order - begin[owner]
    rows = np.flatnonzero(start + min_len <= sizes[owner])
    owner, start, number = owner[rows], start[rows], number[rows]
    offset = start - left[owner]
    group = np.unique(groups, return_inverse=True)[1][owner]
    spread = int(offset.max(initial=0)) - int(offset.min(initial=0)) + 1
    key = (number.astype(np.int64) * (int(group.max(initial=0)) + 1) + group) * spread + (offset - offset.min(initial=0))
    by = np.argsort(key, kind="stable")
    tie = np.diff(key[by]) == 0
    hit = by[np.append(tie, False) | np.append(False, tie)]
    out: list[list[tuple[int, int]]] = [[] for _ in regions]
    for r, s in sorted(zip(owner[hit].tolist(), start[hit].tolist(), strict=True)):
        if out[r] and s <= out[r][-1][1]:
            out[r][-1] = (out[r][-1][0], s + min_len)
        else:
            out[r].append((s, s + min_len))
    return out


def scanned(docs: DataFrame, id_col: str, text_col: str, min_len: int) -> DataFrame:
    """A written table: rid (unique), id, n_bytes, sha256, packed text, anchors."""
    narrow = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for first, offsets, h, g, at in scan(texts, min_len):
                part = texts[first : first + len(offsets) - 1]
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v)) for v in (h, g, at.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(part)), pa.array([len(t) for t in part], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in part]), pa.array([pack(t) for t in part]), *lists],
                    ["id", "n_bytes", "sha", "packed", "h", "g", "at"],
                )

    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(trimmed(run), f"id {kind}, n_bytes long, sha string, packed binary, h array<long>, g array<long>, at array<long>")
    return written(out.withColumn("rid", F.monotonically_increasing_id()), "scanned")


def region_rows(texts: DataFrame, wanted: DataFrame, min_len: int) -> DataFrame:
    """wanted: rid, at (a place), h, n, of. Returns of each its region: rid, at (its start), h, n, of, left, region."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("at", "h", "n", "of")).alias("w"))
    rows = texts.select("rid", "packed").join(lists, "rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("rid", "at", "h", "n", "of", "left", "region")}
            for i, rid in enumerate(batch.column("rid").to_pylist()):
                text = unpack(batch.column("packed")[i].as_py())
                for w in batch.column("w")[i].as_py():
                    begin, left, more = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                    for k, v in (("rid", rid), ("at", begin), ("h", w["h"]), ("n", w["n"]), ("of", w["of"]), ("left", left), ("region", text[begin : begin + more + min_len])):
                        out[k].append(v)
                if len(out["rid"]) >= 20_000:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out = {k: [] for k in out}
            yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("of", pa.int64()), ("left", pa.int64()), ("region", pa.binary())])
    return rows.mapInArrow(trimmed(cut), "rid long, at long, h long, n long, of long, left long, region binary")


def by_intervals(regions: DataFrame, min_len: int) -> DataFrame:
    """Ranges rid, s, e covered in regions that occur once, from the other regions of their groups; a group is within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.array([x[0] for x in held], dtype=np.int64)
            left = np.array([x[3] for x in held], dtype=np.int64)
            found = repeated([x[4] for x in held], h, left, min_len)
            flat = [(x[1], x[2] + s, x[2] + e) for x, ranges in zip(held, found, strict=True) if x[5] == 1 for s, e in ranges]
            columns = list(zip(*flat, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rid", "s", "e"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "rid", "at", "left", "region", "n")), strict=True):
                if held and row[0] != held[-1][0] and size >= BUNDLE:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    return regions.repartition("h").sortWithinPartitions("h").mapInArrow(trimmed(run), "rid long, s long, e long")


def by_windows(regions: DataFrame, min_len: int) -> DataFrame:
    """The same ranges from digests of windows, counted by anchor and offset: for groups of any size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, rid, at, left, region, n = (batch.column(c).to_pylist() for c in ("h", "rid", "at", "left", "region", "n"))
            for i in range(len(h)):
                starts = np.arange(max(len(region[i]) - min_len + 1, 0))
                digest = RangeHash(np.frombuffer(region[i], dtype=np.uint8))(starts, starts + min_len).view(np.int64)
                same = lambda v: pa.array(np.full(len(starts), v))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(h[i]), pa.array(starts - left[i]), pa.array(digest), same(rid[i]), pa.array(at[i] + starts), same(n[i])], ["h", "o", "d", "rid", "at", "n"])

    rows = written(regions.mapInArrow(trimmed(cut), "h long, o long, d long, rid long, at long, n long"), "windows")
    often = written(rows.groupBy("h", "o", "d").agg(F.count("*").alias("times")).where("times > 1").drop("times"), "often")
    return rows.where("n = 1").join(often, ["h", "o", "d"]).select("rid", F.col("at").alias("s"), (F.col("at") + min_len).alias("e"))


def covered(texts: DataFrame, min_len: int = MIN_LEN, most_regions: int = MOST_REGIONS) -> DataFrame:
    """Ranges rid, s, e of repeated bytes in the texts of scanned(); they overlap."""
    every = texts.select("rid", F.explode(F.arrays_zip("h", "g", "at")).alias("x")).select("rid", "x.h", "x.g", "x.at")
    groups = every.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select("h", (F.col("lo") != F.col("hi")).alias("differ"), "n"), "groups")
    often = written(join_hot(every, groups, "h", "n").drop("n"), "often")
    discard(groups)
    start = F.shiftright("at", 16)
    reach = [start.alias("s"), (start + F.col("at").bitwiseAND(255) + min_len).alias("e")]
    whole = often.where("NOT differ").select("rid", *reach)
    kinds = written(often.where("differ").groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("x")), "kinds")
    whole = whole.unionByName(join_hot(often.where("differ"), kinds.where("n > 1").select("h", "g", "n"), ["h", "g"], "n").select("rid", *reach))
    many = written(kinds.groupBy("h").agg(F.count("*").alias("of")), "many")
    wanted = kinds.join(many, "h").select("x.rid", "x.at", "h", "n", "of")
    parts = by_intervals(region_rows(texts, wanted.where(F.col("of") <= most_regions), min_len), min_len)
    if not many.where(F.col("of") > most_regions).isEmpty():
        parts = parts.unionByName(by_windows(region_rows(texts, wanted.where(F.col("of") > most_regions), min_len), min_len))
    return whole.unionByName(parts)


def cut_out(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of text, and the removed runs."""
    runs: list[tuple[int, int]] = []
    for s, e in sorted((max(0, s), min(len(text), e)) for s, e in ranges):
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
        else:
            runs.append((s, e))
    left, at = [], 0
    for s, e in runs:
        left.append(text[at:s])
        at = e
    return b"".join([*left, text[at:]]), runs


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, most_regions: int = MOST_REGIONS, with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<s,e>>; with_text adds kept, the remaining bytes."""
    if not ANCHOR < min_len <= ANCHOR + 255:  # a place holds distances below 256
        raise ValueError(f"min_len is {min_len}; it must be over {ANCHOR} and at most {ANCHOR + 255}")
    texts = scanned(docs, id_col, text_col, min_len)
    ranges = covered(texts, min_len, most_regions).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    rows = texts.select("rid", "id", "n_bytes", "sha", "packed").join(ranges, "rid", "left").drop("rid")
    kind = rows.schema["id"].dataType.simpleString()
    pairs = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sha, n_removed, spans, kept = batch.column("sha").to_pylist(), [], [], []
            for i in range(len(batch)):
                found = batch.column("ranges")[i]
                if not found.is_valid and not with_text:
                    n_removed.append(0)
                    spans.append([])
                    continue
                left, runs = cut_out(unpack(batch.column("packed")[i].as_py()), [(x["s"], x["e"]) for x in found.as_py() or ()])
                sha[i] = hashlib.sha256(left).hexdigest()
                n_removed.append(sum(e - s for s, e in runs))
                spans.append([{"s": s, "e": e} for s, e in runs])
                kept.append(left)
            columns = {"id": batch.column("id"), "n_bytes": batch.column("n_bytes"), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()), "kept_sha256": pa.array(sha), "spans": pa.array(spans, pairs)}
            if with_text:
                columns["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>" + ", kept binary" * with_text
    return rows.mapInArrow(trimmed(run), schema).withColumnRenamed("id", id_col)
