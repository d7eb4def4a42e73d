"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All texts are walked by the same random walk over characters: at step j the walk writes the character under its pointer
and moves on by one if a random bit of (j, character) says so. Two texts that differ by few edits drift apart at an edit
and meet again soon after, so their walks agree nearly everywhere. What is written at a step is a 4-bit hash of the four
characters from the pointer on.

A fingerprint samples the walk on a grid: 2^L is the smallest power that holds 3 steps a character, and SLOTS steps,
2^L / SLOTS apart, are kept until the walk has left the text. Grids of different L are nested, so fingerprints of texts of
different length are compared on the coarser grid. Likeness is the share of agreeing slots, less what chance agrees on.

Near pairs come from bands of sampled slots on the own grid and the next coarser one, verified by the edit distance.

Rules: null text counts as empty; the fingerprint of an empty text is its level alone and it is like no text but an empty one;
rows of one id are ordered by their text; null ids come first. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dup
from .common import shuffle_partitions, text_or_empty, trimmed, written
from .shingles import mixed

SLOTS = 256
#: A band samples its slots within a stretch of the grid, which walks that met again agree on.
BANDS, PER_BAND, STRETCH = 32, 5, 16
SIMILARITY = 0.8
CHUNK_CHARS = 1 << 23

_U = np.uint64
_PAD = 64
_STEPS = 4096
_HEX = "0123456789abcdef"
_SLOTS_OF = np.stack([b * (SLOTS // 3 - STRETCH) // (BANDS - 1) + np.random.default_rng(100 + b).choice(STRETCH, PER_BAND, replace=False) for b in range(BANDS)])


def level_of(n_chars: int) -> int:
    return max(8, (3 * n_chars - 1).bit_length() if n_chars else 0)


def _bits(block: int) -> np.ndarray:
    """Random bits of steps block * _STEPS and on, a row a step and a column a character class; the walk rests on padding."""
    at = np.arange(block * _STEPS, (block + 1) * _STEPS, dtype=np.uint64)
    out = np.zeros((_STEPS, _PAD + 1), dtype=np.int64)
    out[:, :_PAD] = np.unpackbits(mixed(at + _U(0x2545F4914F6CDD1D)).view(np.uint8).reshape(_STEPS, 8), axis=1)
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: two hex digits of its level and a hex digit for each slot."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer("".join(t + "\0\0\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    begin = np.cumsum(np.append(0, length + 4))[:-1]
    kind = ((raw * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8)
    kind[(begin + length)] = _PAD
    symbol = np.zeros(len(raw), dtype=np.uint32)
    for d, k in enumerate((0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)):
        symbol[: len(raw) - d] += raw[d:] * np.uint32(k)
    symbol = (((symbol ^ (symbol >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(28)).astype(np.uint8)
    levels = np.array([level_of(int(n)) for n in length], dtype=np.int64)
    out = np.full((len(texts), SLOTS), 255, dtype=np.uint8)
    bits: dict[int, np.ndarray] = {}
    for level in np.unique(levels):
        who = np.flatnonzero((levels == level) & (length > 0))
        at, stop, gap = begin[who].copy(), (begin + length)[who], (1 << int(level)) // SLOTS
        for slot in range(SLOTS):
            inside = at < stop
            if not inside.all():
                who, at, stop = who[inside], at[inside], stop[inside]
            if not len(who):
                break
            out[who, slot] = symbol[at]
            here, move = np.empty(len(at), dtype=np.uint8), np.empty(len(at), dtype=np.int64)
            for j in range(slot * gap, (slot + 1) * gap):
                block, row = divmod(j, _STEPS)
                if block not in bits:
                    if len(bits) >= 32:
                        bits.pop(next(iter(bits)))
                    bits[block] = _bits(block)
                np.take(kind, at, out=here, mode="clip")
                np.take(bits[block][row], here, out=move, mode="clip")
                at += move
    used = (out < 255).sum(axis=1)
    digits = np.frombuffer(_HEX.encode(), dtype=np.uint8)[np.minimum(out, 15)]
    return [f"{level:02x}" + digits[i, : used[i]].tobytes().decode() for i, level in enumerate(levels)]


def likeness(a: str, b: str) -> float:
    """0 to 1: agreeing slots on the coarser of the two grids, less chance agreement."""
    x, y = int(a[:2], 16), int(b[:2], 16)
    a, b = a[2 :: 1 << max(0, y - x)], b[2 :: 1 << max(0, x - y)]
    if not a and not b:
        return 1.0
    agree = sum(p == q for p, q in zip(a, b, strict=False)) / max(len(a), len(b))
    return max(0.0, (agree - 1 / 16) / (1 - 1 / 16))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, extra, id, text), sorted by id within a part and parts in order of id; the extra rows of a part are
    the first rows of the next one (of the last part: of the first). Texts are shuffled once.

    Parts are cut at quantiles of the id; the driver holds two ids for each part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    n = shuffle_partitions(spark)
    cuts = np.unique(rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)) if n > 1 else np.zeros(0)
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(shared.value, ids.to_numpy(dtype=float, na_value=0), "right"))).astype("int32")

    rows = rows.withColumn("part", part("id"))
    first = sorted(tuple(r) for r in rows.groupBy("part").agg(F.when(F.max(F.col("id").isNull()), F.lit(None)).otherwise(F.min("id")).alias("first")).collect())
    before = {p: first[i - 1][0] for i, (p, _) in enumerate(first)}
    heads = spark.createDataFrame([(p, f, before[p]) for p, f in first], f"p int, first {rows.schema['id'].dataType.simpleString()}, before int")
    rows = rows.join(F.broadcast(heads), F.col("part") == F.col("p"))
    also = F.when(F.col("id").eqNullSafe(F.col("first")), F.array(F.struct(F.col("before").alias("part"), F.lit(1).alias("extra")))).otherwise(F.array().cast("array<struct<part:int,extra:int>>"))
    rows = rows.withColumn("to", F.explode(F.concat(F.array(F.struct(F.col("part"), F.lit(0).alias("extra"))), also)))
    rows = rows.select("to.part", "to.extra", "id", "text")
    return rows.repartitionById(max(len(first), 1), F.col("part")).sortWithinPartitions("part", "extra", "id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = in_order(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    arrow_kind = pa.int64() if kind == "bigint" else None

    def finish(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, [*texts[1:], following], strict=True)]
        prints = fingerprints([*texts, following, *changed])
        own, after, other = prints[: len(ids)], prints[1 : len(ids) + 1], prints[len(ids) + 1 :]
        columns = {
            id_col: pa.array(ids, arrow_kind),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            "fingerprint": pa.array(own),
            "edited_fingerprint": pa.array(other),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)]),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)]),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, now = 0, None
        for batch in batches:
            for p, extra, i, t in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "id", "text")), strict=True):
                if p != now and texts:
                    raise AssertionError("a part ends with its extra rows")
                if extra:  # only the first extra row finds rows that wait
                    if texts:
                        yield finish(ids, texts, t)
                        ids, texts, size = [], [], 0
                    continue
                if size >= CHUNK_CHARS:
                    yield finish(ids, texts, t)
                    ids, texts, size = [], [], 0
                now = p
                ids.append(i)
                texts.append(t)
                size += len(t)

    return rows.mapInArrow(trimmed(walk), f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def bands_of(fingerprint: str) -> list[int]:
    """Band keys on the fingerprint's grid and on the next coarser one."""
    level, digits = int(fingerprint[:2], 16), fingerprint[2:]
    out = []
    for up in (0, 1):
        at = digits[:: 1 << up]
        for b in range(BANDS):
            key = "".join(at[s] if s < len(at) else "-" for s in _SLOTS_OF[b])
            if key.strip("-"):
                out.append(int.from_bytes(hashlib.blake2b(f"{level + up}/{b}/{key}".encode(), digest_size=8).digest(), "little", signed=True))
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of an integer."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for c in b:
        match = at.get(c, 0)
        across = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(across | up) & full, up & across
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(across | rise) & full, rise & across
    return distance


def edit_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    return 1 - edit_distance(a, b) / longest


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, class_id, kept: classes of texts whose edit distance is at most 1 - similarity of the longer one, over band matches."""
    narrow = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            bands = [bands_of(f) for f in fingerprints(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column("text")], ["id", "key", "bands", "text"])

    items = narrow.mapInArrow(trimmed(sign), f"id {kind}, key binary, bands array<long>, text string").withColumn("rid", F.monotonically_increasing_id())

    measure = near_dup.Measure(lambda t: t, edit_similarity, similarity)
    found = written(near_dup.near_classes(written(items, "items"), measure).select("rid", "id", F.coalesce("root", "rid").alias("root")), "class_rows")
    found = near_dup.with_heads(found, ["id"])
    return found.select(F.col("id").alias(id_col), F.col("head.id").alias("class_id"), (F.col("rid") == F.col("head.rid")).alias("kept"))
