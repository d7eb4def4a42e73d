"""Sampled segmentation into SentencePiece pieces, and lossless decoding.

A text is taken as a lattice whose edges are the vocabulary's pieces; a segmentation is a path and its weight the product
of its pieces' weights to the power alpha. Forward filtering sums the weights of all paths to each character; backward
sampling then draws a piece at a time from the end in proportion to the weight of the paths through it. Draws come from a
hash of the row's key, the chunk and the step, so a row has the same segmentation in any run, batch or partition.

No piece reaches from a word into the space after it, so the lattice falls apart into chunks (spaces and the word that
follows; characters that no longer piece contains stand alone). Chunks that occur often are filtered once a batch.

The vocabulary's scores are ranks; a piece of rank r weighs 1 / (r + RANK_SHIFT). A space is written as U+2581 and one is put
before the text; a character without a piece, and U+2581 itself, is written as its UTF-8 bytes.

Rules: null text counts as empty, which is the one piece for the space before it; rows of one key have the same draws, and all
rows without an id have one key. A text of any length is one lattice. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import text_or_empty, trimmed
from .shingles import mixed, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANK_SHIFT = 10.0
#: Log weight of a character written as bytes, below that of any piece.
FALLBACK = -25.0
CHUNK_CHARS = 1 << 20
TABLE_CELLS = 1 << 20

_U = np.uint64
_SPACE, _LITERAL = 0x2581, 0x110000


@dataclass
class Vocabulary:
    """The pieces by id (None: not an ordinary piece), and the ids of the 256 byte pieces."""

    pieces: list[str | None]
    bytes_: list[int]
    longest: int = field(init=False)

    def __post_init__(self):
        ids = [i for i, p in enumerate(self.pieces) if p]
        self.longest = max(len(self.pieces[i]) for i in ids)
        flat = np.array([ord(c) for i in ids for c in self.pieces[i]], dtype=np.uint64)
        ends = np.cumsum([len(self.pieces[i]) for i in ids])
        self.ids = np.array(ids, dtype=np.int32)
        hashes = Ranges(flat)(ends - [len(self.pieces[i]) for i in ids], ends)
        rank = np.empty(len(ids))
        rank[np.argsort(self.ids, kind="stable")] = np.arange(len(ids))
        self.scores = -np.log(rank + RANK_SHIFT)
        for c in self.pieces:
            if c and _SPACE in map(ord, c.lstrip("▁")):
                raise ValueError("a piece holds a space after other characters")
        # two direct tables by different bits of the hash; the second takes what meets in the first
        self.hashes = np.append(hashes, 0)
        self.first = np.full(1 << 20, len(ids), dtype=np.int32)
        self.first[(hashes >> _U(44)).astype(np.int64)] = np.arange(len(ids))
        lost = np.flatnonzero(self.first[(hashes >> _U(44)).astype(np.int64)] != np.arange(len(ids)))
        self.second = np.full(1 << 20, len(ids), dtype=np.int32)
        self.second[(hashes[lost] >> _U(20) & _U((1 << 20) - 1)).astype(np.int64)] = lost
        if len(np.unique(hashes[lost] >> _U(20) & _U((1 << 20) - 1))) < len(lost):
            raise ValueError("pieces meet in both tables")
        self.weight = np.append(self.scores, -np.inf)
        self.id_of = np.append(self.ids, -1).astype(np.int32)
        #: characters that longer pieces hold, and those that are pieces
        self.joined = np.unique([ord(c) for i in ids if len(self.pieces[i]) > 1 for c in self.pieces[i]])
        self.single = np.unique([ord(self.pieces[i]) for i in ids if len(self.pieces[i]) == 1])
        # what decoding writes, by id
        out = [b""] * len(self.pieces)
        for i in ids:
            out[i] = self.pieces[i].replace("▁", " ").encode()
        for b, i in enumerate(self.bytes_):
            out[i] = bytes([b])
        self.out = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.out_size = np.array([len(x) for x in out], dtype=np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the pieces; their number where it is none."""
        at = self.first[(h >> _U(44)).astype(np.int64)]
        ok = self.hashes[at] == h
        other = self.second[(h >> _U(20) & _U((1 << 20) - 1)).astype(np.int64)]
        return np.where(ok, at, np.where(self.hashes[other] == h, other, len(self.ids)))


class Ranges:
    """Hashes of ranges of code points."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + _U(1)) * up[: len(codes)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read the model file on the driver; what executors need of it travels with the task."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    plain = [None if p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i) else p.id_to_piece(i) for i in range(n)]
    bytes_ = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary(plain, bytes_)


def _flags(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    table = np.zeros(0x110002, dtype=bool)
    table[values] = True
    return table[codes]


def filtered(v: Vocabulary, ranges: Ranges, codes: np.ndarray, begin: np.ndarray, size: int, lengths: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward filtering of chunks of up to size characters, sorted by length.

    Returns for each chunk, end and piece length: cumulative probability of the last pieces up to that length, and the
    piece (a code point above the ids: its bytes).
    """
    n, widest = len(begin), min(v.longest, size)
    total = np.full((n, size + 1), -np.inf)
    total[:, 0] = 0
    share = np.ones((n, size + 1, widest), dtype=np.float32)
    piece = np.full((n, size + 1, widest), -1, dtype=np.int32)
    fallback = ~_flags(v.single, codes)
    for i in range(1, size + 1):
        k = np.searchsorted(lengths, i)
        wide = min(i, widest)
        back = np.arange(1, wide + 1)
        end = (begin[k:] + i)[:, None]
        found = v.find(ranges(end - back, np.broadcast_to(end, (n - k, wide))))
        weight, ids = alpha * v.weight[found], v.id_of[found]
        last = codes[begin[k:] + i - 1]
        bare = fallback[begin[k:] + i - 1]
        weight[bare, 0] = alpha * FALLBACK
        ids[bare, 0] = len(v.pieces) + last[bare].astype(np.int64)
        reach = total[k:, i - wide : i][:, ::-1] + weight
        top = reach.max(axis=1, keepdims=True)
        parts = np.exp(reach - top)
        whole = np.cumsum(parts, axis=1)
        total[k:, i] = top[:, 0] + np.log(whole[:, -1])
        share[k:, i, :wide] = whole / whole[:, -1:]
        share[k:, i, wide - 1 :] = 2  # rounding never runs past the end
        usable = np.where(parts > 0, back, 0).max(axis=1)  # nor into a piece that is none
        share[k:, i][np.arange(1, widest + 1) >= usable[:, None]] = 2
        piece[k:, i, :wide] = ids
    return share, piece


def encode(v: Vocabulary, texts: list[str], seeds: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the offsets of each text's ids. seeds: an unsigned 64-bit key for each text."""
    raw = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = raw.copy()
    codes[raw == _SPACE] = _LITERAL
    codes[raw == 32] = _SPACE
    doc_at = np.cumsum([0] + [len(t) + 1 for t in texts])
    space, alone = codes == _SPACE, ~_flags(v.joined, codes)
    start = np.zeros(len(codes), dtype=bool)
    start[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    start[doc_at[:-1]] = True
    begin = np.flatnonzero(start)
    lengths = np.diff(np.append(begin, len(codes)))
    ranges = Ranges(codes)
    kind, _ = pd.factorize(ranges(begin, begin + lengths))
    n_kinds = int(kind.max()) + 1
    example = np.empty(n_kinds, dtype=np.int64)
    example[kind[::-1]] = np.arange(len(begin))[::-1]
    by_kind = np.argsort(kind, kind="stable")
    kind_at = np.append(0, np.cumsum(np.bincount(kind, minlength=n_kinds)))
    doc = np.searchsorted(doc_at, begin, "right") - 1
    nth = np.arange(len(begin)) - np.searchsorted(begin, doc_at[:-1])[doc]
    key = mixed(seeds[doc] + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    n_tokens = np.zeros(len(begin), dtype=np.int64)
    drawn: list[tuple[np.ndarray, int, np.ndarray]] = []

    order = np.argsort(lengths[example], kind="stable")
    size_of = lengths[example][order]
    at = 0
    while at < n_kinds:
        # kinds of about one length at a time, as many as fit the tables
        size = max(8, 1 << int(size_of[at] - 1).bit_length())
        stop = min(int(np.searchsorted(size_of, size, "right")), at + max(1, TABLE_CELLS // ((size + 1) * min(size, v.longest))))
        group = order[at:stop]
        size = int(size_of[stop - 1])
        share, piece = filtered(v, ranges, codes, begin[example[group]], size, size_of[at:stop], alpha)
        width = share.shape[2]
        share, piece = share.reshape(-1, width), piece.reshape(-1, width)
        uses = kind_at[group + 1] - kind_at[group]
        which = np.repeat(np.arange(len(group)), uses)
        who = by_kind[np.repeat(kind_at[group] - np.append(0, np.cumsum(uses)[:-1]), uses) + np.arange(uses.sum())]
        place, step = lengths[who], 0
        while len(who):
            u = (mixed(key[who] + _U(step + 1)) >> _U(40)).astype(np.float32) * np.float32(2.0**-24)
            cell = which * (size + 1) + place
            back = (share[cell] <= u[:, None]).sum(axis=1)
            drawn.append((who, step, piece[cell, back]))
            n_tokens[who] += 1
            place = place - back - 1
            rest = place > 0
            who, which, place, step = who[rest], which[rest], place[rest], step + 1
        at = stop
    ends = np.cumsum(n_tokens)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    for who, step, piece in drawn:
        ids[ends[who] - 1 - step] = piece
    counts = np.diff(np.append(0, ends)[np.searchsorted(begin, doc_at)])
    wide = ids >= len(v.pieces)
    if wide.any():
        bytes_of = {int(c): np.array([v.bytes_[b] for b in (chr(_SPACE) if c == _LITERAL else chr(c)).encode("utf-8", "surrogatepass")]) for c in np.unique(ids[wide] - len(v.pieces))}
        size_of_id = np.ones(len(ids), dtype=np.int64)
        chars, place_of = np.unique(ids[wide] - len(v.pieces), return_inverse=True)
        many = np.array([len(bytes_of[int(c)]) for c in chars])
        size_of_id[wide] = many[place_of]
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner, size_of_id, minlength=len(counts)).astype(np.int64)
        out = np.repeat(ids, size_of_id)
        head = np.cumsum(size_of_id) - size_of_id
        for b in range(int(many.max())):
            has = many[place_of] > b
            table = np.array([bytes_of[int(c)][b] if len(bytes_of[int(c)]) > b else -1 for c in chars])
            out[head[wide][has] + b] = table[place_of[has]]
        ids = out
    return ids.astype(np.int32), np.append(0, np.cumsum(counts))


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The UTF-8 of each text."""
    size = v.out_size[ids]
    ends = np.cumsum(size)
    flat = v.out[np.repeat(v.out_at[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
    at = np.append(0, ends)[offsets]
    return [flat[a + 1 : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None, alpha: float = 1.0, seed: int = 0, copy_col: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Per row: id, n_chars, n_tokens, ids array<int>, decoded_sha256 (of the ids decoded again), lossless, and the columns of carry.

    The row's key is its id, with copy_col its id and the number of its copy (0 draws as without).
    """
    v = vocabulary or read_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(v)
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    if copy_col:
        key = F.when(F.col(copy_col) == 0, key).otherwise(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed), F.col(copy_col)))
    narrow = docs.select(F.col(id_col).alias("id"), key.alias("seed"), text_or_empty(text_col).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for first, chunk in shingles.chunks(texts, CHUNK_CHARS):
                ids, offsets = encode(vocabulary, chunk, seeds[first : first + len(chunk)], alpha)
                back = decode(vocabulary, ids, offsets)
                same = [b == t.encode("utf-8", "surrogatepass") for b, t in zip(back, chunk, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(chunk)),
                        pa.array([len(t) for t in chunk], pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                        pa.array(same, pa.bool_()),
                        *[batch.column(f"carry_{c}").slice(first, len(chunk)) for c in carry],
                    ],
                    ["id", "n_chars", "n_tokens", "ids", "decoded_sha256", "lossless", *[f"carry_{c}" for c in carry]],
                )

    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(trimmed(run), f"id {kind}, n_chars long, n_tokens long, ids array<int>, decoded_sha256 string, lossless boolean" + "".join(f", carry_{c} {narrow.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry))
    return out.withColumnsRenamed({"id": id_col} | {f"carry_{c}": c for c in carry})


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """id and text of rows that encode_documents made."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = [len(x) if x.is_valid else 0 for x in lists]
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            back = decode(shared.value, ids, np.append(0, np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([b.decode("utf-8", "surrogatepass") for b in back])], ["id", "text"])

    narrow = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(trimmed(run), f"id {kind}, text string").withColumnRenamed("id", id_col)
