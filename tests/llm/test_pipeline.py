"""The pipeline against a brute-force version, its parts of the contract, and odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewheel.llm import mixing, near_dup, sampled_pieces, shingles, toxicity
from tidewheel.llm.common import written

from .test_dedup import classes_of

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = dict(zip(rows, model.score([r.text or "" for r in rows.values()]), strict=True))
    left = {i: r for i, r in rows.items() if score[i] < 0.5}
    by_text = {}
    for i, r in sorted(left.items()):
        by_text[r.text or ""] = i
    left = {i: left[i] for i in by_text.values()}
    order = sorted(left)
    sets = [shingles.counted(left[i].text or "") for i in order]
    words = [shingles.word_hashes([left[i].text or ""])[0].tobytes() for i in order]
    links = [(a, b) for a in range(len(order)) for b in range(a) if words[a] and words[a] == words[b] or len(sets[a][0]) and len(sets[b][0]) and near_dup.probability_jaccard(sets[a], sets[b]) >= 0.8]
    classes = classes_of(len(order), links)

    got = docs
    sizes = []
    for name, stage in P.STAGES[:3]:
        got = stage(spark, got, SF)
        assert got.columns == docs.columns, name
        got = spark.createDataFrame(got.collect(), docs.schema)
        sizes.append({r.doc_id for r in got.collect()})
    assert sizes[0] == {i for i in rows if score[i] < 0.5} and sizes[1] == set(left)
    place = {i: n for n, i in enumerate(order)}
    assert sorted(classes[place[i]] for i in sizes[2]) == sorted(set(classes))

    mixed = P.mix_sources(spark, got, SF)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert taken == {r.doc_id: r.copies for r in mixing.assign(got).collect() if r.copies}
    kept = written(mixed, "mixed")
    pieces = P.sample_pieces(spark, kept, SF).collect()
    assert len(pieces) == sum(taken.values())
    # the training order is that of the positions, and copies differ
    want = sorted((p, r.doc_id) for r in mixing.assign(got).collect() for p in r.positions)
    assert [r.doc_id for r in sorted(pieces, key=lambda r: (r.part, r.row))] == [i for _, i in want]
    assert [(r.part, r.row) for r in pieces] == sorted((r.part, r.row) for r in pieces)
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert all([r.copy for r in x] == list(range(len(x))) for x in by_doc.values())
    more = [x for x in by_doc.values() if len(x) > 1 and x[0].n_chars > 100]
    assert more and all(x[0].ids != x[1].ids for x in more)
    for r in pieces:
        assert r.lossless and r.decoded_sha256 == hashlib.sha256((rows[r.doc_id].text or "").encode()).hexdigest()


def brute_mix(rows):
    """doc_id, text, source -> target by source, copies by doc_id: shares by filling up, passes by walking along."""
    import re

    size = {i: len(re.findall(mixing.WORD, t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    whole = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    total, full, open_ = sum(whole.values()), {}, set(sources)
    while True:
        level = (total - sum(full.values())) / max(sum(weight[s] for s in open_), 1)
        over = {s for s in open_ if level * weight[s] > 3 * whole[s]}
        if not over:
            break
        full |= {s: 3 * whole[s] for s in over}
        open_ -= over
    target = {s: full.get(s, level * weight[s]) for s in sources}
    copies = {}
    for s in sources:
        order = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, x in rows if x == s)
        at = 0
        for _ in range(3):
            for _, i in order:
                copies[i] = copies.get(i, 0) + (at + size[i] / 2 <= target[s])
                at += size[i]
    return target, copies, size


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, None if i % 31 == 0 else "w " * int(rng.integers(0, 50)), None if s == 6 else f"s{s}") for i, s in enumerate(rng.choice(7, 500, p=[0.4, 0.3, 0.02, 0.02, 0.16, 0.05, 0.05]).tolist())]
    df = spark.createDataFrame([(*r, "a", 1.5) for r in rows], "doc_id long, text string, source string, key string, size double")
    target, copies, size = brute_mix(rows)
    got = {r.doc_id: r for r in mixing.assign(df).collect()}
    assert len(got) == len(rows)
    for i, _, s in rows:
        assert got[i].size == size[i] and got[i].target == pytest.approx(target[s]) and got[i].copies == copies[i]
        assert all(0 <= p <= 1 for p in got[i].positions)
    for s, t in target.items():
        own = [i for i, _, x in rows if x == s]
        assert abs(sum(copies[i] * size[i] for i in own) - t) <= max(size[i] for i in own) / 2 + 1e-6


def test_demand_is_the_integral_of_the_schedule(spark):
    knots = ((0.0, 0.0), (0.3, 2.0), (0.5, 2.0), (1.0, 0.1))
    df = spark.createDataFrame([(i, "w", "s") for i in range(200)], "doc_id long, text string, source string")
    at = np.array(sorted(p for r in mixing.assign(df, weights=(1,), schedules=(knots,)).collect() for p in r.positions))
    t, w = (np.array(x) for x in zip(*knots, strict=True))
    fine = np.linspace(0, 1, 200_001)
    demand = np.cumsum(np.interp(fine, t, w))
    assert len(at) == 200 and np.interp(at, fine, demand / demand[-1]) == pytest.approx((np.arange(200) + 0.5) / 200, abs=1e-4)


def test_mix_keeps_clashing_columns_and_order(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 9, f"s{i % 2}", "k", 7, 1) for i in range(40)] + [(None, "x", None, "k", 7, 1)] * 2, "doc_id long, text string, source string, key string, size int, positions int")
    got = mixing.mix(df)
    assert got.columns == df.columns
    copies = {r.doc_id: r.copies for r in mixing.assign(df).collect()}
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect() if r.doc_id is not None} == {i: c for i, c in copies.items() if c and i is not None}
    assert mixing.assign(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_stages_take_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c", None, None, 5), (3, "x" * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash")).withColumn("digest", F.lit(1))
    for table in (docs, docs.limit(0)):
        got = table
        for name, stage in P.STAGES:
            before = got
            got = written(stage(spark, got, SF), "stage")
            if name != "pieces":
                assert got.columns == before.columns
        got.collect()


@pytest.fixture(scope="module")
def vocabulary():
    return sampled_pieces.read_vocabulary()


def test_pieces_round_trip_and_repeat(vocabulary):
    texts = ["", " ", "  a  b ", "▁x▁ y", "日本語\n\n\t漢字 ✨🎉é", "x" * 3000, "Hello world, hello again.", "\0\x7f", "tab\tnew\r\nline", "à la carte ÀÉ" * 50]
    seeds = np.arange(len(texts)).astype(np.uint64)
    ids, at = sampled_pieces.encode(vocabulary, texts, seeds)
    assert [b.decode() for b in sampled_pieces.decode(vocabulary, ids, at)] == texts
    for i in range(len(texts)):
        alone, _ = sampled_pieces.encode(vocabulary, texts[i : i + 1], seeds[i : i + 1])
        assert alone.tolist() == ids[at[i] : at[i + 1]].tolist()
    other, _ = sampled_pieces.encode(vocabulary, texts, seeds + np.uint64(1000))
    assert other.tolist() != ids.tolist()


def test_pieces_are_drawn_in_proportion_to_their_paths(vocabulary):
    word, n = "there", 20_000
    alpha = 0.5
    weight = dict(zip(vocabulary.ids.tolist(), np.exp(alpha * vocabulary.scores), strict=True))
    by_piece = {p: i for i, p in enumerate(vocabulary.pieces) if p}
    paths = {}

    def walk(rest, path, w):
        if not rest:
            paths[tuple(path)] = w
        for k in range(1, len(rest) + 1):
            if (i := by_piece.get(rest[:k])) is not None:
                walk(rest[k:], [*path, i], w * weight[i])

    walk("▁" + word, [], 1.0)
    ids, at = sampled_pieces.encode(vocabulary, [word] * n, np.arange(n).astype(np.uint64), alpha)
    seen = {}
    for a, b in zip(at[:-1], at[1:], strict=True):
        key = tuple(ids[a:b].tolist())
        seen[key] = seen.get(key, 0) + 1
    total = sum(paths.values())
    assert set(seen) <= set(paths) and len(seen) > 5
    for path, w in paths.items():
        p = w / total
        assert abs(seen.get(path, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3


def test_documents_decode_again(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b", "x"), (None, None, "x"), (2, "", "x"), (1, "a b", "x")], "doc_id long, text string, ids string")
    got = sampled_pieces.encode_documents(df, vocabulary=vocabulary)
    assert got.where("lossless").count() == 4
    assert sorted(map(str, (tuple(r) for r in sampled_pieces.decode_documents(got, vocabulary=vocabulary).collect()))) == sorted(map(str, [(1, "a b"), (1, "a b"), (2, ""), (None, "")]))
    assert sampled_pieces.encode_documents(df.limit(0), vocabulary=vocabulary).count() == 0


def test_toxicity_is_learned_and_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and held
    assert np.mean([y == r.predicted for y, r in held]) >= 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_matches_brute_force(spark):
    """Counts, ratios, choice of features and fit by plain Python, with another optimiser."""
    rng = random.Random(3)
    bad, good = ["idiot", "moron", "awful trash"], ["lovely", "kind words", "sunny", "river"]
    texts = [" ".join(rng.choice(good + bad * (i % 3 == 0)) for _ in range(rng.randrange(0, 7))) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(any(b in t for b in bad))) for i, t in enumerate(texts)], "doc_id long, toxic int")
    n_features = 150

    def grams(text):
        padded, found = [ord(c) for c in f" {text.lower()} "], set()
        for n in toxicity.GRAMS:
            for at in range(len(padded) - n + 1):
                x = sum(c * int(k) for c, k in zip(padded[at : at + n], toxicity._K, strict=False)) % (1 << 64)
                found.add(((x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 64 - toxicity.HASH_BITS)
        return found

    train = [(grams(t), int(any(b in t for b in bad))) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    n_pos = sum(y for _, y in train)
    n_neg = len(train) - n_pos
    pos, neg = ({g: sum(g in x for x, y in train if y == c) for g in set().union(*(x for x, _ in train))} for c in (1, 0))
    often = [g for g in pos if pos[g] + neg[g] >= toxicity.MIN_DOCS]
    expected = {g: (pos[g] + neg[g]) * (n_pos / len(train)) for g in often}
    chosen = sorted(often, key=lambda g: (-((pos[g] - expected[g]) * (pos[g] - expected[g]) / expected[g]), g))[:n_features]
    ratio = np.array([np.log((pos[g] + 1) / (n_pos + 2) / ((neg[g] + 1) / (n_neg + 2))) for g in chosen])
    x = np.array([[r * (g in f) for g, r in zip(chosen, ratio, strict=True)] + [1.0] for f, _ in train])
    y = np.array([v for _, v in train], dtype=float)
    w = np.zeros(n_features + 1)
    ridge = np.diag([toxicity.PENALTY] * n_features + [0.0])
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    want = [1 / (1 + np.exp(-sum((r * v for g, r, v in zip(chosen, ratio, w, strict=False) if g in grams(t)), w[-1]))) for t in texts]
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels, n_features=n_features).collect()}
    assert np.abs([got[i].score - s for i, s in enumerate(want)]).max() < 2e-3
    assert all(got[i].predicted == (got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)


def test_toxicity_with_all_features(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = lambda n: {r.doc_id: r.score for r in toxicity.score_documents(docs, labels, n_features=n).collect()}
    assert scores(None) == scores(1 << toxicity.HASH_BITS) != scores(50)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([None, "", "bad idiot words", "good words", "good day"] * 8)] + [(None, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 2)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 41 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
