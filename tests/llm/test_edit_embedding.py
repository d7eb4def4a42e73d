"""The edit embedding: contract columns, edit distance and near classes against plain Python."""

import hashlib
import random

import numpy as np

from tidewheel.llm import edit_embedding as E
from tidewheel.llm import near_dup

from .test_dedup import classes_of


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert E.edit_distance(a, b) == plain_distance(a, b)


def walked(text):
    """The fingerprint, a step at a time."""
    level = E.level_of(len(text))
    kind = [(ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 26 for c in text]
    out, at, gap = "", 0, (1 << level) // E.SLOTS
    padded = [ord(c) for c in text] + [0] * 4
    for j in range(1 << level):
        if at >= len(text):
            break
        if j % gap == 0:
            x = sum(p * k for p, k in zip(padded[at : at + 4], (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1), strict=False)) & 0xFFFFFFFF
            out += "0123456789abcdef"[((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 28]
        at += int(E._bits(j // E._STEPS)[j % E._STEPS, kind[at]])
    return f"{level:02x}{out}"


def test_fingerprints_walk_as_described():
    rng = random.Random(1)
    texts = ["", "a", "héllo wörld", "日本語" * 40, "".join(rng.choice("abcdefgh ") for _ in range(700))]
    assert E.fingerprints(texts) == [walked(t) for t in texts]
    assert E.fingerprints(texts[::-1]) == [walked(t) for t in texts[::-1]]


def test_documents(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [some(rng.choice([1, 2, 3, 7, 100, 800, 3000])) for _ in range(60)] + ["", None, "same text here", "same text here", "é" * 90000]
    order = list(range(0, 3 * len(texts), 3))
    rows = list(zip(order, texts, strict=True))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, extra string").repartition(5)
    got = {r.doc_id: r for r in E.fingerprint_documents(df).collect()}
    assert len(got) == len(texts)
    prints = dict(zip(order, E.fingerprints([t or "" for t in texts]), strict=True))
    for n, i in enumerate(order):
        t, nxt = texts[n] or "", texts[(n + 1) % len(texts)] or ""
        want = E.edited(t, nxt)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[i].fingerprint == prints[i] and got[i].edited_fingerprint == E.fingerprints([want])[0]
        assert got[i].near_edited == E.likeness(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == E.likeness(got[i].fingerprint, prints[order[(n + 1) % len(order)]])
        if len(t) >= 100 and len(set(t)) > 1:
            assert got[i].near_edited > 0.5


def test_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "abcd"), (5, "bbbb"), (5, "aaaa"), (5, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in E.fingerprint_documents(df).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([("None", 4, sha("abc")), ("5", 0, sha("")), ("5", 4, sha("aaab")), ("5", 4, sha("bbba"))])
    assert E.fingerprint_documents(df.limit(0)).count() == 0
    one = df.where("text = 'abcd'")
    assert E.fingerprint_documents(one).first().edited_sha256 == sha("abca")


def test_near_classes(spark):
    rng = random.Random(8)
    texts = []
    for n in (60, 300, 1000, 1500):
        for _ in range(6):
            t = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
            texts.append(t)
            for _ in range(3):
                u = list(t)
                for _ in range(rng.choice([0, n // 40])):
                    at = rng.randrange(len(u))
                    u[at : at + 1] = rng.choice([[], ["x"], ["y", "z"]])
                texts.append("".join(u))
    texts += ["", None]
    raw = [t or "" for t in texts]
    links = [(i, j) for i in range(len(raw)) for j in range(i) if abs(len(raw[i]) - len(raw[j])) < 300 and E.edit_similarity(raw[i], raw[j]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.class_id for r in E.near_classes(df).collect()}
    assert sum(rows[i] == rows[j] for i, j in links) >= 0.95 * len(links)
    true = dict(enumerate(classes_of(len(raw), links)))
    assert len({(rows[i], true[i]) for i in rows}) == len(set(rows.values()))  # no class joins texts that are not linked


def test_bands_are_common_at_any_place():
    bands = lambda *x: np.array(x, dtype=np.int64)
    measure = near_dup.Measure(lambda t: t, lambda a, b: 1.0, 0.8)
    few = [(1, 1, True, bands(5, 7, 9), "x")]
    rest = [(2, 2, False, bands(7), "y"), (3, 3, False, bands(9, 8, 7, 6), "z"), (4, 4, False, bands(7, 5), "in band 5"), (5, 1, False, bands(7), "linked")]
    assert sorted(near_dup.compare_block(measure, 7, few, rest)) == [(1, 2), (1, 3)]
    assert sorted(near_dup.compare_block(measure, 5, few, rest[2:3])) == [(1, 4)]


def test_near_classes_with_a_common_head_on_two_levels(spark):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    head, texts = some(260), []
    for n in (60, 75, 80, 85, 420, 425, 440):  # lengths on both sides of a power of two
        tail = some(n)
        texts += [head + tail, head + tail[: n // 2] + "x" + tail[n // 2 :], head + tail + some(25)]
    texts += [head + some(n) for n in (80, 500, 900, 1500)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if E.edit_similarity(texts[i], texts[j]) >= 0.8]
    assert len({len(E.bands_of(f)) for f in E.fingerprints(texts)}) > 1
    rows = {r.doc_id: r.class_id for r in E.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(rows[i] == rows[j] for i, j in links) >= 0.95 * len(links)
    true = dict(enumerate(classes_of(len(texts), links)))
    assert len({(rows[i], true[i]) for i in rows}) == len(set(rows.values()))
