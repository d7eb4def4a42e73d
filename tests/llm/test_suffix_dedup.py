"""Suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidewheel.llm import suffix_dedup as S


def brute(texts, n):
    starts = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            starts.setdefault(t[p : p + n], []).append((i, p))
    gone = [np.zeros(len(t), dtype=bool) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + n] = True
    return gone


def corpus(seed, n_texts=60, letters="abcdefghij "):
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [some(rng.choice([199, 200, 201, 260, 500, 900])) for _ in range(8)]
    texts = []
    for _ in range(n_texts):
        t = some(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice(letters) + p[at + 1 :]
            t += p + some(rng.choice([0, 1, 50, 300]))
        texts.append(t)
    texts += ["", None, "ab" * 700, "a" * 350, "a" * 199, "xyz" * 100 + some(50) + "xyz" * 100, "é" * 150, "é" * 150 + "q", texts[3], texts[3]]
    return texts


@pytest.mark.parametrize("most", [4096, 2])
def test_matches_brute_force(spark, most):
    texts = corpus(most)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sha string, h int")
    rows = {r.doc_id: r for r in S.removed_spans(df, most_regions=most, with_text=True).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, gone in enumerate(brute(raw, 200)):
        edges = np.diff(np.append(0, np.append(gone, 0)).astype(int))
        runs = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        left = bytes(b for b, g in zip(raw[i], gone, strict=True) if not g)
        r = rows[i]
        assert [(x.s, x.e) for x in r.spans] == runs, i
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(raw[i]), int(gone.sum()), len(runs), hashlib.sha256(left).hexdigest(), left)


def test_boundaries_are_common_prefixes_below_the_bound():
    rng = random.Random(2)
    s = "".join(rng.choice("ab") for _ in range(60)) * 3 + "c"
    text = np.frombuffer(s.encode() + b"\xff", dtype=np.uint8)
    order = S.suffix_order(text, 40)
    got = S.boundaries(text, order, 40)

    def common(i, j):
        k = 0
        while max(i, j) + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        return k

    for r in range(1, len(text)):
        assert got[r] == min(common(order[r - 1], order[r]), 40)


def test_no_rows_and_no_ids(spark):
    df = spark.createDataFrame([(None, "a" * 400), (None, "b")], "doc_id long, text string")
    assert sorted(r.n_removed for r in S.removed_spans(df).collect()) == [0, 400]
    assert S.removed_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("min_len", [40, 48, 304])
def test_lengths_that_do_not_fit_are_refused(spark, min_len):
    with pytest.raises(ValueError, match="min_len"):
        S.removed_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"), min_len=min_len)
