"""Personal data: the patterns against plain regular expressions, message passing against sums, held-out accuracy."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidewheel.llm import private_data as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            if kind != "card" or 12 <= len(d) <= 19 and P.luhn(d):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    for letters, n in (("a1@.- +()", 4000), ("12.0 ", 2000), ("@a.", 2000), ("4 -1", 1000), ("+1()-. 5é\n", 2000)):
        for _ in range(n):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
            assert P.base_spans(t) == plain(t), t
    for t, _ in P.labelled_documents(200, seed=8):
        assert P.base_spans(t) == plain(t)


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" * 100_000, "x1" * 100_000, "1 " * 100_000):
        P.base_spans(t)


@pytest.fixture(scope="module")
def field():
    return P.train()


def test_messages_give_marginals_on_trees(field):
    rng = np.random.default_rng(2)
    g = P.Graph([(i, i + 1) for i in range(5)], [[f] for f in rng.choice(list(field.number), 5)], [False] * 5, [(0, 1), (1, 2), (3, 4)], [(1, 3)])
    got = np.exp(field.beliefs([g], tolerance=1e-9))
    want = np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        s = sum(field.unary[field.number[g.features[i][0]], y[i]] for i in range(5))
        s += sum(field.near[y[i], y[j]] for i, j in g.near) + sum(field.skip[y[i], y[j]] for i, j in g.skip)
        for i in range(5):
            want[i, y[i]] += np.exp(s)
    assert got == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-6)


def test_beliefs_do_not_depend_on_the_batch(field):
    texts = [t for t, _ in P.labelled_documents(20, seed=3)]
    base = [P.base_spans(t) for t in texts]
    assert field.added(texts, base) == [field.added([t], [b])[0] for t, b in zip(texts, base, strict=True)]


def test_held_out_accuracy(field):
    found = wrong = missed = 0
    for text, true in P.labelled_documents(400, seed=99):
        base = P.base_spans(text)
        meets = lambda x, y: x[1] < y[2] and x[2] > y[1]
        for x in (more := field.added([text], [base])[0]):
            good = any(x[0] == y[0] and meets(x, y) for y in true)
            found, wrong = found + good, wrong + (not good)
            assert not any(meets(x, b) for b in base)
        missed += sum(not any(meets(x, y) for y in base + more) for x in true)
    assert found > 200 and wrong <= 0.03 * found and missed <= 0.05 * found


def test_a_clear_mention_decides_a_distant_one(field):
    filler = "orla enti la " * 40
    lone = f"{filler} 555-3824 {filler}"
    both = f"{filler} +1 (743) 555-3824 {filler} 555-3824 {filler}"
    assert field.added([lone], [P.base_spans(lone)]) == [[]]
    at = both.rindex("555-3824")
    assert field.added([both], [P.base_spans(both)]) == [[("phone", at, at + 8)]]


def test_data_without_a_digit(field):
    found = lambda t: [(k, t[s:e]) for k, s, e in field.added([t], [P.base_spans(t)])[0]]
    filler = "orla enti la " * 40
    assert found(f"{filler} maria.lopez {filler}") == []
    assert found(f"maria.lopez@mail.com {filler} maria.lopez {filler} Maria.Lopez, {filler}") == [("email", "maria.lopez"), ("email", "Maria.Lopez")]
    assert found(f"{filler} jane.doe(at)example.com {filler}") == [("email", "jane.doe(at)example.com")]
    assert found(f"JANE.DOE[AT]EXAMPLE.COM {filler} jane.doe") == [("email", "JANE.DOE[AT]EXAMPLE.COM"), ("email", "jane.doe")]
    assert found("info@example.com has info for you. and e.g. some.thing") == []  # a mere word is data in an address alone
    found = missed = wrong = 0
    for text, true in P.labelled_documents(400, seed=98):
        base = P.base_spans(text)
        more = field.added([text], [base])[0]
        apart = set(field.added([text], [base], whole=True)[0]) - set(more)  # of the words that are no nodes none is data
        assert not any(x[1] < y[2] and x[2] > y[1] for x in apart for y in true)
        plain_forms = [x for x in true if not re.search("[0-9@]", text[x[1] : x[2]])]
        got = [x for x in more if not re.search("[0-9@]", text[x[1] : x[2]])]
        hit = [any(x[0] == y[0] and x[1] < y[2] and x[2] > y[1] for y in more) for x in plain_forms]
        found, missed = found + sum(hit), missed + len(hit) - sum(hit)
        wrong += sum(not any(x[0] == y[0] and x[1] < y[2] and x[2] > y[1] for y in true) for x in got)
    assert found > 30 and missed <= 0.1 * found and wrong <= 0.05 * found


def test_documents(spark, field):
    texts = ["mail a.b@c.de now", "é 10.0.0.1 and 4111 1111 1111 1111", "+1 (578) 555-6437 4918187128635271 er", "no data", "", None]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, n_ip int")
    rows = {r.doc_id: r for r in P.digest_columns(P.find(df, field)).collect()}
    for i, t in enumerate(texts):
        base = plain(t or "")
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in P.KINDS] == [sum(b[0] == k for b in base) for k in P.KINDS]
        assert set(filter(None, want.split(","))) <= set(rows[i].spans.split(","))
        more = field.added([t or ""], [base])[0]
        assert rows[i].spans == P.joined(base + more) and rows[i].n_added == len(more)
    assert rows[2].spans == "phone:3:17,card:18:34" or rows[2].n_added > 0
    assert P.find(df.limit(0), field).count() == 0


def test_evidence_travels_along_any_number_of_links(field):
    """A row of tokens, the first of them clear: with strong links the last one follows, a hundred links on."""
    n = 100
    g = P.Graph([(2 * i, 2 * i + 1) for i in range(n)], [["a"]] + [[]] * (n - 1), [False] * n, [], [(i, i + 1) for i in range(n - 1)])
    k = len(P.LABELS)
    strong = P.Field({"a": 0}, np.eye(k)[1:2] * 9, np.zeros((k, k)), np.eye(k) * 12)
    alone = strong.beliefs([g])
    assert (alone.argmax(axis=1) == 1).all()
    assert np.allclose(alone, strong.beliefs([g, g])[n:])
