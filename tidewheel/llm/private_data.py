"""Personal data: fixed patterns, and spans that a skip-chain conditional random field adds.

The base spans are the matches of four patterns (email, ip, card, phone) with their checks. The field labels tokens, runs of
characters other than white space, and is trained on all of them. Decoding makes nodes of the tokens that hold a digit, an at
sign or a written one, and of every word that has a key in common with one of them; the words left share no key with such a
token, and stand beside its neighbours as outside (with nodes of them too, see ``whole``, only words that repeat and
confirm each other would be added). Its potentials are the shape
of a token and of the words beside it (a base match is such a feature), the labels of neighbours in a row, and skip links: the
occurrences of one key in a document (the same token, the local part of an address, the last seven digits of a number), each
linked to the next, however far. Loopy message passing over rows and skip links spreads what is clear at one occurrence to
the others. Tokens labelled as data that no base span touches become spans; neighbours of one label become one.

The field is trained on documents made by ``labelled_documents`` by pseudo-likelihood, on the driver; N_TRAIN bounds it.

Rules: null text counts as empty; a text without digits and at signs (also written ones) has no spans; rows are independent of each other, ids are only
carried along (null ones too), and a text of any length is one document. No rows give no rows. Other columns are ignored. Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as made

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trimmed
from .optimise import minimised

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
N_TRAIN = 600
PENALTY = 0.1
#: A document's messages are passed on until none changes by more than TOLERANCE (log probability); a field that does not
#: settle is left after MORE_PASSES passes for each of its tokens and as many again.
TOLERANCE = 1e-3
MORE_PASSES = 50
DAMPING = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from the others too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_WRITTEN = re.compile(r"[(\[]at[)\]]", re.I)
_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_NODE = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
_TOKEN = re.compile(r"\S+")
_OUTER = "\"'`.,;:!?()[]{}<>*#$%&|=~^_/\\“”«»…-"
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The matches of the patterns that pass their checks: kind, start, end, by start and then kind."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    if _SOME.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= len(m[0]) and 12 <= len(d := digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Graph:
    """The tokens of a text that are labelled, with their features and links. beside: how many words that are no nodes stand
    right before and right after each (none where it is empty)."""

    spans: list[tuple[int, int]]
    features: list[list[str]]
    base: list[bool]
    near: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    beside: list[list[int]] = made(default_factory=list)


def _shape(word: str) -> list[str]:
    n = len(d := digits(word))
    letters = sum(c.isalpha() for c in word)
    out = ["bias", f"digits:{n if n < 8 else 8 if n < 10 else n if n < 12 else '12-19' if n <= 19 else 'many'}", f"letters:{min(4, letters.bit_length())}"]
    form = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", word))
    out.append(f"form:{form if len(form) <= 9 else 'long'}")
    if 12 <= n <= 19 and n == len(word.replace("-", "")):
        out.append(f"luhn:{luhn(d)}")
    parts = re.split(r"[^0-9a-zA-Z]+", word)
    if sum(p.isdigit() for p in parts) == 4 and len([p for p in parts if p]) == 4:
        out.append(f"four parts:{all(int(p[-4:]) <= 255 for p in parts if p)}")
    if "@" in word:
        out.append("at sign")
    if _WRITTEN.search(word):
        out.append("written at")
    return out


def _local(word: str) -> str:
    return _AT.split(word, maxsplit=1)[0].strip(_OUTER).lower()


def graph(text: str, base: list[tuple[str, int, int]], whole: bool = False) -> Graph:
    """whole: every token is a node."""
    g = Graph([], [], [], [], [])
    last: dict[str, int] = {}
    links = set()
    before, open_, nth, last_nth, word_nth = "", None, 0, -1, -1
    spans = sorted((s, e, k) for k, s, e in base)
    locals_ = {_local(m[0].strip(_OUTER)) for m in _TOKEN.finditer(text) if _AT.search(m[0])} - {""} if _AT.search(text) else set()
    for m in _TOKEN.finditer(text):
        raw, word = m[0], m[0].strip(_OUTER)
        nth += 1
        if open_ is not None:
            g.features[open_].append(f"next:{'number' if _SOME.search(raw) else 'word'}")
            open_ = None
        lower = word.lower()
        if not word or not (whole or _NODE.search(word) or lower in locals_):
            if word:
                word_nth = nth
                if last_nth == nth - 1:
                    g.beside[-1][1] = 1
            before = lower if len(word) < 12 else ""
            continue
        i = len(g.spans)
        start = m.start() + raw.index(word)
        end = start + len(word)
        while spans and spans[0][1] <= start and spans[0][0] < start:
            spans.pop(0)
        kinds = {k for s, e, k in spans if s < end and e > start}
        form = ["parenthesis"] if raw.startswith("(") and ")" in raw else []
        g.spans.append((start, end))
        g.base.append(bool(kinds))
        g.beside.append([int(word_nth == nth - 1), 0])
        g.features.append([*_shape(word), *form, *(f"base:{k}" for k in sorted(kinds)), *([f"base:{'some' if kinds else 'none'}"]), f"before:{before if before in CUES else 'number' if before == '9' else 'word'}"])
        if last_nth == nth - 1:
            g.near.append((i - 1, i))
        last_nth = nth
        keys = {f"w:{lower}"}
        if _AT.search(word) and (local := _local(word)):
            keys.add("w:" + local)
        d = digits(word)
        if len(d) >= 7 and not any(c.isalpha() for c in word):
            keys.add("d:" + d[-7:])
        for key in keys:
            if key in last:
                links.add((last[key], i))
            last[key] = i
        before, open_ = "9" if _SOME.search(word) else lower if len(word) < 12 else "", i
    g.skip = sorted(links)
    return g


# fixed values: words that announce data
CUES = frozenset("mail email e-mail contact write ip host server address card visa credit account payment phone call tel telephone mobile fax token key id order version".split())


@dataclass
class Field:
    number: dict[str, int]
    unary: np.ndarray
    near: np.ndarray
    skip: np.ndarray

    def beliefs(self, graphs: list[Graph], tolerance: float = TOLERANCE) -> np.ndarray:
        """Log beliefs of every token of all graphs, by damped message passing until each graph's messages have settled.

        A graph that has settled is left as it is, so its beliefs do not depend on the graphs beside it.
        """
        k = len(LABELS)
        sizes = [len(g.spans) for g in graphs]
        begin = np.cumsum([0, *sizes])[:-1]
        node = np.repeat(np.arange(sum(sizes)), [len(f) for g in graphs for f in g.features])
        feature = np.array([self.number.get(x, -1) for g in graphs for f in g.features for x in f], dtype=np.int64)
        known = feature >= 0
        unary = np.zeros((sum(sizes), k))
        np.add.at(unary, node[known], self.unary[feature[known]])
        beside = np.array([x for g in graphs for x in (g.beside or [[0, 0]] * len(g.spans))]).reshape(-1, 2)
        unary += beside[:, :1] * self.near[0] + beside[:, 1:] * self.near[:, 0]
        links = {n: np.array([(b + i, b + j) for b, g in zip(begin, graphs, strict=True) for i, j in getattr(g, n)], dtype=np.int64).reshape(-1, 2) for n in ("near", "skip")}
        a = np.concatenate([links["near"][:, 0], links["skip"][:, 0]])
        b = np.concatenate([links["near"][:, 1], links["skip"][:, 1]])
        pair = np.concatenate([np.broadcast_to(self.near, (len(links["near"]), k, k)), np.broadcast_to(self.skip, (len(links["skip"]), k, k))])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), k))
        of = np.searchsorted(begin, source, "right") - 1  # a graph without tokens begins where the next one does
        most = MORE_PASSES * (np.array(sizes) + 1)
        active, total, turn = np.arange(len(source)), unary.copy(), 0
        while len(active):
            turn += 1
            out = (total[source[active]] - message[back[active]])[:, :, None] + pair[active]
            new = np.logaddexp.reduce(out, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            new = DAMPING * message[active] + (1 - DAMPING) * new
            change = np.zeros(len(graphs))
            np.maximum.at(change, of[active], np.abs(new - message[active]).max(axis=1))
            np.add.at(total, target[active], new - message[active])
            message[active] = new
            active = active[((change > tolerance) & (turn < most))[of[active]]]
        return total - np.logaddexp.reduce(total, axis=1, keepdims=True)

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]], whole: bool = False) -> list[list[tuple[str, int, int]]]:
        """The spans beside the base spans of each text."""
        graphs = [graph(t, s, whole) if whole or _NODE.search(t) else Graph([], [], [], [], []) for t, s in zip(texts, base, strict=True)]
        out: list[list[tuple[str, int, int]]] = []
        label = self.beliefs(graphs).argmax(axis=1) if any(g.spans for g in graphs) else np.zeros(0, dtype=int)
        at = 0
        for g in graphs:
            found: list[tuple[str, int, int]] = []
            linked, last = set(g.near), -2
            for i, (s, e) in enumerate(g.spans):
                y = int(label[at + i])
                if y and not g.base[i]:
                    kind = LABELS[y]
                    if last == i - 1 and (i - 1, i) in linked and found[-1][0] == kind and kind == "phone":
                        found[-1] = (kind, found[-1][1], e)
                    else:
                        found.append((kind, s, e))
                    last = i
            at += len(g.spans)
            out.append(found)
        return out


def fit(documents: list[tuple[str, list[tuple[str, int, int]]]], penalty: float = PENALTY, rounds: int = 80) -> Field:
    """Weights by pseudo-likelihood: each token's label given those of its neighbours. documents: text, true spans."""
    k = len(LABELS)
    graphs, truth = [], []
    for text, spans in documents:
        g = graph(text, base_spans(text), whole=True)
        graphs.append(g)
        truth += [next((LABELS.index(n) for n, s, e in spans if s < end and e > start), 0) for start, end in g.spans]
    y = np.array(truth)
    number = {x: i for i, x in enumerate(sorted({x for g in graphs for f in g.features for x in f}))}
    begin = np.cumsum([0] + [len(g.spans) for g in graphs])[:-1]
    node = np.repeat(np.arange(len(y)), [len(f) for g in graphs for f in g.features])
    feature = np.array([number[x] for g in graphs for f in g.features for x in f])
    links = {n: np.array([(b + i, b + j) for b, g in zip(begin, graphs, strict=True) for i, j in getattr(g, n)], dtype=np.int64).reshape(-1, 2) for n in ("near", "skip")}
    gold = np.eye(k)[y]
    m = len(number)

    def parts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = w[m * k : (m + k) * k].reshape(k, k)
        skip = w[(m + k) * k :].reshape(k, k)
        return w[: m * k].reshape(m, k), near, skip + skip.T

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        unary, near, skip = parts(w)
        z = np.stack([np.bincount(node, unary[feature, c], minlength=len(y)) for c in range(k)], axis=1)
        for (i, j), pair in ((links["near"].T, near), (links["skip"].T, skip)):
            np.add.at(z, j, pair[y[i]])
            np.add.at(z, i, pair[:, y[j]].T)
        z -= np.logaddexp.reduce(z, axis=1, keepdims=True)
        d = np.exp(z) - gold
        gu = np.stack([np.bincount(feature, d[node, c], minlength=m) for c in range(k)], axis=1)
        gn, gs = np.zeros((k, k)), np.zeros((k, k))
        for (i, j), g in ((links["near"].T, gn), (links["skip"].T, gs)):
            np.add.at(g, y[i], d[j])
            np.add.at(g.T, y[j], d[i])
        grad = np.concatenate([gu.ravel(), gn.ravel(), (gs + gs.T).ravel()])
        return float(-z[np.arange(len(y)), y].sum() + penalty / 2 * w @ w), grad + penalty * w

    unary, near, skip = parts(minimised(loss, np.zeros((m + 2 * k) * k), rounds))
    return Field(number, unary, near, skip)


def labelled_documents(n: int, seed: int = 0) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of invented words with data in forms that the patterns match and forms that they miss, and numbers that are no data."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("en", "ti", "la", "or", "ou", "ch", "st", "ma")) for _ in range(rng.randrange(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    some = lambda: word() + rng.choice((f".{num(2)}", num(2), "." + word(), "." + word(), "_" + word(), "_" + word() + num(1), ""))

    hex_ = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        body = rng.choice("345") + num(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def no_card() -> str:
        while luhn(s := rng.choice("123456789") + num(rng.choice((11, 12, 15, 18)))):
            pass
        return s

    def entity() -> tuple[str, list[str]]:
        """A kind, and its forms; the last ones are data only beside the first."""
        kind = rng.choice(KINDS)
        if kind == "email":
            local, host = some(), f"{rng.choice((f'mail{num(1)}.', ''))}{word()}.{rng.choice(('com', 'org', 'net'))}"
            forms = [f"{local}@{host}", f"{local}(at){host}", f"{local}[at]{host}"]
            return kind, forms if local.isalpha() else [*forms, local]  # a mere word is data in an address alone
        if kind == "ip":
            p = [str(rng.randrange(256)) for _ in range(4)]
            return kind, [".".join(p), "[.]".join(p), "(.)".join(p)]
        if kind == "card":
            c = card()
            return kind, [c, f"{c} {c}", "-".join(c[i : i + 4] for i in (0, 4, 8, 12))]
        a, b, c = rng.choice("23456789") + num(2), num(3), num(4)
        return kind, [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{b}-{c}"]

    def noise() -> str:
        return rng.choice(
            (
                lambda: str(rng.randrange(1, 3000)),
                lambda: f"{num(2)}.{num(2)}",
                lambda: f"{num(1)}.{num(2)}.{num(1)}",
                lambda: f"20{num(2)}-0{rng.randrange(1, 10)}-1{num(1)}",
                lambda: f"1{num(1)}/0{rng.randrange(1, 10)}/20{num(2)}",
                lambda: f"1{rng.randrange(10)}:{num(2)}",
                lambda: '"' + hex_(40) + '"',
                lambda: f"{word()}={hex_(rng.randrange(8, 40))}",
                lambda: hex_(rng.randrange(6, 64)),
                lambda: f"{hex_(8)}-{hex_(4)}-{hex_(4)}-{hex_(12)}",
                lambda: f"http://{word()}.{word()}/{num(3)}?{word()}={num(2)}",
                no_card,
                lambda: f"{num(3)}-{num(4)}",
                lambda: f"{word()}{num(2)}",
                lambda: f"{word()}{rng.choice('._')}{word()}",
                lambda: f"{word()}.{rng.choice(('com', 'org', 'net'))}",
                lambda: f"{num(2)}%",
                lambda: f"${num(3)}.{num(2)}",
                lambda: f"@{word()}",
                lambda: f"{rng.randrange(256, 1000)}.{num(3)}.{num(2)}.{num(3)}",
            )
        )()

    out = []
    for _ in range(n):
        pieces: list[tuple[str, str | None]] = [(word(), None) for _ in range(rng.randrange(5, 40))]
        insert = []
        for _ in range(rng.randrange(3)):
            kind, forms = entity()
            lead = rng.random() < 0.7
            if lead:
                insert.append((forms[0], kind))
            alone = forms[1:] if lead else [f for f in forms[1:] if len(digits(f)) != 7 and (kind != "email" or "at" in f and ("(" in f or "[" in f))]
            insert += [(rng.choice(forms[:1] + alone if lead else alone or forms[:1]), kind) for _ in range(rng.randrange(3))]
            if kind == "email" and not lead and len(forms) == 4:
                insert = [x for x in insert if x[0] not in forms] + [(rng.choice(forms[1:3]), kind)] + [(forms[3], kind)] * rng.choice((0, 0, 1, 2))
            if kind == "email" and len(forms) == 3:
                insert += [(forms[0].split("@")[0], None)] * rng.randrange(3)
        insert += [(noise(), None) for _ in range(rng.randrange(4))]
        for form, kind in insert:
            at = rng.randrange(len(pieces) + 1)
            cue = rng.random() < 0.15
            pieces[at:at] = ([(rng.choice(sorted(CUES)), None)] if cue else []) + [(form, kind)]
        text, spans = "", []
        for form, kind in pieces:
            if kind:
                spans.append((kind, len(text), len(text) + len(form)))
            text += form + rng.choice(("", "", "", ",", ".", "###", "!!", "%%%")) * (rng.random() < 0.3) + rng.choice((" ", " ", " ", "\n"))
        out.append((text, spans))
    return out


def train(n: int = N_TRAIN, seed: int = 0) -> Field:
    return fit(labelled_documents(n, seed))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and added, each array<struct<kind,start,end>>."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    narrow = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            more = shared.value.added(texts, base)
            rows = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], struct) for found in (base, more)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *rows], ["id", "base", "added"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return narrow.mapInArrow(trimmed(run), f"id {kind}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, spans (all, as text), n_added."""
    order = F.array(*[F.lit(k) for k in KINDS])

    def text_of(spans):
        by = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("n"))))
        return F.array_join(F.transform(by, lambda x: F.concat_ws(":", x["n"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(count, KINDS), F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
