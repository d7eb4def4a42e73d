"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

The page is read into blocks, the runs of text between block-level tags, each with its open elements. Features are the tags
and the class and id words of those elements and the shape of the text (length, share of links, punctuation, place on
the page). Two labels, article and rest, are decoded by Viterbi; the article's blocks are the text.

Training pages are made by ``labelled_pages``: layouts of many kinds with invented words, whose blocks carry their label. The
fit takes N_TRAIN pages, on the driver; no page of the input is used.

Text is left out of two kinds of elements alone. RAW elements hold no tags and end at their end tag or with the page, as in
browsers (within svg and math also at '/>'). APART elements, which browsers show in another way or not at all, are left out
from the start tag to the end tag that matches it; where none does, their text stays. Text of svg, math and unknown elements stays.

Rules: null html counts as empty and gives an empty text; unclosed tags, comments and scripts end as browsers end them; white
space (also no-break space) inside a block becomes one space and a line break tag is white space. Repeated rows give equal
rows. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trimmed
from .optimise import minimised

N_TRAIN = 600
PENALTY = 0.05

# fixed values: elements by their role
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea iframe title noembed noframes".split())
APART = frozenset("template select object video audio canvas annotation annotation-xml desc metadata".split())
CLOSES = {
    "li": ("li", frozenset("ul ol menu dir".split())),
    "dt": ("dt dd", frozenset(["dl"])),
    "dd": ("dt dd", frozenset(["dl"])),
    "tr": ("tr td th", frozenset(["table"])),
    "td": ("td th", frozenset("tr table".split())),
    "th": ("td th", frozenset("tr table".split())),
}

#: The attribute that training pages carry their labels in; decoding never looks at labels.
LABEL = "data-tidewheel-article"

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for x in RAW}
_HAS_APART = re.compile(r"<(?:" + "|".join(sorted(APART)) + r")[\s/>]", re.I)
_NAMES = re.compile(r"""\b(class|id|role|data-tidewheel-article)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    features: list[str]
    label: int | None = None


class _Open:
    """An open element: its tag, the features it and those above it give, and a training label."""

    __slots__ = ("tag", "features", "label", "link")

    def __init__(self, tag: str, features: frozenset, label: int | None, link: bool):
        self.tag, self.features, self.label, self.link = tag, features, label, link


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, tag (in lower case; empty: a comment, a raw element or no tag), whether it is an end tag, attributes."""
    at, foreign = 0, 0
    while m := _TOKEN.search(page, at):
        at, tag, attrs = m.end(), (m["tag"] or "").lower(), m["attrs"] or ""
        closed = attrs.endswith("/")
        if tag in ("svg", "math"):
            foreign = max(0, foreign - 1) if m["end"] else foreign + (not closed)
        if tag in RAW and not m["end"] and (not attrs or attrs[0] == "/" or attrs[0].isspace()):
            if not (closed and foreign):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            tag = ""
        yield m.start(), at, tag, bool(m["end"]), attrs


def _without_apart(tokens: list[tuple[int, int, str, bool, str]]) -> Iterator[tuple[int, int, str, bool, str]]:
    """The tokens with one for each element of APART that has its end tag."""
    opened: dict[str, list[int]] = {x: [] for x in APART}
    whole: dict[int, int] = {}
    for i, (_, _, tag, is_end, attrs) in enumerate(tokens):
        if tag in APART:
            if is_end:
                if opened[tag]:
                    whole[opened[tag].pop()] = i
            elif not attrs.endswith("/"):
                opened[tag].append(i)
    i = 0
    while i < len(tokens):
        if i in whole:
            yield tokens[i][0], tokens[whole[i]][1], "", False, ""
            i = whole[i]
        else:
            yield tokens[i]
        i += 1


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    top = _Open("", frozenset(), None, False)
    stack, out, parts = [top], [], []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            at = next((x for x in reversed(stack) if x.tag in BLOCKS), top)
            out.append(Block(text, [*at.features, f"leaf:{at.tag}", *shape(text, linked)], at.label))
        linked = 0

    at = 0
    for start, end, tag, is_end, attrs in _without_apart(list(_tokens(page))) if _HAS_APART.search(page) else _tokens(page):
        if start > at:
            parts.append(piece := page[at:start])
            if stack[-1].link:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
        if is_end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break  # an inline end tag does not close blocks
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in CLOSES:
            names, scope = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names.split():
                    del stack[i:]
                    break
                if stack[i].tag in scope:
                    break
        if tag in VOID or attrs.endswith("/"):
            continue
        above = stack[-1]
        features, label = above.features, above.label
        if tag in BLOCKS:
            own = {f"in:{tag}"}
            for name, value in _NAMES.findall(attrs):
                if name.lower() == LABEL:
                    label = {"0": 0, "1": 1}.get(value, label)
                else:
                    own.update(f"word:{w}" for w in _WORD.findall(value.lower()))
            features = features | own
        stack.append(_Open(tag, features, label, above.link or tag == "a"))
    if at < len(page):
        parts.append(page[at:])
    flush()
    n = len(out)
    for i, b in enumerate(out):
        b.features += [f"place:{min(9, 10 * i // n)}"] + ["first"] * (i == 0) + ["last"] * (i == n - 1)
    return out


def shape(text: str, linked: int) -> list[str]:
    n = text.count(" ") + 1
    out = ["bias", f"words:{min(6, n.bit_length())}", f"links:{min(4, int(4 * linked / len(text) + 0.5))}"]
    if text[-1] in ".!?…。\"'”»":
        out.append("ends like a sentence")
    if "©" in text:
        out.append("copyright")
    if text.isupper():
        out.append("capitals")
    return out


@dataclass
class Field:
    """Weights of features for the article label, of steps between labels and of the first label."""

    weights: dict[str, float]
    steps: np.ndarray
    first: np.ndarray

    def decode(self, page: list[Block]) -> list[int]:
        """The best labels, by Viterbi."""
        if not page:
            return []
        (t00, t01), (t10, t11) = self.steps.tolist()
        s0, s1 = self.first.tolist()
        back = []
        for i, b in enumerate(page):
            e = sum(self.weights.get(f, 0.0) for f in b.features)
            if i:
                from0, from1 = s1 + t10 > s0 + t00, s1 + t11 > s0 + t01
                back.append((from0, from1))
                s0, s1 = max(s0 + t00, s1 + t10), max(s0 + t01, s1 + t11)
            s1 += e
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def fit(pages: list[list[Block]], penalty: float = PENALTY, rounds: int = 80) -> Field:
    """Maximum likelihood with an L2 penalty, all pages at a time by forward and backward sums."""
    pages = [p for p in pages if p]
    names = sorted({f for p in pages for b in p for f in b.features})
    number = {f: i for i, f in enumerate(names)}
    longest, k = max(map(len, pages)), len(names)
    lengths = np.array([len(p) for p in pages])
    y = np.zeros((len(pages), longest), dtype=np.int64)
    cells, feats = [], []
    for i, p in enumerate(pages):
        for t, b in enumerate(p):
            y[i, t] = b.label or 0
            cells += [i * longest + t] * len(b.features)
            feats += [number[f] for f in b.features]
    cells, feats = np.array(cells), np.array(feats)
    live = np.arange(longest)[None, :] < lengths[:, None]
    pairs = live[:, 1:]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        emit = np.zeros((len(pages), longest, 2))
        emit[:, :, 1] = np.bincount(cells, w[feats], minlength=y.size).reshape(y.shape)
        steps, first = w[k : k + 4].reshape(2, 2), w[k + 4 :]
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            on = behind[:, t + 1] + emit[:, t + 1]
            new = np.logaddexp(steps[:, 0] + on[:, :1], steps[:, 1] + on[:, 1:])
            behind[:, t] = np.where(pairs[:, t, None], new, 0)
        total = np.logaddexp(*ahead[np.arange(len(pages)), lengths - 1].T)
        one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
        two = np.exp(ahead[:, :-1, :, None] + steps + (behind + emit)[:, 1:, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        gold = np.zeros((2, 2))
        np.add.at(gold, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        begin = np.bincount(y[:, 0], minlength=2)
        score = (emit[:, :, 1] * y * live).sum() + (steps * gold).sum() + (first * begin).sum()
        grad = np.concatenate([np.bincount(feats, ((one - y) * live).ravel()[cells], minlength=k), (two.sum((0, 1)) - gold).ravel(), np.array([(1 - one[:, 0]).sum(), one[:, 0].sum()]) - begin])
        return float(total.sum() - score + penalty / 2 * w @ w), grad + penalty * w

    w = minimised(loss, np.zeros(k + 6), rounds)
    return Field(dict(zip(names, w[:k].tolist(), strict=True)), w[k : k + 4].reshape(2, 2), w[k + 4 :])


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    """Pages of varied layouts with invented words; LABEL of the nearest element says 1 for the article, 0 for the rest."""
    rng = random.Random(seed)
    some = lambda a, b: " ".join("".join(rng.choice(("en", "ti", "la", "or", "ou", "ch", "é", "st", "ma", "ble")) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(a, b)))
    sentence = lambda a, b: some(a, b).capitalize() + rng.choice("...?!")
    link = lambda: f'<a href="/{some(1, 2)}">{some(1, 4)}</a>'
    named = lambda *words: rng.choice(('class="%s"', 'id="%s"', 'class="x %s"')) % rng.choice(words)

    def links(a: int, b: int) -> str:
        items = [link() for _ in range(rng.randrange(a, b))]
        return rng.choice(("<ul>%s</ul>" % "".join(f"<li>{x}</li>" for x in items), "<ul>%s</ul>" % "".join(f"<li>{x}" for x in items), " | ".join(items)))

    def rest(kind: str) -> str:
        tag, words, inner = {
            "menu": (rng.choice(("nav", "div", "ul")), ("nav", "menu", "navbar", "breadcrumb", "topbar"), links(3, 9)),
            "header": (rng.choice(("header", "div")), ("header", "masthead", "banner", "site-header"), f"<a href='/'>{some(1, 4)}</a>" + rng.choice(("", f"<p>{some(2, 7)}</p>", links(3, 6), f"<h1>{some(1, 4)}</h1>"))),
            "footer": (rng.choice(("footer", "div")), ("footer", "copyright", "legal", "site-footer"), rng.choice((f"&copy; {some(1, 3)} &middot; {sentence(3, 14)}", f"<p>&copy; {some(2, 6)}</p>{links(2, 6)}", f"<p>{sentence(5, 20)}</p>"))),
            "side": (rng.choice(("aside", "div")), ("sidebar", "widget", "related", "recommended", "popular"), f"<h3>{some(1, 4)}</h3>" + rng.choice((links(3, 8), f"<p>{sentence(5, 25)}</p>", f"<p>{sentence(5, 25)}</p>{links(2, 5)}"))),
            "notice": ("div", ("cookie", "notice", "consent", "gdpr", "popup", "alert"), rng.choice((f"<p>{sentence(8, 30)}</p>", sentence(8, 30))) + rng.choice(("", "<button>OK</button>", link()))),
            "advert": (rng.choice(("div", "aside", "section")), ("ad", "ads", "advert", "sponsor", "promo", "advertisement"), rng.choice((sentence(3, 15), f"<p>{sentence(4, 25)}</p>", link()))),
            "form": ("form", ("search", "newsletter", "subscribe", "login", "signup"), f"<label>{some(1, 4)}</label><input name=q>" + rng.choice(("", f"<p>{sentence(4, 15)}</p>")) + "<button>Go</button>"),
            "comments": (rng.choice(("section", "div", "ol")), ("comments", "comment", "comment-list", "discussion", "replies"), f"<h3>{some(1, 3)}</h3>" * (rng.random() < 0.6) + "".join(f'<div class="comment"><p>{sentence(4, 45)}</p></div>' if rng.random() < 0.6 else f"<p>{sentence(4, 45)}</p>" for _ in range(rng.randrange(1, 6)))),
            "share": (rng.choice(("div", "ul")), ("share", "social", "tags", "meta", "pagination"), links(2, 5)),
        }[kind]
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        return f"<{tag} {'' if bare else named(*words)} {LABEL}=0>{inner}</{tag}>"

    def article() -> str:
        out = [f"<h1>{some(3, 12)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 2, 4, 8, 16))):
            roll = rng.random()
            p = " ".join(sentence(2, 18) for _ in range(rng.randrange(1, 7)))
            if roll < 0.55:
                out.append(f"<p>{p}</p>")
            elif roll < 0.62:
                out.append(f"<p>{p}")
            elif roll < 0.7:
                out.append(f"<p><b>{sentence(1, 12)}<br><p>{p}</p>")
            elif roll < 0.76:
                out.append(f"<h2>{some(1, 8)}</h2><p>{p}</p>")
            elif roll < 0.8:
                out.append("<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(rng.randrange(2, 6))) + "</ul>")
            elif roll < 0.84:
                out.append(f"<blockquote>{p}</blockquote>")
            elif roll < 0.87:
                out.append(f"<p>{p} {link()} {some(3, 9)}.</p>")
            elif roll < 0.9:
                out.append(f"<figure><figcaption>{sentence(3, 12)}</figcaption></figure>")
            elif roll < 0.92:
                out.append("<table><tr>" + "".join(f"<td>{some(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            elif roll < 0.94:
                out.append(f"<pre>{p}</pre>")
            elif roll < 0.96:
                out.append(f"<p>{some(1, 3)}.</p>")
            else:
                out.append(rest(rng.choice(("advert", "side", "share", "notice", "form"))))
        return "".join(out)

    pages = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.55:
            body = f"<article {LABEL}=1>{article()}</article>"
        elif kind < 0.7:
            body = f"<main {LABEL}=1>{article()}</main>"
        elif kind < 0.9:
            body = f"<div {named('content', 'post', 'entry', 'story', 'article-body', 'main-text')} {LABEL}=1>{article()}</div>"
        else:
            body = f"<div {LABEL}=1>{article()}</div>"
        if rng.random() < 0.25:
            body = f'<div class="{rng.choice(("wrapper", "container", "page"))}">{body}{rest("side")}</div>'
        before = [rest(x) for x in ("header", "menu", "notice", "advert", "form") if rng.random() < 0.45]
        after = [rest(x) for x in ("share", "comments", "side", "advert", "form", "menu", "notice") if rng.random() < 0.3]
        rng.shuffle(after)
        pages.append(f"<html><head><title>{some(2, 8)}</title></head><body>{''.join(before)}{body}{''.join(after)}{rest('footer') if rng.random() < 0.8 else ''}</body></html>")
    return pages


def train(n: int = N_TRAIN, seed: int = 0) -> Field:
    return fit([blocks(p) for p in labelled_pages(n, seed)])


def main_text(field: Field, page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, field.decode(found), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns keep, text and n_chars for every row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(field or train())
    narrow = pages.select(*keep, text_or_empty(html_col).alias("__tw_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(shared.value, p) for p in batch.column("__tw_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(trimmed(run), f"{schema}, text string, n_chars long").select(*[F.col(c) for c in (*keep, "text", "n_chars")])
