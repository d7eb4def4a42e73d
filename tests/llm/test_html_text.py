"""HTML extraction: the field against brute force, held-out accuracy, odd pages."""

import itertools

import numpy as np
import pytest

from tidewheel.llm import html_text as H


@pytest.fixture(scope="module")
def field():
    return H.train()


def test_held_out_accuracy(field):
    pages = [H.blocks(p) for p in H.labelled_pages(200, seed=77)]
    pairs = [(b.label or 0, y) for p in pages for b, y in zip(p, field.decode(p), strict=True)]
    assert np.mean([a == b for a, b in pairs]) > 0.99


def test_viterbi_is_the_best_labelling(field):
    for page in H.labelled_pages(30, seed=5):
        p = H.blocks(page)[:9]
        got = field.decode(p)

        def score(labels, p=p):
            s = field.first[labels[0]] + sum(field.weights.get(f, 0.0) for b, y in zip(p, labels, strict=True) if y for f in b.features)
            return s + sum(field.steps[a, b] for a, b in itertools.pairwise(labels))

        assert score(got) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(p)))))


def test_blocks_of_odd_html():
    text = lambda page: [b.text for b in H.blocks(page)]
    assert text("") == [] and text("   ") == []
    assert text("plain &amp; simple &#233;&eacute;&nbsp;x") == ["plain & simple éé x"]
    assert text("<p>a<p>b<br>c</p>d") == ["a", "b c", "d"]
    assert text("<p>a<!-- <p>x</p> -->b<script>var t='</p>';</script>c") == ["abc"]
    assert text('<p title="a>b">x</p><style>p{}</style><script>never closed <p>y') == ["x"]
    assert text("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]
    assert text("<p><b>bold<p>not") == ["bold", "not"]
    assert text("1 < 2 and <p>3 > 2") == ["1 < 2 and", "3 > 2"]
    assert text("<p>x</p><!-- open") == ["x"]
    assert text("<div>" * 3000 + "deep") == ["deep"]


def test_only_raw_and_apart_elements_lose_their_text():
    text = lambda page: [b.text for b in H.blocks(page)]
    assert text('<p>one</p><svg class="i"/><p>two</p>') == ["one", "two"]
    assert text('<p>one</p><svg class="i"><style/><path d="x"/></svg><p>two</p>') == ["one", "two"]
    assert text("<p>one <math-x>new</math-x> <video-player src=a> two<p>three") == ["one new two", "three"]
    assert text("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then") == ["if x=1 then"]
    assert text("<p>one<video src=a><p>two<video>no <b>player</video> x<p>three") == ["one", "two x", "three"]
    assert text("<p>a<object><p>b<object>c</object>d</object>e<select><option>f</select>g") == ["aeg"]
    assert text("<title>t</title><script>a</script\n><p>x<SCRIPT>'</scripty>'</SCRIPT>y<template/>z") == ["xyz"]
    assert text("<video>" * 3000 + "<p>x" + "<iframe src=a></iframe>" * 3000) == ["x"]


def test_labels_of_input_pages_are_no_labels(spark, field):
    page = '<article><p>One two three four five.</p><table><tr><td data-label="Price">seven euros</td></tr></table><p data-tidewheel-article="x">Six.</p></article>'
    assert H.main_text(field, page) == H.main_text(field, page.replace(' data-label="Price"', "").replace(' data-tidewheel-article="x"', ""))
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert "seven euros" in H.extract(df, field).first().text
    assert {b.label for b in H.blocks(page)} == {None}


def test_extract(spark, field):
    article = "<article><h1>Title &lt;1&gt;</h1><p>One  two\nthree.</p><div class=ad>buy now.</div><p>Four five six seven eight nine.</p></article>"
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>home</a></li><li><a href=y>all</a></li></ul></nav>{article}<section class='comments'><p>I do not agree at all.</p></section><footer>&copy; us</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "z", 3), (2, None, None, "z", 3), (None, "v", "", "z", 3), (1, "u", page, "z", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in H.extract(df, field).collect()), key=str)
    want = "Title <1>\nOne two three.\nFour five six seven eight nine."
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert H.extract(df.limit(0), field).count() == 0
