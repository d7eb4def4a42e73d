"""Exact dedup, MinHash near-dedup and paragraph dedup against brute force and odd inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import common, components, exact_dedup, near_dup, paragraphs, prob_minhash, queries, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key int, root string, rid long"


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + str(rng.randrange(40)) for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for base in range(25):
        w = words(rng, rng.choice([3, 6, 40, 200, 900]))
        rows.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            for _ in range(rng.randrange(0, max(2, len(w) // 40))):
                v[rng.randrange(len(v))] = rng.choice(w) + "x"
            rows.append(" ".join(v))
    rows += ["", None, "  ", "!!! ???", "a a a a a a a a a", "a a a a a a", "é" * 30000, rows[0], rows[1]]
    return rows


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, "d", 5, "r", -1) for i, t in enumerate(texts)], DOCS)


def classes_of(n, links):
    at = list(range(n))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def as_partition(pairs):
    groups = {}
    for i, c in pairs:
        groups.setdefault(c, set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_exact_dedup_matches_brute_force(spark):
    texts = corpus()
    df = frame(spark, texts)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert got[i].keep_id == max(same) and got[i].group_size == len(same) and got[i].kept == (i == max(same))
        assert bytes(got[i].digest) == hashlib.sha256((t or "").encode()).digest()


def test_exact_dedup_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "x"), (1, "x"), (1, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, False), (None, None, 2, True), (None, None, 2, False)], key=str)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(df).collect()), key=str) == [(1, "x"), (None, "y")]
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_index_persists_over_batches(spark):
    first = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    later = spark.createDataFrame([(3, "x"), (4, "z")], "doc_id long, text string")
    index = exact_dedup.new_index(spark, first)
    index.ingest(first)
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    batch = again.ingest(later)
    got = sorted((r.doc_id, r.keep_id, r.kept) for r in again.decide(later, batch).collect())
    assert got == [(3, 1, False), (4, 4, True)]
    assert again.read().count() == 3


def test_hot_digest_takes_the_broadcast_way(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(6000)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).groupBy("keep_id").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).where("n > 1").collect()
    assert [(r.keep_id, r.n, r.k) for r in got] == [(5999, 3000, 1)]


def test_word_and_shingle_hashes():
    texts = ["The cat, the CAT!", "", "a b c d e f", "x", "the cat the cat"]
    h, at = shingles.word_hashes(texts)
    assert np.diff(at).tolist() == [4, 0, 6, 1, 4]
    assert h[0] == h[2] and h[1] == h[3] and h[at[4]] == h[0]
    s, ends = shingles.shingles(h, at)
    assert np.diff(ends).tolist() == [1, 0, 2, 1, 1]
    assert s[ends[0]] == s[ends[4]]
    again, _ = shingles.word_hashes([texts[4]])
    assert again.tolist() == h[at[4] : at[5]].tolist()


def test_probability_jaccard():
    a = (np.array([1, 2, 3]), np.array([1, 1, 2]))
    b = (np.array([2, 3, 4]), np.array([3, 1, 1]))
    whole = {k: (dict(zip(*a, strict=True)).get(k, 0), dict(zip(*b, strict=True)).get(k, 0)) for k in (1, 2, 3, 4)}
    want = sum(1 / sum(max(x / xi, y / yi) for x, y in whole.values()) for xi, yi in whole.values() if xi and yi)
    assert near_dup.probability_jaccard(a, b) == pytest.approx(want)
    assert near_dup.probability_jaccard(a, (a[0], a[1] * 5)) == pytest.approx(1)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    wa, wb = rng.integers(1, 6, 200), rng.integers(1, 6, 200)
    sig = prob_minhash.signatures(np.concatenate([keys[:200], keys[100:]]), np.concatenate([wa, wb]), np.array([0, 200, 400]), 4000)
    order_a, order_b = np.argsort(keys[:200]), np.argsort(keys[100:])
    want = near_dup.probability_jaccard((keys[:200][order_a], wa[order_a]), (keys[100:][order_b], wb[order_b]))
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_near_dedup_matches_brute_force(spark):
    texts = corpus(2)
    sets = [shingles.counted(t or "") for t in texts]
    same = [t if not (t or "").strip(" !?") else shingles.word_hashes([t])[0].tobytes() for t in (x or "" for x in texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if same[i] == same[j] or len(sets[i][0]) and len(sets[j][0]) and near_dup.probability_jaccard(sets[i], sets[j]) >= 0.8]
    want = as_partition(enumerate(classes_of(len(texts), links)))
    rows = prob_minhash.class_ids(frame(spark, texts)).collect()
    assert as_partition((r.doc_id, r.class_id) for r in rows) == want
    assert sum(r.kept for r in rows) == len(want)
    again = prob_minhash.class_ids(frame(spark, texts).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    kept = prob_minhash.drop_near_copies(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns and kept.count() == len(want)


def test_near_dedup_of_a_chain_finds_links_between_inner_nodes(spark):
    rng = random.Random(5)
    w = words(rng, 200)
    texts = []
    for i in range(30):  # each is near to its neighbours, the ends are far apart
        texts.append(" ".join(w))
        for _ in range(3):
            w[rng.randrange(200)] = f"n{i}{rng.randrange(99)}"
    rng.shuffle(texts)
    sets = [shingles.counted(t) for t in texts]
    links = [(i, j) for i in range(30) for j in range(i) if near_dup.probability_jaccard(sets[i], sets[j]) >= 0.8]
    got = as_partition((r.doc_id, r.class_id) for r in prob_minhash.class_ids(frame(spark, texts)).collect())
    assert got == as_partition(enumerate(classes_of(30, links)))


def test_near_dedup_empty_and_null_ids(spark):
    df = frame(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert prob_minhash.class_ids(df).count() == 2
    assert prob_minhash.class_ids(df.limit(0)).count() == 0
    assert prob_minhash.drop_near_copies(df).count() == 1
    assert prob_minhash.drop_near_copies(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)]
    nodes = sorted({x for p in links if p[0] != p[1] for x in p})
    place = {x: i for i, x in enumerate(nodes)}
    want = classes_of(len(nodes), [(place[a], place[b]) for a, b in links if a != b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: nodes[want[place[x]]] for x in nodes}
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_index_reopens_under_other_settings(spark):
    docs = frame(spark, [f"text {i % 150}" for i in range(200)])
    index = exact_dedup.DigestIndex(spark, common.fresh_path(spark, "index"), buckets=8)
    first = index.ingest(docs, batch="a")
    n = index.read().count()
    spark.sql(f"DROP TABLE {index.table}")  # as in a new session
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        again = exact_dedup.DigestIndex(spark, index.path)
        assert again.buckets == index.buckets == 8 and again.read().count() == n == 150
        second = again.ingest(docs, batch="b")
        assert again.read().count() == n and again.decide(docs, second).where("kept").isEmpty()
        assert again.decide(docs, first).where("kept").count() == n
        again.ingest(docs.withColumn("text", F.concat("text", F.lit("!"))), batch="a")  # a batch of that name is there
        assert again.read().count() == n
        with pytest.raises(ValueError, match="8 buckets"):
            exact_dedup.DigestIndex(spark, index.path, buckets=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    again.drop()
    assert exact_dedup.DigestIndex(spark, index.path, buckets=3).read().count() == 0


def test_data_of_unknown_buckets_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="no index"):
        exact_dedup.DigestIndex(spark, path)


def brute_paragraphs(texts, least=paragraphs.MIN_PASSAGE):
    """{(document, line, piece): (place that stays, removed)} by comparing all pairs."""
    flat = [(i, k, j, p) for i, t in enumerate(texts) for k, line in enumerate(paragraphs.pieces(t or "")) for j, p in enumerate(line)]
    sets = [shingles.counted(p) for *_, p in flat]
    same = [tuple(shingles.word_hashes([p])[0].tolist()) or p.strip() for *_, p in flat]
    n = [len(shingles.word_hashes([p])[0]) for *_, p in flat]
    near = lambda i, j: min(n[i], n[j]) >= paragraphs.MIN_BANDED and near_dup.jaccard(sets[i], sets[j]) >= 0.8
    head = classes_of(len(flat), [(i, j) for i in range(len(flat)) for j in range(i) if same[i] and (same[i] == same[j] or near(i, j))])
    first = {}
    for x, h in enumerate(head):
        first.setdefault(h, x)
    out, x = {}, 0
    while x < len(flat):
        if first[head[x]] == x:
            out[flat[x][:3]] = (flat[x][:3], False)
            x += 1
            continue
        end = x
        while end < len(flat) and flat[end][0] == flat[x][0] and first[head[end]] != end:
            end += 1
        for y in range(x, end):
            out[flat[y][:3]] = (flat[first[head[y]]][:3], sum(n[x:end]) >= least)
        x = end
    return out


def test_paragraphs_match_brute_force(spark):
    rng = random.Random(4)
    pool = [words(rng, rng.choice([2, 4, 5, 7, 8, 13, 60, 120])) for _ in range(30)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 4])):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(9))
            lines.append(" ".join(w) + rng.choice([".", "! ", ""]))
        texts.append("".join(p + rng.choice(["\n", " "]) for p in lines))
    texts += ["", None, "\n\n", texts[0], texts[0], "A b. " * 20_000]
    want = brute_paragraphs(texts[:-1])
    rows = paragraphs.paragraph_classes(frame(spark, texts[:-1])).collect()
    assert {(r.doc_id, r.line, r.piece): ((r.class_id, r.class_line, r.class_piece), r.removed) for r in rows} == want
    assert any(r.removed for r in rows) and any(not r.removed and r.doc_id != r.class_id for r in rows)
    left = {r.doc_id: r.text for r in paragraphs.without_copies(frame(spark, texts)).collect()}
    for i, t in enumerate(texts[:-1]):
        lines = [(x, [p for j, p in enumerate(x) if not want[i, k, j][1]]) for k, x in enumerate(paragraphs.pieces(t or ""))]
        assert left[i] == "\n".join("".join(some) for x, some in lines if some)
    assert left[len(texts) - 1].strip() == " ".join(["A b."] * 5)  # of a long text the first piece and the shorter last one stay
    assert paragraphs.paragraph_classes(frame(spark, texts).limit(0)).count() == 0


def test_a_passage_within_lines_is_found(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join(words(rng, rng.randrange(5, 14))) + "."
    passage = " ".join(sentence() for _ in range(7))
    inside = [f"{sentence()[:-1]} {' '.join(words(rng, 3))} {passage} {' '.join(words(rng, 5))} {sentence()}" for _ in range(6)]
    other = [f"{sentence()} Shared words of any page here. {sentence()}" for _ in range(6)]
    rows = paragraphs.paragraph_classes(frame(spark, inside + other)).where("removed").select("doc_id").distinct().collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5}


def test_pieces_join_to_the_line():
    text = "One two. Three four five six! seven\n\nNo end here\nA. B. C. d e f g h. tail"
    assert ["".join(x) for x in paragraphs.pieces(text)] == text.split("\n")
    assert paragraphs.pieces(text)[0] == ["One two. Three four five six! ", "seven"]


def test_long_sentences_are_cut_by_their_words():
    rng = random.Random(5)
    passage = words(rng, 70)
    inside = [" ".join(words(rng, rng.randrange(30, 300)) + passage + words(rng, rng.randrange(30, 300))) for _ in range(8)]
    found = [set(paragraphs.pieces(t)[0]) for t in inside]
    common = set.intersection(*found)
    assert sum(len(p.split()) for p in common) >= 35  # but for what stands at its ends
    for t in [*inside, "  ".join(words(rng, 500)), "a b " * 400, "same " * 300, "é" * 100_000, "\u2003".join(passage), "x" * 90 + " y"]:
        assert "".join(paragraphs.pieces(t)[0]) == t and all(p.strip() for p in paragraphs.pieces(t)[0])
    assert paragraphs.pieces("same " * 300) == [["same " * 300]] and paragraphs.cuts("") == []


def test_a_passage_in_text_without_sentences_is_found(spark):
    rng = random.Random(6)
    passage = " ".join(words(rng, 80))
    mid = lambda: " ".join(words(rng, rng.randrange(40, 200)))
    texts = [f"{mid()} {passage} {mid()}" for _ in range(6)] + [mid() for _ in range(12)]
    rows = paragraphs.paragraph_classes(frame(spark, texts)).where("removed").select("doc_id").distinct().collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5}


def test_short_pieces_have_classes_and_stay(spark, tmp_path):
    texts = ["Read more\n\n---\none two three four five", "read  more!\n \n***", "---\nread\n\none two three four five", None]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r.doc_id, r.line, r.piece): ((r.class_id, r.class_line, r.class_piece), r.removed) for r in queries.QUERIES["op1_paragraph_dedup"](spark, str(tmp_path)).collect()}
    assert rows == brute_paragraphs(texts)
    assert rows[1, 0, 0] == ((0, 0, 0), False) and rows[2, 0, 0] == ((0, 2, 0), False)


def test_no_pair_of_pieces_is_left_out(spark):
    rng = random.Random(12)
    texts = ["ha " * 5, "ha " * 6, "a b a b a b a", "b a b a b a b"]  # equal sets of shingles
    for n in (5, 8, 9, 12, 13, 14, 20, 30, 40):
        for _ in range(12):
            w = words(rng, n)
            texts += [" ".join(x) for x in (w, [*w, "more"], ["more", *w], [*w[:-1], "last"], ["first", *w[1:]])]
    want = brute_paragraphs(texts)
    rows = paragraphs.paragraph_classes(frame(spark, texts)).collect()
    assert {(r.doc_id, r.line, r.piece): ((r.class_id, r.class_line, r.class_piece), r.removed) for r in rows} == want
    assert want[1, 0, 0][0] == (0, 0, 0)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9, 1.0])
def test_similar_pieces_share_a_least_shingle(similarity):
    rng = random.Random(14)
    texts = []
    for _ in range(120):
        w = words(rng, rng.randrange(5, 60))
        texts += [" ".join(w), " ".join(w[rng.randrange(3) :]), " ".join([*w, "x y"]), " ".join(x if rng.random() > 0.02 else "z" for x in w)]
    hashes, starts = shingles.shingles(*shingles.word_hashes(texts))
    sets = [shingles.counted(t) for t in texts]
    some = np.unique(hashes)[::3]
    for frequent in ((some[:0], some[:0]), (some, np.arange(len(some), dtype=np.uint64) + np.uint64(3))):
        values, ends, size = paragraphs.least_shingles(hashes, starts, similarity, frequent)
        least = [set(x.tolist()) for x in np.split(values, ends[1:-1])]
        assert size.tolist() == [len(keys) for keys, _ in sets]
        links = [(i, j) for i in range(len(texts)) for j in range(i) if near_dup.jaccard(sets[i], sets[j]) >= similarity]
        assert len(links) > 100 or similarity == 1
        assert all(least[i] & least[j] for i, j in links)
    a, b = zip(*[(texts[i], texts[j]) for i in range(40) for j in range(40)], strict=True)
    assert paragraphs.jaccards(list(a), list(b)).tolist() == [near_dup.jaccard(sets[i], sets[j]) for i in range(40) for j in range(40)]
    assert paragraphs.jaccards(["", "x " * 300_000], ["a", "x " * 300_000]).tolist() == [0.0, 1.0] and paragraphs.jaccards([], []).tolist() == []


def test_frequent_shingles_are_those_of_most_pieces(spark):
    common = "one two three four five six seven"
    docs = frame(spark, [f"{common} v{i}." for i in range(20)] + [f"{common} v0."] * 50 + [None, ""]).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    keys, n = paragraphs.frequent_shingles(docs.coalesce(1))
    assert keys.tolist() == sorted(shingles.counted(common)[0].tolist()) and set(n.tolist()) == {20}
    few, _ = paragraphs.frequent_shingles(docs.coalesce(1), rows=1)
    assert len(few) <= 3 and len(paragraphs.frequent_shingles(docs.limit(0))[0]) == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_deals_a_hot_key_and_returns_each_row_once(spark, how):
    rows = spark.range(6000).select(F.col("id").alias("rid"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"))
    table = spark.createDataFrame([(0, 3000, "hot")] + [(i, 1, f"t{i}") for i in range(1, 6000, 4)], "key long, n long, name string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = common.join_spread(rows, table, "key", "n", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "key", how).collect()))
        assert got.where("key = 0").select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftOuter" in plan.split("BroadcastHashJoin")[1].split("\n")[0]  # no join of hot rows alone
        assert common.join_spread(rows.limit(0), table.limit(0), "key", "n", how).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_classes_of_pieces_join_all_rows_at_once(spark):
    texts = ["Some words that all documents have."] * 3000 + [f"Only here {i}." for i in range(3000)]
    items = paragraphs.prepared(frame(spark, texts).select("doc_id", "text"))
    found = near_dup.near_classes(items, near_dup.Measure(paragraphs.distinct_shingles, near_dup.jaccard, 0.8, sets=True, pairs=paragraphs.jaccards), common.join_spread)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "LeftAnti" not in plan and "Union" not in plan
    assert found.groupBy("root").count().where("root IS NOT NULL").collect()[0]["count"] == 3000 and found.count() == 6000
