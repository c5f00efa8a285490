"""Each corpus operator against brute force, and on awkward tables."""

import hashlib
import html
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.graph import connected
from tessera.llm import bitslice, crf, jaccard, licenses, mincut, mixing, packing, quality, sharding, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bin string, _k1 string, label double"


def words(n, seed=0, pool=400):
    rng = np.random.default_rng(seed)
    return " ".join("w" + "".join(chr(97 + int(c)) for c in str(k)) for k in rng.integers(0, pool, n))


def docs():
    """Copies, near copies, shared passages, empty, blank, null and long texts, null ids and sources, repeated rows."""
    base = words(120, 1, 10**6)
    passage = words(30, 2, 10**6)
    near = base.split()
    near[60] = "changed"
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: words(80, 3, 10**6) + "\n" + passage, 5: passage + " " + words(90, 4, 10**6),
        6: "", 7: " \t\n", 8: None, 9: "one two", 10: "One  TWO", 11: words(6000, 5, 10**6), 12: "xéß " * 60,
        13: "line a\nline a\nline b\n" * 12, 14: "The The The " * 40, 15: words(200, 6, 10**6) + " " + base[: len(base) // 2],
    }
    rows = [(i, t, "en" if i % 2 else None, "hot" if i % 3 else None, len(t or ""), -1, "b", "k", 0.5) for i, t in texts.items()]
    rows.append(rows[0])
    rows.append((None, base, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# Language.


def test_language_of_held_out_texts(spark):
    rng = np.random.default_rng(0)
    vocab = {"aa": ["the", "and", "thing", "other"], "bb": ["der", "und", "schon", "nicht"], "cc": ["el", "que", "cion", "para"]}
    rows = [(i, " ".join(rng.choice(vocab[k], 40)), k) for i in range(200) for k in [["aa", "bb", "cc"][i % 3]]]
    rows += [(900, None, None), (901, "12 34 !", "aa"), (902, "", None)]
    out = {r["doc_id"]: r for r in crf.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, lang in rows[:200]:
        assert out[i]["lang_pred"] == lang and 0 <= out[i]["score"] <= 1
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    scores, t = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    node, pairs = crf.marginals(scores, first, t, pairs=True)
    want, want_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 7)):
        total, part, part_pairs = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * (b - a)):
            w = np.exp(sum(scores[a + i, s] for i, s in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += w
            for i, s in enumerate(path):
                part[i, s] += w
            for x, y in zip(path, path[1:], strict=False):
                part_pairs[x, y] += w
        want[a:b], want_pairs = part / total, want_pairs + part_pairs / total
    assert np.allclose(node, want) and np.allclose(pairs, want_pairs)


def test_code_switching_is_labelled_word_by_word():
    model = crf.fit(["the and of with " * 10, "der und nicht mit " * 10], ["en", "de"], bits=14)
    dictionary, codes, counts = crf.words_of(pa.array(["the and of der und nicht"]))
    node, _ = crf.marginals(crf.word_scores(*crf.features(dictionary, 14), model.weights)[codes], np.arange(6) == 0, model.transitions)
    assert [model.languages[i] for i in node.argmax(axis=1)] == ["en"] * 3 + ["de"] * 3


def test_training_takes_distinct_texts_of_every_language(spark):
    rows = [(f"text {i}", "aa" if i % 2 else "bb") for i in range(4000)]
    df = spark.createDataFrame(rows, "text string, lang string")
    first = df.orderBy(F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 11)).first()
    rows += [(first["text"], first["lang"])] * 3000 + [("a rare text", "cc")] + [(f"other {i}", "dd") for i in range(9)]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("held_out", F.lit(False))
    texts, langs = crf.training_sample(df, 100)
    count = Counter(langs)
    assert len(set(texts)) == len(texts) == 100 and count["cc"] == 1 and count["dd"] == 9 and count["aa"] == count["bb"] == 45
    texts, langs = crf.training_sample(df, 3)
    assert len(texts) == 3 and len(set(langs)) == 3
    assert crf.training_sample(df.limit(0), 100) == ([], [])


def test_transitions_learn_to_switch(spark):
    rng = np.random.default_rng(5)
    vocab = {"en": "the and of with this that".split(), "de": "der und nicht mit das ist".split()}
    texts, langs = zip(*[(" ".join(rng.choice(vocab[k], 30)), k) for k in ("en", "de") * 20], strict=True)
    alone = crf.fit(list(texts), list(langs), bits=14)
    model = crf.fit(list(texts), list(langs), crf.switched(list(texts), list(langs), 40), bits=14)
    stay = lambda m: m.transitions[0, 0] - m.transitions[0, 1]
    assert 0.3 < stay(model) < stay(alone)
    got, _, spans = crf.predict(model, pa.array(["the and of this der und nicht das ist mit", None, "", "12 ?", "der zzz nicht"]))
    assert spans.to_pylist()[0] == [{"lang": "en", "n_words": 4}, {"lang": "de", "n_words": 6}] and spans.to_pylist()[1:3] == [[], []] and got[0] == "de"
    # A word that nobody knows goes with its neighbours: by transitions alone.
    assert spans.to_pylist()[4] == [{"lang": "de", "n_words": 3}]


def test_language_of_awkward_tables(spark, frame, empty):
    assert crf.identify(empty).collect() == []
    long = words(60_000, 7)
    rows = [(1, long, "xx"), (1, long, "xx"), (None, "der und", "de"), (2, "the and", None), *[(10 + i, "der und nicht " * 5, "de") for i in range(20)]]
    clash = spark.createDataFrame([(*r, "a", 0.5, "b") for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, spans string")
    out = crf.identify(clash)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["doc_id", "held_out", "lang_pred", "score", "spans"]
    assert {r["lang_pred"] for r in got if r["doc_id"] is None} == {"de"} and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert [sum(x["n_words"] for x in r["spans"]) for r in got if r["doc_id"] == 1] == [60_000] * 2
    assert crf.identify(frame).count() == len(docs())
    texts, _ = crf.training_sample(clash.withColumn("held_out", F.lit(False)), 100, 50)
    assert max(len(t.split()) for t in texts) == 50


# Quality.


def brute_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(frame):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = collect(quality.judge(frame), "doc_id", *names, "base_failed", "kept")
    assert Counter((r[0], *r[1:6]) for r in out) == Counter((d[0], *brute_counts(d[1])) for d in docs())
    for r in out:
        assert r[6] == (r[1] < 50 or 100 * r[5] > 50 * r[1]) and not (r[6] and r[7])


def test_posteriors_equal_em_over_documents(spark):
    """The same model by dense arrays, a row for each document."""
    rng = np.random.default_rng(6)
    ends = ["", "", ".", "###", "!", "9", ",", "\n"]
    texts = [" ".join(w.upper() + e if u < p[0] / 2 else w + e for w, e, u in zip(words(int(rng.integers(20, 150)), i, 10**6).split(), rng.choice(ends, p=p, size=150), rng.random(150), strict=False)) for i, p in enumerate(rng.dirichlet([0.6] * 8, 300))]
    out = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values("doc_id")
    keyed = quality.with_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumns({f"v_{k}": v for k, v in quality.rules().items()}).toPandas().sort_values("doc_id")
    votes = keyed[[f"v_{k}" for k in quality.rules()]].to_numpy(float)
    use = ~out["base_failed"].to_numpy(bool)
    v = votes[use]
    good = np.array([0.95, 0.6, 0.05])[np.minimum(2, (v == 0).sum(axis=1))]
    for _ in range(300):
        prior = np.log((good.sum() + 1) / ((1 - good).sum() + 1))
        rate = lambda w, k: ((w[:, None] * (v == k)).sum(axis=0) + 1) / ((w[:, None] * (v >= 0)).sum(axis=0) + 2)
        yes, no = np.log(rate(good, 1) / rate(1 - good, 1)), np.log(rate(good, 0) / rate(1 - good, 0))
        good = 1 / (1 + np.exp(-np.clip(prior + np.where(v == 1, yes, 0).sum(axis=1) + np.where(v == 0, no, 0).sum(axis=1), -500, 500)))
    assert 20 < use.sum() < 300 and np.allclose(out["posterior"].to_numpy(float)[use], good, atol=1e-6)
    assert (out["kept"].to_numpy(bool) == (use & (out["posterior"].to_numpy(float) >= 0.5))).all()


def test_em_finds_bad_patterns():
    rng = np.random.default_rng(1)
    patterns = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = tuple(None if rng.random() < 0.2 else int(rng.random() < (0.97 if good else 0.25)) for _ in range(5))
        patterns[votes] += 1
    prior, odds = quality.fit(dict(patterns), 5)
    assert abs(1 / (1 + np.exp(-prior)) - 0.8) < 0.05
    assert all(abs(a - 0.97) < 0.03 and abs(b - 0.75) < 0.08 for _, _, a, b in odds)


def test_quality_keeps_rows_whole(frame, empty):
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns
    ids = {r["doc_id"] for r in quality.judge(frame).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == ids and 1 in ids and kept.where("doc_id = 1").count() == 2
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


# Sharding.


def test_shards_are_even_and_complete(spark, frame, empty):
    rows = [(i, words(int(n), i)) for i, n in enumerate(np.random.default_rng(2).integers(1, 400, 600))] + [(10_000 + i, "copy " * 300) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(df).toPandas()
    size = {i: len(t.encode()) + 1 for i, t in rows}
    assert dict(zip(out.doc_id, out["size"], strict=True)) == size
    assert dict(zip(out.doc_id, out.text_crc32, strict=True)) == {i: zlib.crc32(t.encode()) for i, t in rows}
    loads = out.groupby("shard")["size"].sum()
    assert set(loads.index) == set(range(8)) and loads.max() - loads.min() <= max(size.values()) + 0.02 * loads.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard(empty).count() == 0
    small = sharding.shard(frame)
    assert small.count() == len(docs()) and small.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_shards_do_not_depend_on_the_sample(spark, frame):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(sharding.shard(frame, oversample=2)) == key(sharding.shard(frame, oversample=64))


# Near duplicates.


def brute_components(rows):
    low = {c: c + 32 for c in range(65, 91)}
    sets = defaultdict(list)
    for doc, text, *_ in rows:
        w = WORD.findall((text or "").translate(low))
        sets[doc].append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    key = lambda d: float("inf") if d is None else d
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if key(a) < key(b) and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)), key=key)
                root[y] = x
    return {d: find(d) for d in sets}


def near_rows():
    rows, rng = [], np.random.default_rng(8)
    for f in range(6):
        base = words(100, 100 + f, 10**6).split()
        for k in range(40):
            w = list(base)
            for p in rng.integers(0, 100, rng.integers(0, 5)):
                w[p] = f"e{rng.integers(10**6)}"
            rows.append((f * 1000 + k, " ".join(w)))
    return rows + [(9000 + i, words(60, 500 + i, 10**6)) for i in range(60)]


@pytest.mark.parametrize(("chunk_bytes", "hot_level"), [(2000, jaccard.HOT_LEVEL), (1 << 20, jaccard.HOT_LEVEL), (1 << 20, 6)])
def test_components_equal_brute_force(spark, chunk_bytes, hot_level):
    """The last case deals the lists of all tokens of three documents or more."""
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert dict(collect(jaccard.join_components(df, chunk_bytes=chunk_bytes, hot_level=hot_level), "doc_id", "component_id")) == brute_components(rows)


def test_nothing_is_left_behind(spark, frame):
    before = {t.name for t in spark.catalog.listTables()}
    assert jaccard.join_components(frame).count() == len(docs())
    assert {t.name for t in spark.catalog.listTables()} == before


def test_chunk_numbers_name_their_buckets(spark):
    x = np.array([0, 1, 7, (3 << 32) + 5, 2**40 + 1, 2**62], np.int64)
    out = spark.createDataFrame([(int(v),) for v in x], "x long").selectExpr("pmod(hash(x), 51) b").collect()
    assert [r["b"] for r in out] == suffixes.bucket_of(x, 51).tolist()
    numbers = suffixes._numbers(3, 51)
    first = np.array([next(numbers) for _ in range(40)])
    assert len(set(first)) == 40 and len(set(suffixes.bucket_of(first, 51))) == 1 and (first >> 32 == 3).all()


def test_components_of_awkward_rows(frame, empty):
    out = collect(jaccard.join_components(frame), "doc_id", "component_id", "n_shingles")
    want = brute_components(docs())
    assert len(out) == len(docs()) and all(want[d] == c for d, c, _ in out)
    assert {d: n for d, _, n in out}[7] == 0 and {d: n for d, _, n in out}[9] == 1
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d in want if want[d] == d)
    assert jaccard.join_components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 50)]
    assert np.array_equal(jaccard.overlaps(sets, sets, step=7), [[len(np.intersect1d(a, b)) for b in sets] for a in sets])


def test_connected_path_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    for last in (5, 1000):
        out = dict(collect(connected(spark.createDataFrame(edges, "a long, b long"), last_edges=last), "node", "component"))
        assert out == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# Main text.


PAGE = """<html><head><title>T</title><style>p{x}</style></head><body><header><h1>Site name</h1></header>
<nav><ul><li><a href=a>Home</a></li></ul></nav><div id="main"><article><h1>Title &amp; more</h1><p>A first paragraph of some length, with <b>bold
 words</b> and an&nbsp;end.<p>Short.<div class="ad">Buy this great thing now, it is the best thing of all.</div>
<p>5 &lt; 6 &#233;t&eacute;, says this other paragraph of the text.</p><!-- note --><form><p>Sign up for news</p></form></article>
<section class="comments"><p>I liked this article very much, thank you for writing it.</p></section></div>
<aside>Related things to read</aside><footer>&copy; 2020 Someone</footer><script>var a="<p>no</p>";</script></body></html>"""


def test_main_text_of_a_page():
    assert mincut.main_text(PAGE) == "Title & more\n\nA first paragraph of some length, with bold words and an end.\n\nShort.\n\n5 < 6 été, says this other paragraph of the text."


ARTICLE = """<body><nav><a href=x>Home</a></nav><article><h1>On laws</h1><p>First paragraph with several words in it, as usual.</p>
<div class="search-results"><p>The search went on for a long time, and gave results that nobody expected.</p></div>
<div class="legal-history"><p>Law has a long history, which is told here.</p><p>Short.</p></div><section id="social-policy"><p>Social policy is the matter here.</p></section>
<ul><li>one item<li>another</ul><svg><text>Drawn words</text></svg> <object>Words of an object</object><p>x</p><div class="ad">Buy this great thing now, it is the best thing of all.</div>
<p>End of text.</p><div class="comments"><p>I liked this article very much, thank you for writing it.</p><p>I too liked it, thank you for writing such a text.</p></div></article>
<div class="content"><p>Not hidden by its place, a paragraph of some length after the article.</p></div><footer>Bottom line, a sentence of the footer.</footer></body>"""


def test_names_weigh_but_do_not_veto():
    texts, n, changed = mincut.main_blocks(ARTICLE)
    assert texts == [
        "On laws", "First paragraph with several words in it, as usual.", "The search went on for a long time, and gave results that nobody expected.",
        "Law has a long history, which is told here.", "Short.", "Social policy is the matter here.", "one item", "another", "Drawn words Words of an object", "x", "End of text.",
        "Not hidden by its place, a paragraph of some length after the article.",
    ]
    assert n == 17 and changed >= 8


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x text", "<a " * 100_000, '<a href="' * 30_001 + ">", """<a "'> <b '">""" * 20_000, "<div>some words here." * 20_000, "<p><table><td>" + "<div>" * 50_000, "<script>" * 3 + "<svg>" * 50_000, "<b>" * 20_000 + "<div></b>" * 20_000, "<!-- <" * 50_000, "<ul>" + "<li>x y z." * 30_000], ids=range(10))
def test_long_and_deep_pages_take_linear_time(page):
    began = time.process_time()
    mincut.main_blocks(page)
    assert time.process_time() - began < 8


def test_text_of_the_pages_is_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r["page_id"]: r for r in mincut.extract(pages.withColumn("text", pages["url"])).collect()}
    for r in pages.collect():
        body = re.sub(r"</?b>", "", r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]).replace("<br>", " ")
        blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert out[r["page_id"]]["text"] == "\n\n".join(x for x in blocks if x)
        assert out[r["page_id"]]["n_changed"] > 0


def test_fit_of_the_classifier():
    assert mincut.fit([]) is mincut.START and mincut.fit([(3, 0, 1, 1, 50)]) is mincut.START
    w = mincut.fit([(1, 8, 0, 0, 900), (1, 0, 0, 0, 30), (6, 0, 1, 1, 400), (2, 0, 1, 1, 20)])
    score = lambda *x: float(np.dot(w, (1, *x)))
    assert score(6, 0, 1) > 1 > -1 > score(1, 8, 0)


def test_min_cut_is_minimal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        scores = rng.integers(-9, 10, n).tolist()
        edges = {(i, j): int(rng.integers(0, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda lab, s=scores, e=edges: sum(-x for x, k in zip(s, lab, strict=True) if k) + sum(c for (i, j), c in e.items() if lab[i] != lab[j])
        best = min(cost(lab) for lab in np.ndindex(*[2] * n))
        assert cost(mincut.min_cut(scores, edges)) == best


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "v", "<p>unclosed <b>text that is long enough to be content, surely"), (None, "w", "<<<>>> & <!-- never ends"), (1, "u", PAGE)]
    out = mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 6 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert {r["text"] for r in out if r["page_id"] in (2, 3)} == {""}
    assert mincut.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Top k.


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=16) * 0.3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 16), (450, [0.0] * 16), (None, [1.0] * 16), (500, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in usable:
        if q % 50 == 0:
            best = sorted(((-int((x * y).sum()), c) for c, y in usable if c != q))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    df = df.withColumn("score", F.lit(0)).withColumn("ids", F.lit("clash"))
    for block_rows, tasks in ((100, 2), (1 << 16, 7), (100, None)):
        out = bitslice.top_k(df, df.where("vec_id % 50 = 0"), block_rows=block_rows, queries_per_block=3, tasks=tasks)
        assert sorted(collect(out, "query_id", "rank", "vec_id", "score")) == sorted(want)
    twice = bitslice.top_k(df, df.where("vec_id = 50").unionByName(df.where("vec_id = 50")))
    assert twice.count() == 5
    assert bitslice.top_k(df.limit(0), df.limit(0)).count() == 0


# Packing.


def test_packing_is_complete_and_compatible(frame, empty):
    out = packing.pack(frame, capacity=256, per_source=2).toPandas()
    size = Counter()
    for d in docs():
        size[d[0]] += len(WORD.findall(d[1] or ""))
    got = out.fillna({"doc_id": -1}).groupby("doc_id")["length"].sum().to_dict()
    assert {(-1 if k is None else k): v for k, v in size.items()} == got
    full = out[out["bin"].notna()]
    assert full.groupby("bin")["length"].sum().max() <= 256
    text = {d[0]: d[1] for d in docs()}
    for _, g in full.groupby("bin"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]
        clusters = [text[None if np.isnan(i) else int(i)] for i in g["doc_id"].astype(float)]
        assert len(set(clusters)) == len(clusters) and g["source"].fillna("null").value_counts().max() <= 2
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    placed = packing.best_fit([(60, 0, 0), (50, 1, 1), (40, 2, 1), (40, 2, 2), (45, 3, 3)], 100, 1)
    assert placed == [(0, 0), (1, 0), (0, 60), (1, 50), (2, 0)]
    rng = np.random.default_rng(0)
    pieces = sorted(((int(n), int(s), int(c)) for n, s, c in zip(rng.integers(1, 60, 300), rng.integers(0, 5, 300), rng.integers(0, 80, 300), strict=True)), reverse=True)
    bins: list[list] = []
    for (length, source, cluster), (b, offset) in zip(pieces, packing.best_fit(pieces, 100, 2), strict=True):
        room = lambda x: 100 - sum(p[0] for p in x)
        fits = [i for i, x in enumerate(bins) if room(x) >= length and all(p[2] != cluster for p in x) and sum(p[1] == source for p in x) < 2]
        assert (room(bins[b]) == min(room(bins[i]) for i in fits) and b in fits) if fits else b == len(bins)
        if b == len(bins):
            bins.append([])
        assert offset == 100 - room(bins[b])
        bins[b].append((length, source, cluster))


# Licenses.


def brute_licenses(text):
    """(template, first word, words, containment) from every window of every template's length, cut by the text's ends."""
    plain = lambda x: re.findall(r"[^\W_]+", x.lower())
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    w = grams(plain(text or ""))
    found = {}
    for t, (_, _, body) in enumerate(licenses.TEMPLATES):
        want = set(grams(plain(body)))
        n = len(grams(plain(body)))
        for start in range(-n, len(w)):
            first, last = max(0, start), min(len(w), start + n)
            c = len(want.intersection(w[first:last])) / len(want)
            if c >= 0.75 and (c, -last) > found.get((t, first), (0, 0)):
                found[t, first] = (c, -last)
    out = []
    for (t, first), (c, last) in sorted(found.items(), key=lambda x: (-x[1][0], x[0][1] + x[1][1], x[0][1], x[0][0])):
        n = -last - first + 2
        if all(first + n <= p or p + m <= first for _, p, m, _ in out):
            out.append((licenses.TEMPLATES[t][0], first, n, c))
    return set(out)


def test_licenses_equal_a_scan_of_all_windows(spark):
    rng = np.random.default_rng(11)
    filler = lambda n: words(n, int(rng.integers(10**6)), 10**6)
    texts = [None, "", "all rights", filler(9), "ALL RIGHTS RESERVED", filler(5000) + " Released under the MIT License. " + filler(5000)]
    for k in range(240):
        w = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][2].split()
        for _ in range(int(rng.integers(0, 3))):  # words change, go, or come
            at = int(rng.integers(len(w)))
            w[at : at + int(rng.integers(0, 2))] = [f"new{k}"] * int(rng.integers(0, 2))
        w = w[int(rng.integers(0, 3)) :][: len(w) - int(rng.integers(0, 4))]
        texts.append(" ".join([filler(int(rng.integers(0, 2) * 20)), *w, filler(int(rng.integers(0, 2) * 20))]))
    texts.append(texts[-1])
    # A clashing column and rows in several parts; the grant that lacks its last word at the end of a text.
    grant = next(x for n, _, x in licenses.TEMPLATES if n == "mit-grant")
    texts.append("Some words before. " + grant.rsplit(" ", 1)[0])
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, template string").repartition(3)).collect():
        got[r["doc_id"]].add((r["template"], r["start_word"], r["n_words"], r["containment"]))
    want = {i: found for i, t in enumerate(texts) if (found := brute_licenses(t))}
    assert len(want) > 90 and dict(got) == want
    assert any(t == "mit-grant" for t, *_ in got[len(texts) - 1])
    assert licenses.collision_probability(0.6) > 0.999
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Mixing.


def test_mix_meets_its_targets(spark, frame, empty, monkeypatch):
    rows = [(i, words(int(n), i), f"s{i % 4}" if i % 5 else None) for i, n in enumerate(np.random.default_rng(1).integers(0, 90, 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mix(df).toPandas()
    total = plan["size"].sum()
    by = plan.assign(source=plan["doc_id"].map({i: s or "zz" for i, _, s in rows})).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by["target"].sum() - 1.5 * total) < 1e-6 and (abs(by["taken"] - by["target"]) <= 1).all() and (by["target"] <= 2 * by["size"] + 1e-9).all()
    assert (plan["taken"] <= 2 * plan["size"]).all()
    free = by[by["target"] < 2 * by["size"] - 1e-6]
    weights = dict(zip(sorted(by.index), [3, 1, 2, 3, 1], strict=True))
    assert len({round(t / weights[s], 4) for s, t in free["target"].items()}) <= 1
    again = mixing.plan_mix(df.repartition(7), range_rows=3).toPandas()
    assert dict(zip(again.doc_id, again.taken, strict=True)) == dict(zip(plan.doc_id, plan.taken, strict=True))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    many = mixing.plan_mix(df).toPandas()
    assert dict(zip(many.doc_id, many.taken, strict=True)) == dict(zip(plan.doc_id, plan.taken, strict=True))
    mixed = mixing.mix(df).toPandas()
    assert mixed["text"].map(lambda t: len(WORD.findall(t))).groupby(mixed["doc_id"]).sum().to_dict() == {d: t for d, t in zip(plan.doc_id, plan.taken, strict=True) if t}
    awkward = mixing.mix(frame)
    assert awkward.columns == frame.columns
    assert sum(len(WORD.findall(r["text"])) for r in awkward.collect()) == mixing.plan_mix(frame).agg({"taken": "sum"}).first()[0]
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


# Repeated passages.


def brute_repeats(rows):
    key = lambda d: float("inf") if d is None else d
    first = {}
    for doc, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, float("inf")), key(doc))
    out = []
    for doc, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(doc):
                gone[i : i + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    for n, high, width in ((0, 2, 3), (1, 2, 3), (500, 2, 4), (2000, 5, 3), (3000, 2**63, 2), (700, 1, 5)):
        words = rng.integers(0, high, (n, width)).astype(np.uint64)
        for w in (words, np.sort(words, axis=0), words[::-1]):
            order = suffixes.multikey_quicksort(w)
            assert sorted(order.tolist()) == list(range(n)) and w[order].tolist() == sorted(w.tolist())


@pytest.mark.parametrize(("chunk_bytes", "hot_chunks"), [(500, suffixes.HOT_CHUNKS), (1 << 20, suffixes.HOT_CHUNKS), (500, 2), (500, 5)])
def test_repeats_equal_brute_force(spark, chunk_bytes, hot_chunks):
    """The last cases deal the strings of anchors that so few chunks share."""
    rng = np.random.default_rng(9)
    passages = ["".join(rng.choice(list("abcde é"), n)) for n in (49, 50, 51, 80, 200)]
    rows = [(int(i), "".join("".join(rng.choice(list("abcdefgh "), rng.integers(0, 60))) + passages[rng.integers(5)] for _ in range(rng.integers(0, 4)))) for i in rng.permutation(60)]
    rows += [(70, "a" * 300), (71, "a" * 120), (72, "ab" * 100), (73, "ab" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suffixes.remove_repeats(df, chunk_bytes=chunk_bytes, hot_chunks=hot_chunks)
    assert sorted(collect(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(brute_repeats(rows))


def test_repeats_of_awkward_rows(frame, empty):
    out = suffixes.remove_repeats(frame)
    assert Counter(collect(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == Counter(brute_repeats(docs()))
    left = suffixes.without_repeats(frame)
    assert left.columns == frame.columns and left.count() == len(docs())
    texts = {r["doc_id"]: r for r in left.collect()}
    assert texts[1]["text"] == docs()[0][1] and texts[2]["text"] == "" and texts[8]["text"] is None and texts[1]["_k1"] == "k"
    assert suffixes.remove_repeats(empty).count() == 0 and suffixes.without_repeats(empty).count() == 0
