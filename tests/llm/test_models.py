"""Learned operators: kernels against enumeration, held-out accuracy, planted cases."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from riskloom.llm import common, decontaminate, language_id, toxicity, url_filter
from tests.llm import data

SF = "/root/testdata/sf0.01"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(2, 2))
    emission, length = rng.normal(size=(3, 6)) * 2, np.array([6, 4, 1])
    p, inner = toxicity.marginals(emission, length, moves)
    pairs = np.zeros((2, 2))
    for k, n in enumerate(length):
        weight, hit = 0.0, np.zeros(n)
        own = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emission[k, t] * y[t] for t in range(n)) + sum(moves[y[t - 1], y[t]] for t in range(1, n)))
            weight += w
            hit += w * np.array(y)
            for t in range(1, n):
                own[y[t - 1], y[t]] += w
        assert np.allclose(p[k, :n], hit / weight)
        pairs += own / weight
    assert np.allclose(toxicity._pair_counts(p, inner, length, moves), pairs)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in rows)
    assert len(rows) > 50 and wrong <= 0.07 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_the_driver_does_not_fit(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.filter("char_length(text) <= 8000").join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").collect()
    want = toxicity.fit([r["text"] for r in rows], [r["toxic"] for r in rows])

    def held(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(toxicity, "fit", held)
    got = toxicity.train(docs, labels, per_label=10**6)
    assert got.weights.keys() == want.weights.keys() and np.allclose(got.head, want.head) and np.allclose(got.moves, want.moves)
    assert np.allclose([got.weights[k] for k in want.weights], list(want.weights.values()))
    assert toxicity.train(docs, labels.limit(0)).weights == {}


def test_spans_are_offsets():
    text = "Good day, you utter scum and trash!"
    p = np.array([float(w in ("scum", "trash")) for w in toxicity.TOKEN.findall(text)])
    assert [text[a:b] for a, b in toxicity.spans(text, p)] == ["scum", "trash"]
    assert toxicity.spans(text, np.ones(7)) == [(0, 34)]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 100 and right >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_undetermined_and_rejected(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34!"), (4, "a")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language_id.identify(docs, {"x": b"some words of x here", "y": b"quite other words"}).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[4]["lang_pred"] in ("x", "y")
    assert rows[4]["rejected"]


def test_leaks_of_edited_passages(spark):
    rng = random.Random(5)
    items = [(i, data.words(rng, 40, 10**6)) for i in range(12)]
    docs = [(i, data.words(rng, 200, 10**6)) for i in range(40)]
    planted = set()
    for i in range(12):
        w = items[i][1].split()
        for at in rng.sample(range(40), 4):
            w[at] = "changed"
        if i % 3 == 1:
            del w[10]
        docs.append((100 + i, data.words(rng, 90) + " " + " ".join(w).upper() + ", " + data.words(rng, 90)))
        planted.add((100 + i, i))
    docs.append((500, " ".join(t for _, t in items[:2]) * 2))
    planted |= {(500, 0), (500, 1)}
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == planted


def test_items_with_shared_and_null_ids(spark):
    rng = random.Random(6)
    passages = [data.words(rng, 30, 10**6) for _ in range(5)]
    large = 2**62 + 1  # no float holds it
    items = [(large, passages[0]), (large, passages[1]), (None, passages[2]), (None, passages[3]), (None, passages[3]), (7, passages[4])]
    docs = [(i, f"{data.words(rng, 50)} {p} {data.words(rng, 50)}") for i, p in enumerate(passages)] + [(9, data.words(rng, 100))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(0, large), (1, large), (2, None), (3, None), (4, 7)], key=str)
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()] == [9]


def test_alignment_against_table():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        assert decontaminate.align(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max() / len(a)


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://Example.ORG/es/1?x=1#y", "https://a.example.org/en/1", "https://example.org/en/2", "http://org", "ftp://x.com?a=/fr/",
        "http://x.com/fr/", "http://x.COM/de/9#a", "http://xcom/fr/", "http://h://x.org/", "http://#", "http://example.net/a.html",
        "http://notexample.org/es/1", "http://É.com/fr/ü",
    ]
    urls += [f"http://s{i}.example.{'org' if i % 2 else 'com'}/{['es', 'de', 'fr', 'en'][i % 4]}/{i}" for i in range(60)]
    rows = url_filter.judged(spark.createDataFrame([(i, u, 1, "h") for i, u in enumerate(urls)], "page_id long, url string, host int, path string")).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = brute_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or verdict == r["verdict"])


def test_trees_learn_the_rules_look(spark):
    rng = random.Random(1)
    rows = [(i, f"http://a{rng.randrange(50)}.com/{rng.choice(['fr', 'de'])}/{rng.randrange(10**5)}") for i in range(400)]
    rows += [(1000 + i, f"http://b{i}.net/{'fr' if i % 2 else 'de'}/{i}") for i in range(40)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).filter("page_id >= 1000").collect()
    assert sum((r["verdict"] == "allow") == bool(r["page_id"] % 2) for r in got) >= 38


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(1, "²"), (2, "½ 3"), (3, "٣ _"), (4, "é"), (5, "ﬁ 1")], "doc_id long, text string")
    samples = {"de": b"der die das und nicht ein", "en": b"the and of to in that is"}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, samples).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] != "und" and got[5][0] != "und"


def test_repeated_ids_send_one_excerpt_each(spark):
    docs = spark.createDataFrame([(1, f"ein deutscher satz nummer {i}", "de") for i in range(300)], "doc_id long, text string, lang string")
    assert len(language_id.learn(docs)["de"]) <= language_id.TRAIN_CHARS


def test_models_are_not_mixed_up(spark):
    docs = spark.createDataFrame([(1, "the and of to in that is")], "doc_id long, text string")
    for lang in ("aa", "bb", "cc"):
        assert language_id.identify(docs, {lang: b"the and of to in that is"}).first().lang_pred == lang


def test_chains_of_segments_equal_whole_chains():
    rng = np.random.default_rng(8)
    for size, lengths in ((4, [1, 4, 5, 8, 23, 3]), (1, [3, 1, 6]), (5, [2, 5]), (64, [200, 1, 64, 65])):
        moves = rng.normal(size=(2, 2)) * 2
        whole = rng.normal(size=(len(lengths), max(lengths))) * 3
        want, _ = toxicity.marginals(whole, np.array(lengths), moves)
        cut = [(k, a) for k, n in enumerate(lengths) for a in range(0, n, size)]
        rows, length = np.zeros((len(cut), size)), np.array([min(size, lengths[k] - a) for k, a in cut])
        for i, (k, a) in enumerate(cut):
            rows[i, : length[i]] = whole[k, a : a + length[i]]
        got = toxicity.chain_marginals(rows, length, np.array([a == 0 for _, a in cut]), moves)
        for i, (k, a) in enumerate(cut):
            assert np.allclose(got[i, : length[i]], want[k, a : a + length[i]])


def test_long_chains_stay_finite():
    n = 40_000
    emission = np.where(np.arange(n) % 7 < 3, 30.0, -30.0).reshape(-1, toxicity.SEGMENT)
    first = np.arange(len(emission)) == 0
    got = toxicity.chain_marginals(emission, np.full(len(emission), toxicity.SEGMENT), first, np.array([[3.0, -3.0], [-3.0, 3.0]]))
    assert np.isfinite(got).all() and got.min() >= 0 and got.max() <= 1


def test_neighbours_reach_across_segments():
    model = toxicity.Field({"w=bad": 6.0, "next=bad": 5.0, "prev=bad": 5.0}, np.array([[0.5, -0.5], [-0.5, 0.5]]))
    tagger = toxicity.Tagger(model)
    near = [tagger.probabilities([" ".join(["fine"] * n + ["bad"] + ["fine"] * 40)])[0][n - 1 : n + 2] for n in (40, 63, 64, 65, 128)]
    assert all(np.allclose(near[0], other, atol=1e-6) for other in near[1:])


def test_seeds_do_not_depend_on_the_size_of_the_corpus():
    rng = np.random.default_rng(3)
    items = [(i, (300 * rng.random(30) ** 4).astype(np.uint64)) for i in range(20)]
    counts = {w: int(10**5 / (w + 1)) for w in range(280)}
    total = sum(counts.values())
    small = decontaminate.Index(items, counts, total)
    assert 0 < len(small.grams) < sum(len(h) - 2 for _, h in items)
    for times in (100, 1000):
        large = decontaminate.Index(items, {w: times * c for w, c in counts.items()}, times * total)
        assert (small.grams == large.grams).all() and (small.owners == large.owners).all()


def test_lowest_hashes_keep_the_lowest(spark):
    rows = spark.range(20_000).selectExpr("id % 7000 as id", "if(id % 7000 % 10 = 0, 'few', 'many') as kind").selectExpr("*", "xxhash64(id) as h")
    for group in (None, "kind"):
        kept = common.lowest_hashes(rows, "h", 50, group)
        assert kept.columns == (["kind", "id", "h"] if group else ["id", "kind", "h"])
        assert kept.select("id").distinct().count() < 1_200
        for kind in ("few", "many") if group else (None,):
            of = lambda df: [r.h for r in (df.filter(f"kind = '{kind}'") if kind else df).select("h").distinct().orderBy("h").limit(50).collect()]  # noqa: E731, B023
            assert of(kept) == of(rows)
    assert common.lowest_hashes(rows.filter("id < 0"), "h", 50).count() == 0
    assert common.lowest_hashes(rows, "h", 10**6).count() == 20_000
