"""Exact, near and substring duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import exact_dedup, minhash, suffix_dedup
from tests.llm import data


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_exact_groups(spark):
    docs = data.documents(spark)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r["text"])].append(r["doc_id"])
    got = sorted(map(repr, ((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(exact_dedup.exact_groups(docs)))))
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert got == sorted(map(repr, want))


def test_hot_group_is_one_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same  text', concat('text ', id)) AS text")
    out = exact_dedup.exact_groups(docs)
    assert out.filter("group_size = 1000").count() == 1000
    assert out.filter("kept").count() == 2001


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent=80):
    """Smallest id reachable per row; rows that share an id are kept apart."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    best = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            best[find(a)] = min(best.get(find(a), i), i)
    return [(i, len(sets[a]), best.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def check_near(docs, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(minhash.near_duplicates(docs, k=k))]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows, k)))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_awkward(spark, k):
    check_near(data.documents(spark), k)


def test_near_duplicates_fuzzy_group(spark):
    """A group edited at many rates: chains, members near the threshold and members that link with nothing."""
    rng = random.Random(4)
    base = data.words(rng, 150, 10**6).split()
    rows = []
    for i in range(160):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([0, 2, 4, 6, 8, 10, 14, 20])):
            own[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, data.words(rng, 80, 10**6)) for i in range(30)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 2)


def test_facts_of_nodes_meet_the_buckets_once(spark, monkeypatch):
    """A row per bucket and member is joined with what is known of the member once, not in every later step."""
    rng = random.Random(6)
    base = data.words(rng, 150, 10**6).split()
    rows = []
    for i in range(80):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([0, 2, 4, 6, 8, 10, 14, 20])):
            own[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    plans, pin = defaultdict(list), minhash.pin
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(minhash, "pin", lambda df, name: plans[name].append(plan_of(df)) or pin(df, name))
    crossing, pairs = minhash._bucket_pairs, []
    monkeypatch.setattr(minhash, "_bucket_pairs", lambda *a: pairs.append(crossing(*a)) or pairs[-1])
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    steps = [*plans["alive"], *map(plan_of, pairs)]
    assert len(plans["alive"]) == minhash.TURNS and pairs
    assert not [x for x in steps if re.search(r"Join Inner, \(node#\d+L = node#\d+L\)", x)]


def test_estimate_follows_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        same = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:same], rng.integers(0, 2**63, 2000 - same).astype(np.uint64)])
        sa, sb = minhash.set_sketch(a)[None, :].astype(int), minhash.set_sketch(b)[None, :].astype(int)
        n = np.array([2000.0])
        assert abs(float(minhash.jaccard_estimate(sa, sb, n, n)[0]) - share) < 0.12
        merged = np.maximum(sa, sb)[0]
        assert (merged == minhash.set_sketch(np.union1d(a, b))).all()


def brute_repeats(rows):
    """Removed bytes of (order, text) rows; equal rows are one document."""
    seen, out = {}, {}
    for order, text in sorted(set(rows)):
        b = text
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (order, p)) != (order, p):
                gone[p : p + 100] = True
        out[order, text] = gone
    return out


def check_repeats(docs, tie):
    source = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    keyed = [((-(2**63) if i is None else i, tie[t]), t) for i, t in source]
    want = brute_repeats(keyed)
    got = defaultdict(list)
    for r in rows_of(suffix_dedup.remove_repeats(docs)):
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    expected = defaultdict(list)
    for (i, t), (order, _) in zip(source, keyed):
        gone = want[order, t]
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        expected[i].append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in expected.items()}


def ties(docs):
    """Order of texts that share an id: the hash that the operator uses."""
    rows = docs.selectExpr("coalesce(text, '') AS text", "xxhash64(cast(coalesce(text, '') AS binary)) AS h").collect()
    return {r["text"].encode(): r["h"] for r in rows}


def test_repeats_awkward(spark):
    docs = data.documents(spark).filter("text IS NULL OR length(text) < 20000")
    check_repeats(docs, ties(docs))


def test_repeats_of_a_very_common_passage(spark):
    """More places than one part holds: parts are merged."""
    passage = data.words(random.Random(2), 40, 10**6)
    rng = random.Random(3)
    rows = [(i, f"{rng.randrange(10**9)} {passage[i % 7:]} {rng.randrange(10**9)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_repeats(docs, ties(docs))


def test_first_strings_of_a_hot_anchor_are_dealt_to_all_tasks(spark, monkeypatch):
    """Strings that straddle the edges of a common passage are each document's own: no task gets all of an anchor."""
    passage = data.words(random.Random(2), 12, 10**6)
    docs = spark.range(2500).selectExpr("id AS doc_id", f"concat(sha2(concat('a', id), 512), '{passage}', sha2(concat('b', id), 512)) AS text")
    pinned, pin = {}, suffix_dedup.pin
    monkeypatch.setattr(suffix_dedup, "pin", lambda df, name: pinned.setdefault(name, pin(df, name)))
    check_repeats(docs, ties(docs))
    firsts = pinned["repeats"].filter("bytes is not null").select("id", "key", "start", "bytes")
    strings = firsts.mapInArrow(suffix_dedup._strings, "digest binary, id long, key long, start long")
    assert strings.count() > 20_000
    assert strings.groupBy("digest").count().agg({"count": "max"}).first()[0] <= 2  # one from each part


def test_texts_are_moved_once(spark, monkeypatch):
    """Texts wait in buckets of their document: no later step exchanges them, however large the other tables are."""
    passage = data.words(random.Random(2), 40, 10**6)
    docs = spark.range(60).selectExpr("id AS doc_id", f"concat(sha2(concat('a', id), 512), '{passage}', sha2(concat('b', id % 50), 512)) AS text")
    docs = docs.union(docs.limit(5).selectExpr("doc_id + 100", "text"))
    exchanges, pin = {}, suffix_dedup.pin
    count = lambda df: len(re.findall("Exchange (?:hash|range|Round)", df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(suffix_dedup, "pin", lambda df, name: exchanges.setdefault(name, count(df)) and pin(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges["out"] = count(suffix_dedup.remove_repeats(docs))
        check_repeats(docs, ties(docs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one for what is found (copies, places, runs), one to deal it or what comes of it
    assert (exchanges["places"], exchanges["repeats"], exchanges["out"]) == (2, 2, 2)


def unnamed(spark):
    """Documents of one passage, near copies of each other, half of them without an id and half with a shared one."""
    rng = random.Random(7)
    passage = data.words(rng, 60, 10**6)
    rows = [([None, 5][i % 2], f"{rng.randrange(10**9)} {passage} {rng.randrange(10**9)}") for i in range(60)]
    return spark.createDataFrame(rows + rows[:6] + rows[:6], "doc_id long, text string")


def test_places_of_null_and_shared_ids(spark, monkeypatch):
    """Places are grouped by document, not by an id that many share, and repeated rows are searched once."""
    docs, pinned, pin = unnamed(spark), {}, suffix_dedup.pin
    monkeypatch.setattr(suffix_dedup, "pin", lambda df, name: pinned.setdefault(name, pin(df, name)))
    check_repeats(docs, ties(docs))
    most = max(len(suffix_dedup.anchors(np.frombuffer(r["text"].encode(), np.uint8))[0]) for r in docs.collect())
    places = pinned["places"]
    assert 0 < places.groupBy(places.columns[1]).count().agg({"count": "max"}).first()[0] <= most


def test_texts_of_null_and_shared_ids(spark, monkeypatch):
    """A text only meets the node made from it."""
    docs, met, own_texts = unnamed(spark), [], minhash._own_texts
    monkeypatch.setattr(minhash, "_own_texts", lambda *a: met.append(own_texts(*a)) or met[-1])
    check_near(docs, 2)
    assert met[0].count() == docs.count()


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n, letters in ((1, 3), (2, 1), (60, 1), (800, 2), (900, 256)):
        d = rng.integers(0, letters, n).astype(np.uint8)
        d[n // 2 :] = d[: n - n // 2]
        b = d.tobytes()
        sa = suffix_dedup.suffix_array(d)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        got = suffix_dedup.common_prefixes(d, sa)
        for k in range(1, n):
            x, y = b[sa[k - 1] :], b[sa[k] :]
            m = next((j for j in range(min(len(x), len(y), 100)) if x[j] != y[j]), min(len(x), len(y), 100))
            assert got[k] == m


def test_suffix_array_of_pieces():
    rng = np.random.default_rng(2)
    for _ in range(60):
        d = np.append(rng.integers(-1, rng.integers(1, 4), rng.integers(1, 80)), -1).astype(np.int16)
        ends = np.flatnonzero(d < 0)

        def piece(i):
            end = ends[np.searchsorted(ends, i)]
            return [*d[i:end].tolist(), end - 1_000_000]

        sa = suffix_dedup.suffix_array(d)
        assert sa.tolist() == sorted(range(len(d)), key=piece)
        got = suffix_dedup.common_prefixes(d, sa)
        for k in range(1, len(d)):
            x, y = piece(sa[k - 1]), piece(sa[k])
            assert got[k] == next(j for j in range(len(x)) if x[j] != y[j])


def test_keys_of_strings_cover_every_start_once():
    data = np.random.default_rng(4).integers(0, 3, 700).astype(np.uint8)
    data[400:600] = data[50:250]
    keys, first, count = suffix_dedup.anchors(data)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count)])
    assert sorted(starts.tolist()) == list(range(601))
    of_string = {}
    for key, a, n in zip(keys.tolist(), first.tolist(), count.tolist()):
        for s in range(a, a + n):
            of_string.setdefault(data[s : s + 100].tobytes(), set()).add(key)
    assert all(len(found) == 1 for found in of_string.values()) and len(of_string) < 601


def shared_ids(spark):
    rows = [(1, A), (5, A), (5, UNIQUE), (None, B), (None, B), (None, B), (7, B), (8, None), (8, None), (9, UNIQUE + " again")]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row int")


A, B = "one text that two documents hold " * 4, "another text whose copies have no id " * 4
UNIQUE = "a text of its own under an id that another row has as well, with words enough for shingles of five"


def test_exact_copies_go_by_row_and_no_text_is_lost(spark):
    out = exact_dedup.drop_exact_duplicates(shared_ids(spark))
    assert out.columns == ["doc_id", "text", "_row"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, A), (5, UNIQUE), (7, B), (8, None), (9, UNIQUE + " again")], key=repr)


def test_copies_without_any_id_leave_one_row(spark):
    docs = spark.createDataFrame([(None, B)] * 5 + [(None, A)], "doc_id long, text string").repartition(3)
    for drop in (exact_dedup.drop_exact_duplicates, minhash.drop_near_duplicates):
        assert sorted(r.text for r in drop(docs).collect()) == sorted([A, B])


def test_near_copies_go_by_row_and_no_text_is_lost(spark):
    out = minhash.drop_near_duplicates(shared_ids(spark))
    assert out.columns == ["doc_id", "text", "_row"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, A), (5, UNIQUE), (7, B), (8, None), (8, None)], key=repr)


def test_a_pair_of_many_buckets_is_made_once(spark):
    """Nodes 1, 2 and 5 share three buckets, 5 and 6 a fourth: each crossing pair comes from one bucket only."""
    places = {10: (1, 2, 5), 11: (1, 2, 5), 12: (2, 1, 5), 13: (5, 6)}
    component = {1: 1, 2: 1, 5: 5, 6: 6}
    rows = [(b, n, 100, 0, 100, 0, 300, component[n]) for b, nodes in places.items() for n in nodes]
    rest = spark.createDataFrame(rows, "bucket long, node long, s long, own long, common long, rare long, widest long, component long")
    pairs = [tuple(sorted((r["x"], r["y"]))) for r in minhash._bucket_pairs(rest, 80).collect()]
    assert sorted(pairs) == [(1, 5), (2, 5), (5, 6)]


def _contexts_of(texts, keys):
    rows = []
    for i, text in enumerate(texts):
        h, first, count = suffix_dedup.anchors(np.frombuffer(text, np.uint8))
        rows += [(int(k), int(i), f, c, text[f : f + c + suffix_dedup.LENGTH - 1]) for k, f, c in zip(h.view(np.int64), first.tolist(), count.tolist())]
    rows.sort(key=lambda r: r[0])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    columns = ([r[0] for r in rows], [-1] * len(rows), [r[1] for r in rows], [keys[r[1]] for r in rows], *([r[j] for r in rows] for j in (2, 3, 4)))
    names = ["h", "part", "id", "key", "start", "count", "bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def test_equal_places_are_sorted_once(monkeypatch):
    rng = random.Random(5)
    base = data.words(rng, 200)
    texts = [base, data.words(rng, 150), base[:700] + data.words(rng, 60), data.words(rng, 20) + base[300:], base, base * 2]
    batch = _contexts_of([t.encode() for t in texts], [7, 3, 5, 1, -2, 0])
    whole, sort = [batch.column(c).to_numpy().astype(np.int64) for c in ("id", "key", "start", "count", "part")], suffix_dedup.sort_shard

    def removed(out):
        return {(r["id"], r["key"], p) for b in out for r in b.to_pylist() for p in range(r["start"], r["stop"])}

    want, sorted_rows = removed(sort(*whole, batch.column("bytes").to_pylist())), []
    monkeypatch.setattr(suffix_dedup, "sort_shard", lambda *a: sorted_rows.append(len(a[0])) or sort(*a))
    assert removed(suffix_dedup._shards(iter([batch]))) == want and len(want) > 3_000
    assert sum(sorted_rows) < batch.num_rows / 3


def test_texts_are_joined_once_with_what_is_known(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffix_dedup.remove_repeats(data.documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Join LeftOuter") == 1
