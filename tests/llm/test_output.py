"""Sharding, mixing, token files and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from riskloom.llm import common, mixing, queries, sharding, token_pack
from riskloom.llm.common import pin
from tests.llm import data

SF = "/root/testdata/sf0.001"


def test_shards_follow_the_key_law(spark):
    docs = data.documents(spark)
    tree = sharding.even_tree(16)
    rows = sharding.sharded(docs, tree, sharding.grown(tree, 16)).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(x) == 1 for x in where.values())
    text = [(t["doc_id"], (t["text"] or "").encode()) for t in docs.select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in text)


def test_weights_and_confined_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = [sharding.Leaf("r0", "r0/a", 0), sharding.Leaf("r0", "r0/b", 1, 3.0), sharding.Leaf("r1", "r1/a", 2, 2.0), sharding.Leaf("r1", "r1/b", 3, 2.0)]
    before = dict(sharding.place(ids, tree).collect())
    share = Counter(before.values())
    assert all(abs(share[x.shard] / 20_000 - x.weight / 8) < 0.02 for x in tree)
    heavier = [*tree[:3], sharding.Leaf("r1", "r1/b", 3, 4.0)]
    after = dict(sharding.place(ids, heavier).collect())
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(b in (2, 3) for _, b in moved)  # only into the region that grew
    assert not any((a, b) == (3, 2) for a, b in moved)
    with pytest.raises(ValueError):
        sharding.place(ids, [])


def brute_mix(rows):
    size_of = lambda t: len((t or "").encode().split())
    sums = defaultdict(int)
    for _, t, s in rows:
        sums[s] += size_of(t)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        left = 1.5 * sum(sums.values()) - sum(2 * sums[s] for s in full)
        target = {s: 2.0 * sums[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        above = {s for s in open_ if target[s] > 2 * sums[s]}
        if not above:
            return sums, target
        full |= above


def test_mix_against_brute_force(spark):
    docs = data.documents(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    sums, target = brute_mix(rows)
    got = mixing.mix_digest(docs).collect()
    source = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = next(s for s in sums if sums[s] == r["source_size"] and abs(target[s] - r["target"]) < 1e-6)
        source[s] += r["taken"]
    assert all(abs(source[s] - target[s]) <= 1 for s in sums)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_digest(docs.repartition(5)).collect()))


def test_mixed_documents_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_digest(docs).collect()}
    words = Counter()
    for r in mixing.mix_documents(docs).collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
    assert all(words[i] == n for i, n in taken.items())


def test_mix_orders_no_texts(spark):
    plan = mixing.mix_documents(data.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_a_cut_among_ties_is_dealt_out(spark):
    # rows of one id, text and source in several partitions: the budget ends among them
    rows = [(None, "one two three", "a", i) for i in range(40)] + [(i, "x y", "b", i) for i in range(100)] + [(None, "four five", None, 1)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(7)
    for share, most in ((0.7, 2), (0.31, 1), (1.5, 2)):
        want, got = Counter(), Counter()
        for r in mixing.mix_digest(docs, share=share, most=most).collect():
            want[r["doc_id"], r["size"]] += r["taken"]
        mixed = mixing.mix_documents(docs, share=share, most=most).collect()
        for r in mixed:
            got[r["doc_id"], {"o": 3, "x": 2, "f": 2}[r["text"][0]]] += len(r["text"].split())
        assert got == +want and len(mixed) > 3
        cut = [r for r in mixed if r["text"] in ("one", "one two", "x", "four")]
        assert len(cut) <= 3


def test_fields_follow_each_other_bit_by_bit():
    rng = np.random.default_rng(4)
    for width in range(1, 33):
        for n in (0, 1, 7, 8, 9, 100):
            ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
            value = sum(int(x) << (i * width) for i, x in enumerate(ids))
            data = token_pack.pack(ids, width)
            assert data == value.to_bytes((n * width + 7) // 8, "little")
            assert (token_pack.unpack(data, n, width) == ids).all()


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for width in (1, 3, 8, 13, 16, 17, 31):
        docs = [rng.integers(0, 2**width, n).astype(np.uint32) for n in (0, 1, 9000, 7)]
        image = token_pack.Image(token_pack.write_image([3, None, 5, 5], docs, width))
        flat = np.concatenate(docs)
        assert image.doc_ids == [3, None, 5, 5] and image.starts.tolist() == [0, 0, 1, 9001, 9008]
        assert (image.ids(0, len(flat)) == flat).all()
        for a, b in ((0, 0), (5, 6), (4090, 4100), (9000, 9008), (1, 9007)):
            assert (image.ids(a, b) == flat[a:b]).all()
    empty = token_pack.Image(token_pack.write_image([], [], 16))
    assert empty.n_ids == 0 and not len(empty.ids(0, 0))
    assert token_pack.width_of(50_257) == 16 and token_pack.width_of(1) == 1


def whole(text):
    return [*token_pack.encoder(token_pack.VOCABULARY).library.encode(text or "", add_special_tokens=False).ids, token_pack.END_ID]


def test_pieces_equal_whole_texts():
    rng = random.Random(1)
    letters = [*" \n\t\r\x0b\x0c\x1c\xa0\x85abcé1.,'s\"!-_中\0", "  ", "\n\n", " word", " 's", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(4000)]
    own = token_pack.encoder(token_pack.VOCABULARY)
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == whole(text)[:-1], text


def test_a_piece_is_looked_up_once_a_call():
    class Memo(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.asked += 1
            return super().__getitem__(k)

    own = token_pack.Encoder(token_pack.VOCABULARY)
    own.memo = Memo()
    texts = ["to be or not to be\nto be, " * 50 + "end", "or not to be"] * 20
    own.encode(texts)
    own.memo.asked = 0
    assert [x.tolist() for x in own.encode(texts)] == [whole(t)[:-1] for t in texts]
    assert own.memo.asked < 20


def test_pieces_beyond_the_memory_are_encoded_anew(monkeypatch):
    monkeypatch.setattr(token_pack, "MEMO_PIECES", 10)
    own = token_pack.Encoder(token_pack.VOCABULARY)
    for texts in (["a few words first", "", "and  odd\tones"], [" ".join(f"w{i}" for i in range(70)) + ", w3, done."], []):
        assert [x.tolist() for x in own.encode(texts)] == [whole(t)[:-1] for t in texts]
    assert len(own.memo) <= 10


def test_token_digests(spark):
    docs = data.documents(spark)
    got = sorted(((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in token_pack.token_digests(docs).collect()))
    start = 0
    for s, n, _, _ in got:
        assert s == start
        start += n
    ids = [i for *_, i in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((r["doc_id"], len(whole(r["text"])), zlib.crc32(np.array(whole(r["text"]), "<u4").tobytes())) for r in docs.collect())
    assert Counter((i, n, c) for _, n, c, i in got) == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = pin(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "token_output":
            assert sorted(docs.columns) == sorted(columns)
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert counts[0] > counts[1] > counts[2] and counts[3] > 0 and counts[4] == counts[5]
    digest = docs.agg({"n_tokens": "sum", "start": "max"}).first()
    assert digest["sum(n_tokens)"] > digest["max(start)"]


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in queries.all_queries()]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14))
    assert set(queries.all_sql()) <= set(queries.all_queries())


def test_reading_tokens_gives_up_the_encoder():
    image = token_pack.write_image([4, None], [np.array([5, 2], np.uint32), np.array([2], np.uint32)], 16)
    batch = pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "first_id": [10], "image": [image]})
    token_pack.encoder(token_pack.VOCABULARY)
    rows = [r for b in token_pack._digests(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["local"], r["n_tokens"]) for r in rows] == [(4, 10, 2), (None, 12, 1)]
    assert rows[0]["ids_crc32"] == zlib.crc32(np.array([5, 2], "<u4").tobytes()) and not common._kept
