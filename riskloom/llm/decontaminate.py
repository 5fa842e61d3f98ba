"""Benchmark decontamination: rare word n-grams of test items are seeds, Smith-Waterman alignment scores the rest.

An n-gram is rare if its words, at their frequencies in the whole corpus, would meet by chance at most at a rate of
``CHANCE``, whatever the corpus holds in all: a larger one of the same kind has the same seeds. Every document is searched for seeds; around its hits the item is aligned with the document's words, so edited
and paraphrased copies score too. The benchmark is processed in blocks of bounded size, each of which is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import _word_memory, mix, slices, text_bytes

#: Words of a seed, and how often a seed may be expected by chance per word of the corpus.
SEED_WORDS, CHANCE = 3, 1e-6
#: Alignment: a match counts 1, an exchanged, missing or extra word costs PENALTY; score = best sum / words of the item.
PENALTY, THRESHOLD = 0.5, 0.5
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 4 << 20

#: ASCII punctuation separates words.
BREAKS = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def passage_hashes(text: bytes) -> np.ndarray:
    """Hash of each word, A-Z lower-cased and ASCII punctuation left out."""
    words = text.lower().translate(BREAKS).split()
    return np.fromiter(map(_word_memory().__getitem__, words), np.uint64, len(words))


def _grams(h: np.ndarray) -> np.ndarray:
    if len(h) < SEED_WORDS:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - SEED_WORDS + 1, np.uint64)
    for j in range(SEED_WORDS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - SEED_WORDS + 1 + j])
    return acc


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman of two word sequences: best sum over the item's length, and where it ends in ``words``."""
    steps = PENALTY * np.arange(len(words))
    row, best, end = np.zeros(len(words) + 1), 0.0, 0
    for word in item:
        diagonal = row[:-1] + np.where(words == word, 1.0, -PENALTY)
        now = np.maximum(np.maximum(diagonal, row[1:] - PENALTY), 0.0)
        now = np.maximum.accumulate(now + steps) - steps  # extra words of the document
        row = np.concatenate([[0.0], now])
        at = int(now.argmax())
        if now[at] > best:
            best, end = float(now[at]), at + 1
    return best / len(item), end


class Index:
    """Seeds of a block of items: sorted gram hashes with the items (by their place in the block) that they come from."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], frequency: dict[int, int], total: int):
        self.items = [(i, h) for i, h in items if len(h) >= SEED_WORDS]
        grams, owners = [], []
        for i, (_, h) in enumerate(self.items):
            share = np.array([frequency.get(int(w), 0) for w in h], float) / max(1, total)
            expected = np.prod([share[j : len(h) - SEED_WORDS + 1 + j] for j in range(SEED_WORDS)], axis=0)
            known = expected[expected > 0]  # grams of words that no document has find nothing
            rare = expected <= max(CHANCE, float(np.quantile(known, 1 / 3)) if len(known) else 0.0)
            grams.append(_grams(h)[rare])
            owners.append(np.full(int(rare.sum()), i))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.owners = self.grams[order], (np.concatenate(owners)[order] if owners else np.zeros(0, np.int64))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.grams & np.uint64((1 << 20) - 1)] = True

    def matches(self, text: bytes) -> list[tuple[int | None, float, int]]:
        """(item_id, score, last word) of the items that the text holds, best place each."""
        h = passage_hashes(text)
        grams = _grams(h)
        places = np.flatnonzero(self.filter[grams & np.uint64((1 << 20) - 1)])
        if not len(places):
            return []
        lo, hi = (np.searchsorted(self.grams, grams[places], side) for side in ("left", "right"))
        hits: dict[int, list[int]] = {}
        for place, a, b in zip(places[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            for item in set(self.owners[a:b].tolist()):
                hits.setdefault(item, []).append(place)
        found = []
        for item, at in hits.items():
            name, words = self.items[item]
            n = len(words)
            best = (0.0, 0)
            edges = [0, *(np.flatnonzero(np.diff(at) > 2 * n) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:]):
                # runs of a passage that repeats are aligned in windows of a bounded number of words
                for start in range(at[a], at[b - 1] + 1, 8 * n):
                    first = max(0, start - 2 * n)
                    score, end = align(words, h[first : min(start + 8 * n, at[b - 1]) + 2 * n + SEED_WORDS])
                    best = max(best, (score, first + end - 1))
            if best[0] >= THRESHOLD:
                found.append((name, *best))
        return found


def _counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(len(vocabulary), np.int64), 0
        for big in batches:
            for batch in slices(big, 0):
                for text in batch.column(0).to_pylist():
                    h = passage_hashes(text)
                    total += len(h)
                    if len(vocabulary):
                        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                        sums += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(len(sums)), -1)), pa.array(np.append(sums, total))], ["word", "n"]
        )
    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Distinct (item_id, text) in blocks of about BLOCK_BYTES; the number of blocks follows from the summed size."""
    rows = benchmark.select("item_id", text_bytes().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        block = sorted(((r["item_id"], bytes(r["text"])) for r in block), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield [(i, passage_hashes(t)) for i, t in block]


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    """An index per block of the benchmark, with word frequencies counted over all of ``docs``."""
    texts = docs.select(text_bytes().alias("text"))
    for items in _blocks(benchmark):
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in items)]))
        rows = texts.mapInArrow(_counts(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        count = {r["word"]: r["n"] for r in rows}  # one row per word of the block
        yield Index(items, {int(w): count.get(i, 0) for i, w in enumerate(vocabulary)}, count.get(-1, 0))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, last_word) for each benchmark item that a document contains a copy of.

    score is the alignment's sum over the item's words, from ``THRESHOLD`` to 1; last_word is the place of its last
    word. Items under three words cannot be told from chance and never match; null texts are empty; repeated rows are
    each reported. Each distinct (item_id, text) is an item, whether its id is shared or null; a null id is reported as
    null. Other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    for index in indexes(docs, benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in slices(big, 1):
                    rows = [
                        (i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in shared.value.matches(t)
                    ]
                    columns = list(zip(*rows)) if rows else [[]] * 4
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "last_word"]
                    )

        found = docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, "doc_id long, item_id long, score double, last_word long")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with all their columns and without a shuffle."""
    spark, at, out = docs.sparkSession, docs.columns.index("text"), docs
    for index in indexes(docs, benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in slices(big, at):
                    texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
                    yield batch.filter(pa.array([not shared.value.matches(t) for t in texts], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
