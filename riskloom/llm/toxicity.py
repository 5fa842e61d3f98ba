"""Toxic spans by a linear-chain conditional random field, trained on labelled documents.

Labels are given per document, so tokens are labelled first: word and word-opening features that occur almost only in
toxic documents are picked greedily until they explain the toxic documents; tokens that carry one, in toxic documents,
are the toxic tokens. The field then learns emissions from words, openings, endings and neighbours, and transitions.
Forward-backward marginals give token probabilities; a logistic of the strongest ones is the document score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.llm.common import forget, kept, lowest_hashes, slices

#: Labelled documents that the field is fitted on at most, per label; longer texts than this are not fitted on.
TRAIN_DOCS, TRAIN_CHARS = 1_500, 8_000
#: Segments of a gradient pass at most, and tokens of a segment. Training looks at segments; tagging passes messages from
#: one to the next, so its chains are whole texts.
TRAIN_SEGMENTS, SEGMENT = 8_000, 64
#: Weights nearer to 0 than this are not kept.
SMALL = 0.02
THRESHOLD = 0.3
#: Emission of a token without a known feature: clean until shown otherwise.
BIAS = -4.0
#: Share of the toxic documents that an equal share of the clean ones with the same feature outweighs.
COST = 6
#: Characters of a word's opening that are features; the shortest is too common to label tokens by.
OPENINGS = (3, 4, 5, 6, 7, 8)
#: Strongest tokens that make up the document score.
STRONGEST = 4
MEMO_TOKENS = 400_000

TOKEN = re.compile(r"\w+")


def _names(word: str) -> list[str]:
    """Emission features of a word that do not depend on its neighbours."""
    low = word.lower()
    found = ["w=" + low]
    found += [f"p{n}=" + low[:n] for n in OPENINGS if len(low) > n]
    if len(low) > 3:
        found.append("s=" + low[-3:])
    found.append("d" if any(c.isdigit() for c in low) else "u" if word.isupper() else "c" if word[:1].isupper() else "l")
    return found


@dataclass
class Field:
    """Weights relative to the clean label: emissions by feature, and log potentials of label pairs [from][to].

    Features that training has not seen weigh nothing; the training bounds limit how many there are.
    """

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    head: np.ndarray = field(default_factory=lambda: np.append(np.zeros(STRONGEST), -5.0))

    def parts(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own emission, to the next word's and to the one's before."""
        low, get = word.lower(), self.weights.get
        return BIAS + sum(get(n, 0.0) for n in _names(word)), get("prev=" + low, 0.0), get("next=" + low, 0.0)


def marginals(
    emission: np.ndarray, length: np.ndarray, moves: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | float = 1.0
) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded segments [n, t]: P(toxic) per token, and the messages and odds behind it.

    Only ratios of the two labels' messages are kept, so nothing under- or overflows. ``before`` is the forward message
    of the token before a segment (NaN: there is none), ``behind`` the backward message of its last token.
    """
    m = np.exp(moves)
    n, steps = emission.shape
    odds = np.exp(np.clip(emission, -30, 30))
    ahead, back = np.empty((n, steps)), np.empty((n, steps))
    r = odds[:, 0].copy()
    if before is not None:
        r *= np.where(np.isnan(before), 1.0, (m[0, 1] + m[1, 1] * before) / (m[0, 0] + m[1, 0] * before))
    ahead[:, 0] = r
    for t in range(1, steps):
        r = odds[:, t] * (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r)
        ahead[:, t] = r
    s = np.ones(n)
    for t in range(steps - 1, -1, -1):
        s = np.where(t >= length - 1, behind, s)
        back[:, t] = s
        x = odds[:, t] * s
        s = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
    both = ahead * back
    return both / (1 + both), np.stack([ahead, back, odds])


def chain_marginals(emission: np.ndarray, length: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) per token of chains cut into segments: a segment that is not a ``first`` one continues the row above it.

    A segment does to the message that enters it what a 2 x 2 matrix does to a pair. These matrices are made for all
    segments at once, messages then pass from segment to segment, and the recursions within segments start from them.
    """
    if first.all():
        return marginals(emission, length, moves)[0]
    m = np.exp(moves)
    n, steps = emission.shape
    odds = np.exp(np.clip(emission, -30, 30))
    ahead, back = np.zeros((2, 2, n)), np.zeros((2, 2, n))
    ahead[0, 0] = ahead[1, 1] = back[0, 0] = back[1, 1] = 1.0
    for t in range(steps):
        x = odds[:, t]
        moved = np.stack([m[0, 0] * ahead[0] + m[1, 0] * ahead[1], x * (m[0, 1] * ahead[0] + m[1, 1] * ahead[1])])
        if t == 0:
            moved = np.where(first, np.stack([ahead[0], x * ahead[0]]), moved)
        ahead = moved / moved.sum((0, 1))
    for t in range(steps - 1, -1, -1):
        x = odds[:, t] * back[1]
        moved = np.stack([m[0, 0] * back[0] + m[0, 1] * x, m[1, 0] * back[0] + m[1, 1] * x])
        back = np.where(t < length, moved / moved.sum((0, 1)), back)
    rank = np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]
    rows = np.split(np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank))[:-1])
    before, out, behind = np.full(n, np.nan), np.zeros(n), np.ones(n)
    for j, at in enumerate(rows):
        if j:
            before[at] = out[at - 1]
        r = before[at] if j else 0.0
        out[at] = (ahead[1, 0, at] + ahead[1, 1, at] * r) / (ahead[0, 0, at] + ahead[0, 1, at] * r)
    for at in rows[:0:-1]:
        s = behind[at]
        behind[at - 1] = (back[1, 0, at] + back[1, 1, at] * s) / (back[0, 0, at] + back[0, 1, at] * s)
    return marginals(emission, length, moves, before, behind)[0]


def _pair_counts(p: np.ndarray, inner: np.ndarray, length: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected label pairs, summed over the segments."""
    ahead, back, odds = inner
    m = np.exp(moves)
    a, x = ahead[:, :-1], odds[:, 1:] * back[:, 1:]
    cells = np.stack([np.full_like(a, m[0, 0]), m[0, 1] * x, a * m[1, 0], a * m[1, 1] * x])
    cells /= cells.sum(0)
    inside = np.arange(1, p.shape[1])[None, :] < length[:, None]
    return (cells * inside).sum((1, 2)).reshape(2, 2)


def token_markers(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Words and openings that explain the toxic documents, picked greedily among those rare in clean ones."""
    def features(words):
        low = {w.lower() for w in words}
        return {"w=" + w for w in low if len(w) > 1} | {f"p{n}=" + w[:n] for w in low for n in OPENINGS[1:] if len(w) > n}

    # only features that enough toxic documents have are counted among the clean ones
    least = max(4, round(0.004 * len(toxic)))
    in_toxic = Counter()
    for d in toxic:
        in_toxic.update(features(d))
    in_toxic = {f: c for f, c in in_toxic.items() if c >= least}
    in_clean = Counter()
    for d in clean:
        in_clean.update(features(d) & in_toxic.keys())
    rare = {f for f, c in in_toxic.items() if (in_clean[f] + 0.5) / (len(clean) + 1) <= 0.1 * c / len(toxic)}
    bags = [features(d) & rare for d in toxic]
    chosen, open_bags, cost = set(), bags, COST * len(bags) / len(clean)
    while open_bags:
        gain = Counter(f for b in open_bags for f in b)
        if not gain:
            break
        best = min(gain, key=lambda f: (cost * in_clean[f] - gain[f], len(f), f))  # few clean documents count too
        if gain[best] - cost * in_clean[best] < least:
            break
        chosen.add(best)
        open_bags = [b for b in open_bags if best not in b]
    frequent = max(5, 0.05 * len(bags))
    return chosen | {f for f in rare if in_toxic[f] >= frequent and f.startswith("w=") and not in_clean[f]}


def _marked(word: str, markers: set[str]) -> bool:
    low = word.lower()
    return "w=" + low in markers or any(f"p{n}=" + low[:n] in markers for n in OPENINGS[1:] if len(low) > n)


def _segments(words: list) -> list:
    return [words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT)]


class _Features(dict):
    """Feature name to column, numbered as they come."""

    def __missing__(self, name: str) -> int:
        self[name] = len(self)
        return self[name]


def _example(words: list[str], truth: list[bool] | None, columns: _Features) -> tuple:
    rows, cols = [], []
    for t, w in enumerate(words):
        found = _names(w)
        found += ["prev=" + words[t - 1].lower()] if t else []
        found += ["next=" + words[t + 1].lower()] if t + 1 < len(words) else []
        cols += [columns[n] for n in found]
        rows += [t] * len(found)
    return np.array(rows, np.int32), np.array(cols, np.int32), np.array(truth, bool) if truth else np.zeros(len(words), bool), len(words)


def _ascend(data: list[tuple], state: dict, rng: np.random.Generator, epochs: int) -> None:
    """AdaGrad steps on the log-likelihood of the segments in ``data``; ``state`` is changed."""
    weights, squares, moves, move_squares = (state[k] for k in ("weights", "squares", "moves", "move_squares"))
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), 256):
            batch = [data[j] for j in order[i : i + 256]]
            length = np.array([d[3] for d in batch])
            steps = int(length.max())
            flat = np.concatenate([d[0] + k * steps for k, d in enumerate(batch)])
            cols = np.concatenate([d[1] for d in batch])
            inside = np.arange(steps)[None, :] < length[:, None]
            emission = (np.bincount(flat, weights[cols], len(batch) * steps) + BIAS).reshape(len(batch), steps)
            p, inner = marginals(emission, length, moves)
            truth = np.zeros_like(p)
            for k, d in enumerate(batch):
                truth[k, : d[3]] = d[2]
            error = ((truth - p) * inside).ravel()
            grad = np.bincount(cols, error[flat], len(weights)) - 1e-3 * weights
            squares += grad * grad
            weights += 0.5 * grad / np.sqrt(squares)
            a, b = truth[:, :-1], truth[:, 1:]
            seen = [[(1 - a) * (1 - b), (1 - a) * b], [a * (1 - b), a * b]]
            seen = np.array([[(c * inside[:, 1:]).sum() for c in row] for row in seen])
            grad = seen - _pair_counts(p, inner, length, moves)
            move_squares += grad * grad
            moves += 0.1 * grad / np.sqrt(move_squares)
            np.clip(moves, -3, 3, out=moves)


def fit(texts: list[str], labels: list[int], epochs: int = 4, seed: int = 11) -> Field:
    """Fits a field on documents and their labels; without labels of both kinds it knows nothing.

    Clean segments that the first field takes for toxic are added to those of the second.
    """
    same: dict[str, str] = {}  # every token is held once
    docs = [[same.setdefault(w, w) for w in TOKEN.findall(t or "")] for t in texts]
    toxic, clean = [d for d, y in zip(docs, labels) if y], [d for d, y in zip(docs, labels) if not y]
    markers = token_markers(toxic, clean) if toxic and clean else set()
    if not markers:
        return Field()
    rng = np.random.default_rng(seed)
    hot, cold = [], []
    for d in toxic:
        for words in _segments(d):
            truth = [_marked(w, markers) for w in words]
            (hot if any(truth) else cold).append((words, truth))
    clean_segments = [(words, None) for d in clean for words in _segments(d)]
    cold += clean_segments
    hot, cold = ([x[i] for i in rng.permutation(len(x))[: TRAIN_SEGMENTS // 2]] for x in (hot, cold))
    columns = _Features()
    data = [_example(*x, columns) for x in hot + cold]
    state = {"weights": np.zeros(len(columns)), "moves": np.zeros((2, 2)), "move_squares": np.full((2, 2), 1e-8)}
    state["squares"] = np.full(len(columns), 1e-8)

    def model() -> Field:
        return Field({n: float(state["weights"][i]) for n, i in columns.items() if abs(state["weights"][i]) >= SMALL}, state["moves"])

    _ascend(data, state, rng, epochs)
    tagger = Tagger(model())
    hard = []
    for i in range(0, len(clean), 200):
        for words, p in zip(clean[i : i + 200], tagger.token_probabilities(clean[i : i + 200])):
            hard += [(words[a : a + SEGMENT], None) for a in range(0, len(words), SEGMENT) if p[a : a + SEGMENT].max() > 0.02]
    data += [_example(*x, columns) for x in hard[: TRAIN_SEGMENTS // 2]]
    added = len(columns) - len(state["weights"])
    state["weights"] = np.append(state["weights"], np.zeros(added))
    state["squares"] = np.append(state["squares"], np.full(added, 1e-8))
    _ascend(data, state, rng, epochs)
    done = model()
    tagger = Tagger(done)
    found = [p for i in range(0, len(docs), 200) for p in tagger.token_probabilities(docs[i : i + 200])]
    done.head = _fit_head(found, labels)
    return done


class Tagger:
    """Applies a field to texts, with the emission parts of frequent tokens remembered."""

    def __init__(self, model: Field):
        self.model, self.index = model, {}
        self.parts = np.zeros((1 << 14, 3))

    def _learn(self, words: list[str]) -> None:
        new = set(words) - self.index.keys()
        if len(self.index) + len(new) > MEMO_TOKENS and len(self.index):
            self.index.clear()
            new = set(words)
        start = len(self.index)
        if start + len(new) > len(self.parts):
            grown = np.zeros((2 * (start + len(new)), 3))
            grown[:start] = self.parts[:start]
            self.parts = grown
        for i, w in enumerate(new, start):
            self.index[w] = i
            self.parts[i] = self.model.parts(w)

    def probabilities(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of each token of each text."""
        return self.token_probabilities([TOKEN.findall(t) for t in texts])

    def token_probabilities(self, docs: list[list[str]]) -> list[np.ndarray]:
        words = [w for d in docs for w in d]
        self._learn(words)
        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        counts = np.array([len(d) for d in docs], np.int64)
        if not len(ids):
            return [np.zeros(0) for _ in docs]
        ends = np.cumsum(counts)
        at = np.arange(len(ids)) - np.repeat(ends - counts, counts)
        place, last = at % SEGMENT, np.zeros(len(ids), bool)
        last[ends[counts > 0] - 1] = True
        own, before, after = self.parts[ids].T
        emission = own.copy()
        emission[1:] += np.where(last[:-1], 0, before[:-1])
        emission[:-1] += np.where(last[:-1], 0, after[1:])
        segment = np.cumsum(place == 0) - 1
        padded = np.zeros((segment[-1] + 1, SEGMENT))
        padded[segment, place] = emission
        p = chain_marginals(padded, np.bincount(segment), at[place == 0] == 0, self.model.moves)
        return np.split(p[segment, place], ends[:-1])


def _strongest(p: np.ndarray) -> np.ndarray:
    """Log odds of the strongest tokens in falling order, and a one; missing tokens are clean."""
    top = np.zeros(STRONGEST)
    some = np.sort(np.partition(p, -STRONGEST)[-STRONGEST:] if len(p) > STRONGEST else p)[::-1]
    top[: len(some)] = some
    return np.append(np.clip(np.log((top + 1e-4) / (1 - top + 1e-4)), -7, 7), 1.0)


def document_score(p: np.ndarray, head: np.ndarray) -> float:
    """Logistic score of the strongest marginals; 0 without tokens."""
    return float(1 / (1 + np.exp(-_strongest(p) @ head))) if len(p) else 0.0


def _fit_head(marginal: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """Logistic regression by Newton steps, with a little shrinkage."""
    x, y = np.array([_strongest(p) for p in marginal]), np.array(labels, float)
    head = np.zeros(STRONGEST + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        grad = x.T @ (y - p) - 0.1 * head
        head += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(head)), grad)
    return head


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Character offsets of runs of toxic tokens."""
    out: list[tuple[int, int]] = []
    joined = False
    for match, q in zip(TOKEN.finditer(text), p):
        if q < least:
            joined = False
            continue
        out.append((out.pop()[0] if joined else match.start(), match.end()))
        joined = True
    return out


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_label: int = TRAIN_DOCS) -> Field:
    """Fits on at most ``per_label`` documents of each label, chosen by a hash of doc_id, of bounded length.

    ``labels`` is (doc_id, toxic); an id labelled more than once counts as toxic if any row says so, null labels are
    ignored. ``usable`` is a condition on doc_id.
    """
    known = labels.select("doc_id", "toxic").filter("toxic is not null and doc_id is not null")
    known = known if usable is None else known.filter(usable)
    each = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64("doc_id", F.lit(5)))
    ranked = lowest_hashes(each, "_h", per_label, "toxic").withColumn(
        "_n", F.row_number().over(W.partitionBy("toxic").orderBy("_h", "doc_id"))
    )
    chosen = ranked.filter(F.col("_n") <= per_label).select("doc_id", "toxic")  # at most 2 * per_label rows
    texts = docs.select("doc_id", "text").filter(F.char_length("text") <= TRAIN_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    fitted = rows.repartition(1).mapInArrow(_fit_rows, "names array<string>, weights array<double>, moves array<double>, head array<double>").collect()
    if not fitted:
        return Field()
    names, weights, moves, head = fitted[0]
    return Field(dict(zip(names, weights)), np.array(moves).reshape(2, 2), np.array(head))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The field of the chosen rows, fitted in one task so that the driver holds neither texts nor features."""
    forget()
    rows = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), key=lambda row: row[0])
    if rows:
        _, texts, labels = zip(*rows)
        found = fit(list(texts), [int(x) for x in labels])
        yield pa.RecordBatch.from_pydict({
            "names": [list(found.weights)], "weights": [list(found.weights.values())], "moves": [found.moves.ravel().tolist()],
            "head": [found.head.tolist()],
        })


def _tagger(shared) -> Tagger:
    key, *field = shared.value
    return kept(key, lambda: Tagger(Field(*field)))


def _share(docs: DataFrame, model: Field):
    """The training bounds limit the number of weights."""
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.weights, model.moves, model.head))


def tag(docs: DataFrame, model: Field) -> DataFrame:
    """Per row of ``docs``: doc_id, score, spans (start and end of toxic runs, in characters).

    Null and empty texts score 0 and have no span. Long texts are tagged whole. Other columns are ignored.
    """
    shared = _share(docs, model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared)
        for big in batches:
            for batch in slices(big, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                p = tagger.probabilities(texts)
                found = [
                    [{"start": a, "end": b} for a, b in spans(t, q)] if len(q) and q.max() >= 0.5 else [] for t, q in zip(texts, p)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([document_score(q, tagger.model.head) for q in p], pa.float64()), pa.array(found, kind)],
                    ["doc_id", "score", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def reject(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with all their columns and without a shuffle."""
    shared, at = _share(docs, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared)
        for big in batches:
            for batch in slices(big, at):
                p = tagger.probabilities([t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([document_score(q, tagger.model.head) < threshold for q in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learns from ``labelled`` (doc_id, text) and ``labels``, then rejects toxic rows of ``docs``."""
    return reject(docs, train(labelled, labels), threshold)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, spans; learned from the rows that are not held out."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    model = train(docs, labels, fold != 2)
    return tag(docs, model).select(
        "doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans"
    )
