"""Fuzzy tier: token windows that are nearly a dictionary term.

Two strings whose similarity 2M/(|a|+|b|) is at least t differ by at most (1-t)(|a|+|b|) single
character insertions and deletions. A term cut into one piece more than that many edits keeps at
least one piece intact in any near window, shifted by no more than the number of edits. Joining on
the pieces is therefore exact. Each distinct window is looked up once; a bound on the ratio from the
characters of both strings drops most candidates, and those that survive are scored with the true ratio.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.functions.text import MATCH_TOKEN_CLASS, blank, let, normalize
from riskloom.session import BROADCAST_BYTES, broadcast_blocks, lookup, pinned, pinned_union

# Confidence of a near match.
THRESHOLD = 0.9
FLOOR, CEILING, FACTOR = 0.75, 0.85, 0.9
METHOD = "fuzzy"


def match_tokens(c) -> Column:
    return F.regexp_extract_all(c, F.lit(MATCH_TOKEN_CLASS), F.lit(0))


def fuzzy_terms(search_lists: DataFrame) -> DataFrame:
    """(entity_id, name, entity_pos, term_pos, term_norm, width): canonical name, then aliases."""
    terms = F.concat(F.array("canonical_name"), F.col("search_list"))
    return (
        search_lists.select(
            "entity_id", F.col("canonical_name").alias("name"), "entity_pos",
            F.posexplode(terms).alias("term_pos", "term"),
        )
        .filter(~blank("term"))
        .withColumn("term_norm", normalize("term"))
        .withColumn("width", F.size(match_tokens("term_norm")))
        .filter("width > 0")
    )


@F.pandas_udf(T.DoubleType())
def similarity(term: pd.Series, window: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of aligned pairs; repeated pairs of a batch are scored once."""
    pairs = list(zip(term, window))
    ratios = {pair: SequenceMatcher(None, *pair).ratio() for pair in set(pairs)}
    return pd.Series([ratios[pair] for pair in pairs], dtype="float64")


# so that a filter on the ratio does not run the function a second time
similarity = similarity.asNondeterministic()


def _edits(length: int, longest: int, threshold: float) -> int:
    return math.floor((1 - threshold) * (length + longest) + 1e-9)


def pieces(length: int, threshold: float) -> list[tuple[int, int, int]]:
    """(start, size, shift) of the pieces a term of this length is cut into."""
    longest = math.floor(length * (2 - threshold) / threshold + 1e-9)
    edits = _edits(length, longest, threshold)
    count = min(edits + 1, length)
    bounds = [round(i * length / count) for i in range(count + 1)]
    return [(a, b - a, edits) for a, b in zip(bounds, bounds[1:])]


def _shapes(terms: DataFrame) -> list:
    """The (width, length) pairs that occur among the terms; bounded by the lengths of names."""
    return terms.select("width", F.length("term_norm").alias("n")).distinct().collect()


def _spans(shapes: list, threshold: float) -> list[tuple[int, int, int]]:
    """(width, shortest, longest): the window lengths that terms of each width can match."""
    spans = []
    for width in sorted({s["width"] for s in shapes}):
        lengths = [s["n"] for s in shapes if s["width"] == width]
        low = min(math.ceil(n * threshold / (2 - threshold) - 1e-9) for n in lengths)
        high = max(math.floor(n * (2 - threshold) / threshold + 1e-9) for n in lengths)
        spans.append((width, low, high))
    return spans


def _term_pieces(terms: DataFrame, shapes: list, threshold: float) -> tuple[DataFrame, list[int]]:
    """Term pieces and the piece sizes in use."""
    cuts = {n: pieces(n, threshold) for n in {s["n"] for s in shapes}}
    sizes = sorted({size for cut in cuts.values() for _, size, _ in cut})
    plan = lookup(
        terms.sparkSession, ["n", "at", "size", "shift"],
        [(n, at, size, shift) for n, cut in cuts.items() for at, size, shift in cut],
    )
    cut_terms = (
        terms.select("term_norm", "width", F.length("term_norm").alias("n")).distinct()
        .join(plan, "n")
        .withColumn("piece", F.expr("substring(term_norm, int(at) + 1, int(size))"))
    )
    return cut_terms, sizes


def _windows_of(tokens: Column, width: int, low: int, high: int) -> Column:
    """Windows of ``width`` tokens whose joined length lies in [low, high]."""
    def joined(i):
        if width == 1:
            return F.get(tokens, i - 1)
        return F.array_join(F.slice(tokens, i, width), " ")

    made = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - width + 1),
        lambda i: F.struct(F.lit(width).alias("width"), i.alias("start"), joined(i).alias("window")),
    )
    fitting = F.filter(made, lambda w: F.length(w.getField("window")).between(low, high))
    # sequence counts down when its end lies below its start
    return F.coalesce(
        F.when(F.size(tokens) >= width, fitting),
        F.array().cast("array<struct<width:int,start:int,window:string>>"),
    )


def _windows(posts: DataFrame, spans: list[tuple]) -> DataFrame:
    """(post_id, width, start, window) for windows whose length some term could match."""
    def windows(tokens):
        return F.concat(*[_windows_of(tokens, *span) for span in spans])

    return posts.select("post_id", F.inline(let(match_tokens("_norm"), windows)))


def _pieces_of(window: Column, sizes: list[int]) -> Column:
    """Every piece of a window, of each size, with its place."""
    def cut(n):
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(window) - n))
        return F.transform(at, lambda i: F.struct(F.substring(window, i + 1, F.lit(n)).alias("piece"), i.alias("seen_at")))

    return F.concat(*[cut(n) for n in sizes])


def letters(term: str) -> Column:
    """Each distinct character of a term with the number of times it occurs."""
    each = F.array_distinct(F.split(term, ""))
    size = F.length(term)
    return F.transform(each, lambda c: F.struct(c.alias("c"), (size - F.length(F.replace(F.col(term), c))).alias("n")))


def ratio_bound(window: str, window_length: Column, letters_of_term: str, term_length: Column) -> Column:
    """Upper bound of the ratio: no matching uses a character more often than both strings hold it."""
    shared = F.aggregate(
        letters_of_term, F.lit(0),
        lambda total, x: total + F.least(x.getField("n"), window_length - F.length(F.replace(F.col(window), x.getField("c")))),
    )
    return 2 * shared / (window_length + term_length)


def near_pairs(
    windows: DataFrame, terms: DataFrame, shapes: list, threshold: float, block_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(width, window, term_norm, ratio) of the distinct windows that are near a term.

    ``windows`` may repeat: each distinct one is looked up once. Pieces find the candidates, the characters of both
    strings bound their ratio, and only pairs that could still reach the threshold are compared in Python. The terms
    go to the windows in blocks of bounded bytes, so a piece that many terms share makes no hot key.
    """
    cut_terms, sizes = _term_pieces(terms, shapes, threshold)
    cut_terms = pinned(cut_terms.withColumn("letters", letters("term_norm")), "pieces")
    vocabulary = windows.select("width", "window").distinct()
    blocks = broadcast_blocks(cut_terms, block_bytes)
    if len(blocks) > 1:
        vocabulary = pinned(vocabulary, "vocabulary")
    length, n = F.length("window"), F.col("n")
    fits = (
        (2 * F.least(length, n) >= threshold * (length + n) - 1e-9)
        & (F.abs(F.col("seen_at") - F.col("at")) <= F.col("shift"))
    )
    spread_out = vocabulary.select("width", "window", F.inline(_pieces_of(F.col("window"), sizes)))
    parts = [
        spread_out.join(block, ["width", "piece"]).filter(fits)
        .filter(ratio_bound("window", length, "letters", n) >= threshold - 1e-9)
        .select("width", "window", "term_norm").distinct()
        for block in blocks
    ]
    return (
        pinned_union(parts, "candidates").distinct()
        .withColumn("ratio", similarity("term_norm", "window")).filter(F.col("ratio") >= threshold)
    )


def near_terms(posts: DataFrame, terms: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(post_id, start, window, term_norm, ratio) of the windows that are near a term.

    The near pairs are written once and laid over the posts' windows, which are derived again rather than stored.
    """
    shapes = _shapes(terms)
    if not shapes:
        schema = "post_id string, start int, window string, term_norm string, ratio double"
        return posts.sparkSession.createDataFrame([], schema)
    windows = _windows(posts, _spans(shapes, threshold))
    pairs = pinned(near_pairs(windows, terms, shapes, threshold, block_bytes), "near")
    return pinned_union([
        windows.join(block, ["width", "window"]).select("post_id", "start", "window", "term_norm", "ratio")
        for block in broadcast_blocks(pairs, block_bytes)
    ], "postings")


def confidence(ratio: Column) -> Column:
    return F.round(F.least(F.lit(CEILING), F.greatest(F.lit(FLOOR), ratio * FACTOR)), 2)


def fuzzy_matches(
    posts: DataFrame, terms: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(post_id, _near): per post one match for each entity with a near window.

    Of an entity's windows the highest ratio wins, then the earliest term, then the first window.
    ``posts`` holds (post_id, _norm); the output struct is the one the exact tiers use.
    """
    best = (
        near_terms(posts, terms, threshold, block_bytes)
        .join(terms.select("term_norm", "term_pos", "entity_id", "name", "entity_pos"), "term_norm")
        .groupBy("post_id", "entity_id", "entity_pos")
        .agg(
            F.min(F.struct((-F.col("ratio")).alias("neg"), "term_pos", "start", "window", "name"))
            .alias("m")
        )
    )
    match = F.struct(
        (-confidence(-F.col("m.neg"))).alias("neg"),
        F.struct("entity_pos", "entity_id").alias("ord"),
        "entity_id",
        F.col("m.window").alias("mention_text"),
        F.lit(METHOD).alias("method"),
        F.col("m.name").alias("name"),
    )
    # at most one match per entity, so the array is bounded by the dictionary
    ranked = best.groupBy("post_id").agg(F.array_sort(F.collect_list(match)).alias("_near"))
    return ranked.withColumn(
        "_near",
        F.transform(
            "_near",
            lambda m, i: F.struct(
                m.getField("neg").alias("neg"), i.alias("ord"),
                m.getField("entity_id").alias("entity_id"),
                m.getField("mention_text").alias("mention_text"),
                m.getField("method").alias("method"), m.getField("name").alias("name"),
            ),
        ),
    )
