from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.functions import numeric as N, text as T
from riskloom.operators import prefilter as P
from riskloom.session import lookup

LEXICON = [("bad", -2.0), ("good", 2.0), ("Awful", -3.0)]


def posts(spark, *texts, **more):
    rows = [(str(i), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "post_id string, text string")


def reasons(df):
    return {r["post_id"]: r["_drop_reason"] for r in df.collect()}


def test_word_limit_edges_and_order_of_reasons(spark):
    df = posts(spark, "bad " * 2000, "bad " * 2001, "bad good", "good " * 2001, "awful", "", None)
    out = reasons(P.prefilter(df, lookup(spark, ["token", "valence"], LEXICON)))
    assert out == {
        "0": None, "1": P.TOO_LONG, "2": P.NOT_NEGATIVE, "3": P.TOO_LONG, "4": None,
        "5": P.NOT_NEGATIVE, "6": P.NOT_NEGATIVE,
    }


def test_kept_and_dropped_split_the_input(spark):
    df = P.prefilter(posts(spark, "bad", "good", "so"), lookup(spark, ["token", "valence"], LEXICON))
    assert P.kept(df).columns == ["post_id", "text"]
    assert P.kept(df).count() + P.dropped(df).count() == 3
    assert {"_word_count", "_drop_reason", "_vader_compound"} <= set(P.dropped(df).columns)


def test_large_lexicon_path_gives_the_same(spark, monkeypatch):
    df = posts(spark, "bad bad day", "good awful", "nothing", "BAD", "bad's good")
    words = lookup(spark, ["token", "valence"], LEXICON)
    in_row = {r["post_id"]: r["_vader_compound"] for r in P.prefilter(df, words).collect()}
    monkeypatch.setattr(P, "IN_ROW_LEXICON", 0)
    joined = {r["post_id"]: r["_vader_compound"] for r in P.prefilter(df, words).collect()}
    assert in_row == joined and len(in_row) == 5


@pytest.mark.parametrize("limit", [P.IN_ROW_LEXICON, 0])
def test_rows_are_judged_one_by_one(spark, monkeypatch, limit):
    """Repeated and null ids make no difference, nor does the order in which a zero sum is added."""
    monkeypatch.setattr(P, "IN_ROW_LEXICON", limit)
    words = lookup(spark, ["token", "valence"], [*LEXICON, ("up", 0.3), ("low", -0.1), ("lower", -0.2), ("tiny", -0.00001)])
    rows = [("1", "bad"), ("1", "good good"), (None, "bad"), ("2", "up low lower"), ("2", "lower low up"), ("3", "tiny")]
    df = spark.createDataFrame(rows, "post_id string, text string")
    got = sorted((r["post_id"] or "", r["text"], r["_drop_reason"]) for r in P.prefilter(df, words).collect())
    kept = [(i, t) for i, t, reason in got if reason is None]
    assert kept == [("", "bad"), ("1", "bad")] and len(got) == 6


def test_compound_formula(spark):
    df = P.prefilter(posts(spark, "bad"), lookup(spark, ["token", "valence"], LEXICON))
    assert df.first()["_vader_compound"] == round(-2 / (4 + 15) ** 0.5, 4)


def test_altered_text_wins_unless_blank(spark):
    df = spark.createDataFrame(
        [("a", "x", " \t"), ("b", "x", "y"), ("c", "x", None), ("d", None, None)],
        "post_id string, text string, text_altered string",
    )
    got = {r[0]: r[1] for r in df.select("post_id", P.signal_text(df)).collect()}
    assert got == {"a": "x", "b": "y", "c": "x", "d": ""}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_forms(spark):
    lit = F.lit
    assert value(spark, T.squash(lit(" a \n b\t"))) == "a b"
    assert value(spark, T.compact(lit("x" * 181))) == "x" * 177 + "..."
    assert value(spark, T.compact(lit("x" * 180))) == "x" * 180
    assert value(spark, T.strip_quotes(lit(' "It’s“ '))) == "Its"
    assert value(spark, T.bounded_summary(lit("ab " * 600), 10)) == "ab ab a..."
    assert value(spark, T.bounded_summary(lit("abcdef ghijk"), 10)) == "abcdef..."
    assert value(spark, T.sentences(lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    assert value(spark, T.sentences(lit("  "))) == []


@pytest.mark.parametrize(
    "title,generic",
    [("", True), ("Narrative", True), (" brand  narrative", True), ("a b narrative", False), ("Narratives", False)],
)
def test_generic_titles(spark, title, generic):
    assert value(spark, T.is_generic_title(F.lit(title))) is generic


def test_generic_summaries(spark):
    assert value(spark, T.is_generic_summary(F.lit(" Posts   Mentioning x")))
    assert value(spark, T.is_generic_summary(F.lit(None).cast("string")))
    assert not value(spark, T.is_generic_summary(F.lit("A claim")))


def test_occurrences_do_not_overlap_and_take_words_literally(spark):
    df = spark.createDataFrame([("aaaa a.c abc it's",)], "t string")
    row = df.select(T.occurrences("t", ["aa"]), T.occurrences("t", ["a.c"]), T.occurrences("t", ["it's", "b"])).first()
    assert tuple(row) == (2, 1, 2)


def test_numbers_and_bands(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(N.num("v", 0.5)).collect()] == [1.5, 0.5, 0.5, 0.5]
    scores = spark.createDataFrame([(v,) for v in [39.9, 40.0, 59.9, 60.0, 70.0, 80.0]], "v double")
    assert [r[0] for r in scores.select(N.score_band("v")).collect()] == ["Low", "Medium", "Medium", "Medium", "High", "High"]
    assert [r[0] for r in scores.select(N.severity_band("v")).collect()] == [
        "emerging", "moderate", "moderate", "elevated", "elevated", "high",
    ]
    assert value(spark, N.display_label(F.lit("Language signal: Data / Cyber"))) == "Language Risk: Data / Cyber"
    assert value(spark, N.display_label(F.lit("Volume pressure"))) == "High Volume"


def test_engagement_without_any_column_is_zero(spark):
    df = posts(spark, "x")
    assert df.select(N.engagement(df)).first()[0] == 0.0


def test_kept_posts_are_searched_once(spark):
    """A filter on the reason that moves to the source must not repeat the search of the text for every use of its sum."""
    plan = P.kept(P.prefilter(posts(spark, "bad"), lookup(spark, ["token", "valence"], LEXICON)))._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert text.count("regexp_extract_all(lower(") == 1 and text.count("regexp_extract_all(") <= 2


def test_words_that_lower_case_makes_do_not_count(spark):
    """The Kelvin sign and the dotted capital I are no word letters, but their lower case is."""
    df = posts(spark, "bad K bad", "İ bad", "bİg bad")
    rows = P.prefilter(df, lookup(spark, ["token", "valence"], LEXICON)).orderBy("post_id").collect()
    assert [r["_word_count"] for r in rows] == [2, 1, 3]


def test_empty_lexicon_and_odd_tokens(spark):
    df = posts(spark, "it's 'bad' don't", "")
    empty = P.prefilter(df, lookup(spark, ["token", "valence"], LEXICON).filter("false"))
    assert {r["_vader_compound"] for r in empty.collect()} == {0.0}
    odd = P.prefilter(df, lookup(spark, ["token", "valence"], [("it's", -1.0), ("don't", -2.0), ("a\\b", 1.0), (None, 1.0)]))
    assert reasons(odd) == {"0": None, "1": P.NOT_NEGATIVE}
