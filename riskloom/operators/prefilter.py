"""Prefilter: signal text, word count, lexicon sentiment, kept and dropped posts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import WORD_CLASS, blank, let, sql_string, word_count
from riskloom.session import bounded_rows, row_keyed

# Limits and reasons.
MAX_WORDS = 2000
TOO_LONG = "too_long_over_2000_words"
NOT_NEGATIVE = "non_negative_vader_compound"
COMPOUND_ALPHA = 15.0
COMPOUND_DECIMALS = 4

IN_ROW_LEXICON = 20_000
#: Decimals of a valence; sums are exact in them, so the order of addition does not matter.
VALENCE = "decimal(18,6)"

HELPERS = ["_signal_text", "_word_count", "_sentiment_sum", "_vader_compound", "_drop_reason"]
#: The letters outside ASCII that become ASCII ones in lower case: only with them a text and its lower case differ in words.
TO_ASCII = ["\u0130", "\u212a"]


def signal_text(df: DataFrame) -> Column:
    """The altered text where it is not blank, else the text."""
    if "text_altered" not in df.columns:
        return F.coalesce("text", F.lit(""))
    return F.coalesce(F.when(~blank("text_altered"), F.col("text_altered")), F.col("text"), F.lit(""))


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_CLASS), F.lit(0))


def compound(total: Column) -> Column:
    value = total.cast("double")
    # adding zero turns a rounded -0.0 into 0.0
    return F.round(value / F.sqrt(value * value + F.lit(COMPOUND_ALPHA)), COMPOUND_DECIMALS) + F.lit(0.0)


def _valence_lookup(rows, buckets: int) -> Column:
    """The lexicon as a literal array of small maps, addressed by the token's hash."""
    maps: list[dict[str, float]] = [{} for _ in range(buckets)]
    for row in rows:
        maps[row["hash"] % buckets][row["token"]] = row["valence"]
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,double>>")


def _row_lexicon(lexicon: DataFrame) -> tuple[DataFrame, list | None]:
    """(token, valence) in lower case, and its rows if they are few enough to be looked up inside each row."""
    words = lexicon.groupBy(F.lower("token").alias("token")).agg(F.max("valence").alias("valence"))
    return words, bounded_rows(words.withColumn("hash", F.hash("token")), IN_ROW_LEXICON)


def _judged(text: str, rows) -> Column:
    """(n, known) of a text: its number of tokens and those that the lexicon holds; the text is searched once.

    One SQL expression, because a lexicon has too many tokens for one call each.
    """
    listed = ", ".join(sql_string(row["token"]) for row in rows if row["token"] is not None) or "NULL"
    found = f"regexp_extract_all(lower(`{text}`), {sql_string(WORD_CLASS)}, 0)"
    return F.expr(
        f"transform(array({found}), t -> named_struct('n', size(t), 'known', filter(t, x -> x IN ({listed}))))[0]"
    )


def _valence_sum(known: Column, rows) -> Column:
    """Sum of the valences of tokens of the lexicon."""
    buckets = max(1, len(rows))
    lookup = _valence_lookup(rows, buckets)

    def valence(token):
        bucket = F.get(lookup, F.pmod(F.hash(token), F.lit(buckets)))
        return F.coalesce(F.try_element_at(bucket, token), F.lit(0.0)).cast(VALENCE)

    return F.aggregate(known, F.lit(0).cast(VALENCE), lambda s, t: (s + valence(t)).cast(VALENCE))


def sentiment(df: DataFrame, lexicon: DataFrame, text: str = "_signal_text") -> DataFrame:
    """Adds ``_vader_compound``: the squashed sum of the valences of the text's tokens.

    A lexicon of checked size is looked up inside each row, so that posts are not shuffled. A
    larger one is joined to the exploded tokens of keyed rows; sums are then partial before they are exchanged. Both
    ways add decimals, row by row: repeated or null post ids make no difference.
    """
    words, rows = _row_lexicon(lexicon)
    if rows is not None:
        scored = df.withColumn("_sentiment_sum", _valence_sum(_judged(text, rows).getField("known"), rows))
    else:
        scored = _joined_sums(df, words, text)
    return scored.withColumn("_vader_compound", compound(F.col("_sentiment_sum")))


def _joined_sums(df: DataFrame, words: DataFrame, text: str) -> DataFrame:
    keyed = row_keyed(df, "sentiment")
    sums = (
        keyed.select("_row", F.explode(tokens(text)).alias("token"))
        .join(words, "token")
        .groupBy("_row").agg(F.sum(F.col("valence").cast(VALENCE)).cast(VALENCE).alias("_sentiment_sum"))
    )
    return keyed.join(sums, "_row", "left").drop("_row").withColumn(
        "_sentiment_sum", F.coalesce("_sentiment_sum", F.lit(0).cast(VALENCE))
    )


def prefilter(posts: DataFrame, lexicon: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Every post with its word count, compound and drop reason (null when kept).

    With a lexicon that is looked up inside the row, tokens are extracted once for both. The reason names what was
    extracted once, so a filter on it that Catalyst moves to the source extracts once as well.
    """
    def reason(count, value):
        return F.when(count > max_words, TOO_LONG).when(value >= 0.0, NOT_NEGATIVE)

    signal = posts.withColumn("_signal_text", signal_text(posts))
    words, rows = _row_lexicon(lexicon)
    if rows is None:
        counted = signal.withColumn("_word_count", word_count("_signal_text"))
        scored = _joined_sums(counted, words, "_signal_text").withColumn("_vader_compound", compound(F.col("_sentiment_sum")))
        return scored.withColumn("_drop_reason", reason(F.col("_word_count"), F.col("_vader_compound")))

    differs = F.contains("_signal_text", F.lit(TO_ASCII[0])) | F.contains("_signal_text", F.lit(TO_ASCII[1]))

    def count(judged):
        return F.when(differs, word_count("_signal_text")).otherwise(judged.getField("n"))

    def total(judged):
        return _valence_sum(judged.getField("known"), rows)

    judged = F.col("_judged")
    return signal.withColumn("_judged", _judged("_signal_text", rows)).withColumns({
        "_word_count": count(judged), "_sentiment_sum": total(judged), "_vader_compound": let(total(judged), compound),
        "_drop_reason": let(judged, lambda j: let(total(j), lambda s: reason(count(j), compound(s)))),
    }).drop("_judged")


def kept(evaluated: DataFrame) -> DataFrame:
    return evaluated.filter(F.col("_drop_reason").isNull()).drop(*HELPERS)


def dropped(evaluated: DataFrame) -> DataFrame:
    return evaluated.filter(F.col("_drop_reason").isNotNull()).drop("_signal_text", "_sentiment_sum")
