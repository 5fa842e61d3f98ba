"""Text expressions. All of them stay inside the JVM; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Token classes, quote characters, generic titles and generic summary openings.
WORD_CLASS = r"[A-Za-z0-9#@$&'\-]+"
MATCH_TOKEN_CLASS = r"[A-Za-z0-9#&$@\-]+"
QUOTE_CHARS = "\"'“”‘’"
GENERIC_TITLES = [
    r"^\s*company narrative\s*$",
    r"^\s*entity narrative\s*$",
    r"^\s*general narrative\s*$",
    r"^\s*risk narrative\s*$",
    r"^\s*narrative\s*$",
    r"^\s*\w+\s+narrative\s*$",
]
GENERIC_SUMMARY_PREFIXES = [
    "posts mentioning",
    "this context indicates risk",
    "discussion focused on potential",
    "this post indicates risk signals",
]
NULL_WORDS = ["nan", "none", "null"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it in a lambda.

    A column that is only named inside a lambda would be inlined there by the optimizer and
    computed again for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(c) -> Column:
    """Runs of (Unicode) whitespace become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def strip(c) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def blank(c) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def normalize(c) -> Column:
    return F.lower(squash(c))


def compact(c, n: int = 180) -> Column:
    s = squash(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def without_quotes(c) -> Column:
    return F.translate(_col(c), QUOTE_CHARS, "")


def strip_quotes(c) -> Column:
    return strip(without_quotes(c))


def bounded_summary(c, n: int = 1200) -> Column:
    s = strip_quotes(squash(c))
    return F.when(
        F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n - 3)), F.lit("..."))
    ).otherwise(s)


def has_quotes(c) -> Column:
    return _col(c).rlike(f"[{QUOTE_CHARS}]")


def is_generic_title(c) -> Column:
    s = squash(c)
    patterns = "|".join(GENERIC_TITLES)
    return F.coalesce((s == "") | s.rlike(f"(?iU)(?:{patterns})"), F.lit(True))


def is_generic_summary(c) -> Column:
    s = normalize(c)
    generic = s == ""
    for prefix in GENERIC_SUMMARY_PREFIXES:
        generic = generic | s.startswith(prefix)
    return F.coalesce(generic, F.lit(True))


def word_count(c) -> Column:
    return F.regexp_count(_col(c), F.lit(WORD_CLASS))


def sentences(c) -> Column:
    """Sentences of the squashed text: a break follows ``.``, ``!`` or ``?``."""
    return F.filter(F.split(squash(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def occurrences(column: str, words: list[str]) -> Column:
    """Non-overlapping occurrences of each fixed word in a lowered text column, added up.

    One SQL expression, because a taxonomy has too many words for one call each.
    """
    counts = [f"regexp_count({column}, {sql_string(chr(92) + 'Q' + w + chr(92) + 'E')})" for w in words]
    return F.expr(f"CAST({' + '.join(counts) or '0'} AS BIGINT)")


def words_present(column: str, words: list[str]) -> Column:
    """True when the lowered text column holds any of the words."""
    return F.expr(" OR ".join(f"contains({column}, {sql_string(w)})" for w in words) or "false")


def mention_index(sents: Column, mention: Column) -> Column:
    """1-based index of the first sentence that holds the mention, 0 when none does."""
    def found(m):
        at = F.array_position(F.transform(sents, lambda s: F.lower(s).contains(m)), True)
        return F.coalesce(F.when(m != "", at), F.lit(0)).cast("int")

    return let(F.lower(strip(mention)), found)


def sentences_around(sents: Column, hit: Column, window: int, fallback: int) -> Column:
    """Sentences within ``window`` of ``hit``, or the first ``fallback`` ones without a hit."""
    first = F.greatest(F.lit(1), hit - window)
    last = F.least(F.size(sents), hit + window)
    near = F.slice(sents, first, F.greatest(F.lit(0), last - first + 1))
    return F.array_join(
        F.when(hit > 0, near).otherwise(F.slice(sents, 1, fallback)), " "
    )
