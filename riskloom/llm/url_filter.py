"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Only DataFrame expressions and Spark ML. The rules label the urls they fit; the trees learn those labels from how a
url looks and judge the urls that no rule fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import lowest_hashes, pin

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Labelled urls that the trees see at most, chosen by hash.
TRAIN_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def matched_rule(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits. The rules are literals of the plan."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    found = [
        F.when(
            ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in ordered
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")

    def term(c):
        p = F.size(F.filter(chars, lambda d: d == c)) / n
        return -p * F.log2(p)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + term(c))


def _bucket(text: Column, n: int, seed: int) -> list[Column]:
    """Suffix statistics as ``n`` indicator slots of a hashed suffix."""
    slot = F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(n))
    return [(slot == i).cast("double") for i in range(n)]


def features() -> list[Column]:
    """Lexical features of url, host and path; a null url counts as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    host, path = F.col("host"), F.col("path")
    suffix = F.regexp_extract(host, r"([^.]*)$", 1)
    first_dir = F.regexp_extract(path, r"^/([^/]*)", 1)
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    return [
        n, F.char_length(host).cast("double"), F.char_length(path).cast("double"), count(path, "/"), count(host, r"\."),
        count(url, "[0-9]") / n, count(path, "[0-9]"), count(url, "[^A-Za-z0-9]") / n, _entropy(host), _entropy(path),
        count(url, "[?&][^=&#?]+="), F.contains(url, F.lit("#")).cast("double"), F.startswith(url, F.lit("https")).cast("double"),
        F.endswith(path, F.lit("/")).cast("double"), F.char_length(suffix).cast("double"), F.char_length(first_dir).cast("double"),
        *_bucket(suffix, 8, 1), *_bucket(first_dir, 8, 2), *_bucket(ending, 4, 3),
    ]


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS, rounds: int = 10) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, block_probability.

    The longest fitting rule decides (of equally long ones the first given). Other urls, null ones too, get the trees'
    verdict (block from 0.5); the trees are fitted on at most ``train_rows`` rule-labelled urls. With labels of one
    kind only, that kind is the verdict; with none, allow. Repeated rows are judged each. Other columns are ignored.
    """
    vector = F.array(*features())
    names = [f"_f{i}" for i in range(len(features()))]
    base = with_host_and_path(pages.select("page_id", "url")).withColumn("_match", matched_rule(rules))
    labelled = base.filter("_match is not null").select(
        (F.col("_match.verdict") == "block").cast("double").alias("label"), F.xxhash64("url").alias("_h"), vector.alias("_v")
    )
    train = pin(lowest_hashes(labelled, "_h", train_rows).orderBy("_h").limit(train_rows), "urls")
    kinds = [r["label"] for r in train.select("label").distinct().collect()]
    wide = lambda df: VectorAssembler(inputCols=names, outputCol="features").transform(
        df.select("*", *(F.col("_v")[i].alias(c) for i, c in enumerate(names)))
    )
    if len(kinds) == 2:
        model = GBTClassifier(maxIter=rounds, maxDepth=4, maxBins=16, stepSize=0.3, seed=7).fit(wide(train).select("label", "features"))
        scored = model.transform(wide(base.withColumn("_v", vector)))
        probability = vector_to_array("probability")[1]
    else:
        scored, probability = base, F.lit(kinds[0] if kinds else 0.0)
    scored = scored.withColumn("block_probability", probability)
    verdict = F.coalesce(F.col("_match.verdict"), F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("_match.rule").alias("rule"), verdict.alias("verdict"), "block_probability")
