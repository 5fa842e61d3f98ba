"""Small tables that hold the awkward cases."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, h long, id long, key string, size int, part int, "
    "node long, bucket long, own long, component long, copy boolean, runs int, spans string, _part int, uid string"
)


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{'abcdefgh'[w % 8]}{w}x" for w in (rng.randrange(vocabulary) for _ in range(n)))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base.split()
    near[60] = "other"
    mixed_case = base.upper().lower().replace("a", "A")
    return [
        None, "", "   \n\t ", "word", "two words", "Two  Words", "two words", base, base, " ".join(near), base.replace(" ", "\n"), mixed_case,
        words(rng, 30_000, 5_000), "x" * 5_000, "éàü " * 100, base + " " + base, "ab" * 300, base[:99], base[:100], base[5:180],
        "no break   here   and \x1c there", "<|endoftext|> is text", "日本語のテキスト", "12345 67890", words(rng, 300),
    ]


def documents(spark: SparkSession, seed: int = 1) -> DataFrame:
    """Awkward texts with repeated rows, repeated and null ids, null languages and sources, and clashing columns."""
    rows = []
    for i, text in enumerate(texts(seed)):
        rows.append((i, text, ["en", "de", None][i % 3], ["s1", "s2", None, ""][i % 4], None if text is None else len(text)))
    rows += [rows[7], rows[9], (None, "an id is missing here", "en", "s1", 1), (None, rows[7][1], None, None, None), (3, "another text of three", "de", "s2", 2)]
    clash = (1, None, "k", 2, 3, 4, 5, 6, 7, True, 8, "s", 9, "u")
    return spark.createDataFrame([(*r, *clash) for r in rows], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, 1, i % 2) for i in range(10)] + [(None, 1, 1), (3, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark: SparkSession) -> DataFrame:
    base = texts()[7]
    rows = [(1, " ".join(base.split()[20:60])), (2, None), (3, ""), (4, "two words"), (5, words(random.Random(9), 40, 10**6)), (None, "no id at all here")]
    return spark.createDataFrame(rows, "item_id long, text string")
