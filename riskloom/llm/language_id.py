"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sample texts. A text is compressed in blocks with every
dictionary; the smallest total wins. The margin to the second decides how sure that is, and whether it is rejected.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskloom.llm.common import has_letter, kept, lowest_hashes, slices

#: Labelled documents per language that make up its dictionary, characters of each, and bytes of a dictionary. Many
#: short excerpts keep boilerplate that one of them quotes from deciding.
TRAIN_DOCS, TRAIN_CHARS, DICTIONARY_BYTES = 1_000, 120, 96 << 10
#: Bytes of text compressed together (all of a text is, block by block), and the compression level.
BLOCK_BYTES, LEVEL = 1024, 5
#: Relative saving over the second-best language below which a text is rejected.
NARROW = 0.02
UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, and one space for whatever is no letter."""
    return NOT_LETTERS.sub(" ", text.lower())


class Classifier:
    """Dictionaries by language, ready to compress with."""

    def __init__(self, samples: dict[str, bytes]):
        import zstandard

        self.languages = sorted(samples)
        self.compressors = []
        for name in self.languages:
            content = zstandard.ZstdCompressionDict(samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=BLOCK_BYTES, dict_size=len(samples[name]), write_content_size=0, write_dict_id=0
            )
            content.precompute_compress(compression_params=how)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=how, dict_data=content))

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes of a text under each dictionary."""
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors], float)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected): the score is the chance of the best against the second, from the bytes saved.

        Null texts and texts without a letter are undetermined with score 0; equal sizes go to the first language.
        """
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        data = letters(text).encode()
        sizes = self.sizes(data)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.languages[0], 1.0, False
        saved = float(np.partition(sizes, 1)[1] - sizes[best])
        return self.languages[best], float(-np.expm1(-saved / 8)), saved < NARROW * sizes[best]


def learn(docs: DataFrame, usable: Column | None = None, per_language: int = TRAIN_DOCS) -> dict[str, bytes]:
    """Dictionary bytes by language from at most ``per_language`` hash-chosen documents of each.

    Only doc_id and lang are read to choose them; the texts of the chosen rows follow by a broadcast of bounded size.
    Rows without lang, doc_id or text are not learned from; of rows that repeat an id and language one excerpt is.
    """
    known = docs.select("doc_id", "lang").filter("lang is not null and doc_id is not null and text is not null")
    known = (known if usable is None else known.filter(usable)).withColumn("_h", F.xxhash64("doc_id", F.lit(3)))
    order = W.partitionBy("lang").orderBy("_h", "doc_id")
    few = lowest_hashes(known, "_h", per_language, "lang").distinct()
    chosen = few.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language).select("doc_id", "lang", "_n")
    texts = docs.select("doc_id", "lang", F.expr(f"substring(text, cast(char_length(text) / 3 as int) + 1, {TRAIN_CHARS})").alias("text"))
    found = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "_n").agg(F.min("text").alias("text"))
    rows = found.toPandas().sort_values(["lang", "_n"])
    samples = {}
    for lang, own in rows.groupby("lang"):
        # nearest to the end is cheapest to refer to; the last bytes are kept
        content = " ".join(letters(t) for t in own["text"] if t and has_letter(t)).encode()[-DICTIONARY_BYTES:]
        if len(content) >= 8:
            samples[lang] = content
    return samples


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (0 to 1), rejected. Only the text decides.

    Rejected texts still name the best language; callers choose. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, samples))  # DICTIONARY_BYTES per language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, samples = shared.value
        own = kept(key, lambda: Classifier(samples))
        for big in batches:
            for batch in slices(big, 1):
                found = [own.judge(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                     pa.array([f[2] for f in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, rejected; learned from the rows that are not held out."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    return identify(docs, learn(docs, fold != 0)).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")
