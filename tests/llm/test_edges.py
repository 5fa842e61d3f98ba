"""Every operator on awkward and on empty tables."""

from __future__ import annotations

import pytest

from riskloom.llm import (
    decontaminate, exact_dedup, language_id, minhash, mixing, sharding, suffix_dedup, token_pack, toxicity, url_filter,
)
from tests.llm import data

TREE = sharding.even_tree(4)
ROWS = {
    "language": lambda d: language_id.language_digest(d),
    "toxicity": lambda d: toxicity.toxicity_digest(d, data.labels(d.sparkSession)),
    "sharding": lambda d: sharding.sharded(d, TREE, sharding.grown(TREE, 4)),
    "mixing": lambda d: mixing.mix_digest(d),
    "tokens": lambda d: token_pack.token_digests(d),
    "suffix": lambda d: suffix_dedup.remove_repeats(d),
    "exact": lambda d: exact_dedup.exact_groups(d),
    "near": lambda d: minhash.near_duplicates(d, k=2),
}
FILTERS = {
    "toxicity": lambda d: toxicity.drop_toxic(d, d, data.labels(d.sparkSession)),
    "leaks": lambda d: decontaminate.drop_contaminated(d, data.benchmark(d.sparkSession)),
    "near": lambda d: minhash.drop_near_duplicates(d),
    "exact": lambda d: exact_dedup.drop_exact_duplicates(d),
    "mixing": lambda d: mixing.mix_documents(d),
}


@pytest.mark.parametrize("name", ROWS)
def test_one_row_each(spark, name):
    docs = data.documents(spark)
    assert ROWS[name](docs).count() == docs.count()


@pytest.mark.parametrize("name", ROWS)
def test_empty_table(spark, name):
    assert ROWS[name](data.empty(spark)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, name):
    docs = data.documents(spark)
    out = FILTERS[name](docs)
    assert sorted(out.columns) == sorted(docs.columns)
    assert out.select(docs.columns).schema.simpleString() == docs.schema.simpleString()
    assert out.count() > 0
    assert FILTERS[name](data.empty(spark)).count() == 0


def test_empty_side_tables(spark):
    docs = data.documents(spark)
    assert toxicity.toxicity_digest(docs, data.labels(spark).limit(0)).filter("score > 0.3").count() == 0
    assert decontaminate.leaks(docs, data.benchmark(spark).limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, data.benchmark(spark).limit(0)).count() == docs.count()
    assert language_id.identify(docs, {}).filter("lang_pred != 'und'").count() == 0
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
