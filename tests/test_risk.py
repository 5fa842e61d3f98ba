from __future__ import annotations

from riskloom.operators import risk as K
from riskloom.plans.seeds import TAXONOMY_KEYWORDS

TEXT = "One. Two. Three has Acme here! Four? Five. Six. Seven."


def rows(spark, *mentions, text=TEXT):
    data = [(str(i), text, "Acme", "acme", m) for i, m in enumerate(mentions)]
    return spark.createDataFrame(data, "post_id string, text string, entity string, entity_id string, mention_text string")


def test_context_windows(spark):
    df = rows(spark, "ACME", "absent", "", None, "One.")
    words = {r["post_id"]: r["risk_context"] for r in K.context_words(df).collect()}
    assert words["0"] == "One. Two. Three has Acme here! Four? Five."
    assert words["1"] == words["2"] == words["3"] == "One. Two. Three has Acme here! Four? Five."
    assert words["4"] == "One. Two. Three has Acme here!"
    chars = {r["post_id"]: r["cluster_context"] for r in K.context_chars(df).collect()}
    assert chars["0"] == "Two. Three has Acme here! Four?"
    assert chars["1"] == "One. Two. Three has Acme here!"
    cut = K.context_chars(df, max_chars=10).filter("post_id = '0'").first()["cluster_context"]
    assert cut == "Two. Th..."


def test_context_word_limit(spark):
    df = rows(spark, "w5", text=" ".join(f"w{i}" for i in range(150)))
    assert K.context_words(df).first()["risk_context"].split() == [f"w{i}" for i in range(100)]


def test_entity_label_falls_back(spark):
    df = spark.createDataFrame(
        [("1", "x", None, "id1", ""), ("2", "x", " ", None, "")],
        "post_id string, text string, entity string, entity_id string, mention_text string",
    )
    got = {r["post_id"]: r["entity_label"] for r in K.contexts(df).collect()}
    assert got == {"1": "id1", "2": "Entity"}


def test_work_items_are_distinct_and_batched(spark):
    items = K.work_items(K.contexts(rows(spark, "Acme", "acme", "Seven")))
    assert items.count() == 2
    many = spark.range(7).selectExpr("lpad(string(id), 3, '0') AS id")
    got = K.batched(many, 2).collect()
    sizes = [len([r for r in got if r["batch"] == b]) for b in range(4)]
    assert sizes == [2, 2, 2, 1] and len({r["id"] for r in got}) == 7
    assert K.batched(many.filter("false"), 2).count() == 0


def test_batches_are_runs_in_id_order(spark):
    many = spark.range(50).selectExpr("sha2(string(id), 256) AS id").repartition(7)
    got = {r["id"]: r["batch"] for r in K.batched(many, 2).collect()}
    assert got == {id_: place // 2 for place, id_ in enumerate(sorted(got))} and len(got) == 50


def test_payloads(spark):
    raw = spark.createDataFrame(
        [
            (1, '{"results":[{"id":"a","is_risk":true,"summary":"It\'s  \\"bad\\""},{"id":"b","is_risk":false,"summary":"x"}]}'),
            (2, '```json\n{"results":[{"id":"c","is_risk":true,"summary":"s"}]}\n```'),
            (3, '{"results":['), (4, None), (5, '{"other":1}'),
        ],
        "batch int, payload string",
    )
    got = {(r["batch"], r["id"]): (r["is_risk"], r["summary"], r["reason"]) for r in K.parse_decisions(raw).collect()}
    assert got == {
        (1, "a"): (True, "Its bad", None), (1, "b"): (False, "", None), (2, "c"): (True, "s", None),
        (3, None): (None, None, "invalid_schema"), (4, None): (None, None, "empty_payload"),
        (5, None): (None, None, "invalid_schema"),
    }


def test_validation_names_every_problem(spark):
    items = spark.createDataFrame([(i,) for i in "abcde"], "id string")
    decisions = spark.createDataFrame(
        [("a", True, "A claim"), ("a", True, "A claim"), ("b", None, ""), ("c", True, "posts mentioning x"),
         ("d", False, "stray"), ("z", False, "")],
        "id string, is_risk boolean, summary string",
    )
    got = {(r["id"], r["reason"]) for r in K.validate_decisions(items, decisions).collect()}
    assert got == {
        ("a", "duplicate_id"), ("b", "non_boolean_is_risk"), ("c", "generic_summary"),
        ("d", "summary_without_risk"), ("e", "missing_id"), ("z", "unexpected_id"),
    }


def test_routing_splits_all_rows(spark):
    base = K.contexts(rows(spark, "Acme", "Seven", text="A fraud happened. Acme did it. B. C. D. E. Seven."))
    routed = K.apply_decisions(base, K.keyword_decisions(K.work_items(base), TAXONOMY_KEYWORDS))
    kept, dropped = K.accepted_rows(routed).collect(), K.rejected_rows(routed).collect()
    assert [r["risk_summary"] for r in kept] == ["A fraud happened."]
    assert [r["_drop_reason"] for r in dropped] == [K.NOT_RISK]


def test_embeddings_by_distinct_summary(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c d e")], "post_id string, risk_summary string")
    vectors = {r["post_id"]: r["risk_embedding"] for r in K.embed(df).collect()}
    assert vectors["1"] == vectors["2"] != vectors["3"]
    table = spark.createDataFrame([("a b", [1.0])], "risk_summary string, risk_embedding array<double>")
    assert [r[0] for r in K.missing_embeddings(K.embed(df, table)).collect()] == ["c d e"]
