"""Named queries over the driver tables: one or more for every operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F

from riskloom.functions import numeric as N, text as T
from riskloom.operators import (
    clustering as C, dashboard as D, detail as X, entities as E, fuzzy as Z, prefilter as P,
    report as R, risk as K, scoring as S,
)
from riskloom.plans import seeds, serve, views as V
from riskloom.plans.build import build
from riskloom.session import cut_lineage, first_existing, lookup, pinned, scratch_path
from riskloom.sources import readers, sinks, store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

TAXONOMY = seeds.with_driver_words(seeds.TAXONOMY_KEYWORDS)
OVERVIEW = seeds.with_driver_words(seeds.OVERVIEW_KEYWORDS)
DETAIL = seeds.with_driver_words(seeds.DETAIL_KEYWORDS)
WEIGHTS = seeds.TAXONOMY_WEIGHTS


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- stage tables -------------------------------------------------------------------------------

def evaluated(spark, sf):
    return P.prefilter(V.posts(spark, sf), V.lexicon(spark))


def kept(spark, sf):
    return P.kept(evaluated(spark, sf))


def resolved(spark, sf):
    """Kept posts with their exact and alias matches."""
    return E.resolve(kept(spark, sf), V.entities(spark), V.extra_aliases(spark), fuzzy=False)


def resolved_all(spark, sf):
    """All posts with their exact and alias matches."""
    posts = V.post_texts(spark, sf)
    return E.resolve(posts, V.entities(spark), V.extra_aliases(spark), fuzzy=False)


def expanded(spark, sf):
    return E.expand(resolved(spark, sf), V.entities(spark))


def clustered(spark, sf):
    """Expanded rows with one narrative per entity, over the pinned expansion."""
    return C.single_narratives(cut_lineage(expanded(spark, sf)))


def built(spark, sf):
    return build(
        V.posts(spark, sf), V.authors(spark, sf), V.entities(spark), V.extra_aliases(spark),
        V.lexicon(spark), TAXONOMY, WEIGHTS,
    )


def gated(spark, sf):
    """Rows that every tier resolved and the risk gate accepted, with one narrative per entity."""
    known = V.entities(spark)
    resolved_rows = E.resolve(kept(spark, sf), known, V.extra_aliases(spark))
    rows = pinned(K.contexts(E.expand(resolved_rows, known)), "contexts")
    routed = K.apply_decisions(rows, K.keyword_decisions(K.work_items(rows), TAXONOMY))
    return C.single_narratives(pinned(K.accepted_rows(routed), "accepted"))


def narratives_of(rows, spark, sf):
    """Scored narratives, written once: they are few, and dashboards read them several times."""
    return pinned(S.score(rows, V.authors(spark, sf), TAXONOMY, WEIGHTS), "narratives")


def risk_rows(spark, sf):
    return K.contexts(expanded(spark, sf))


def counted_stages(spark, sf, raw, passed, dropped):
    """Counts of the prefilter under these names, and gate rows (entity_id, _drop_reason).

    Posts are judged once: the pass that writes the expanded rows counts them on its way.
    """
    seen = Observation()
    judged = evaluated(spark, sf).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_drop_reason").isNull()).alias("kept")
    )
    known = V.entities(spark)
    resolved_rows = E.resolve(P.kept(judged), known, V.extra_aliases(spark), fuzzy=False)
    rows = pinned(K.contexts(E.expand(resolved_rows, known)).select("entity_id", "entity_label", "risk_context", "item_id"), "contexts")
    routed = K.apply_decisions(rows.select("entity_id", "item_id"), K.keyword_decisions(K.work_items(rows), TAXONOMY))
    found = seen.get
    counts = [(raw, found["rows"]), (passed, found["kept"]), (dropped, found["rows"] - found["kept"])]
    return lookup(spark, ["stage", "rows"], counts), rows, pinned(routed, "routed")


def label_decisions(items_rows, spark, sf):
    """Decision table from the label table: an item is risk when any of its posts is toxic."""
    labels = V.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("post_id"), (F.col("toxic") == 1).alias("toxic")
    )
    first = F.coalesce(F.get(T.sentences("risk_context"), F.lit(0)), F.lit(""))
    per_item = items_rows.join(labels, "post_id").groupBy(F.col("item_id").alias("id")).agg(
        F.bool_or("toxic").alias("is_risk"), F.min(first).alias("first")
    )
    summary = T.squash(T.without_quotes("first"))
    return per_item.select("id", "is_risk", F.when(F.col("is_risk"), summary).otherwise("").alias("summary"))


def local_groups(spark, sf):
    """Vectors with a given cluster, for the steps that follow the assignment."""
    rows = V.vectors(spark, sf)
    return rows.withColumn("cluster", (F.col("post_id").cast("long") % 5).cast("int"))


def weighted(rows):
    return rows.withColumns({"vec": N.unit("risk_embedding"), "weight": F.lit(1)})


# ---- sources and sinks --------------------------------------------------------------------------

@query
def read_posts_json(spark, sf):
    path = scratch_path(spark, "posts")
    V.posts(spark, sf).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).write.json(path)
    return readers.read_posts(spark, path).select(
        "post_id", F.length("text").cast("bigint").alias("text_length"), "platform", "created_at", "author_id",
        F.round("likes", 4).alias("likes"), "shares", "comments", "views",
    )


@query
def read_authors_csv(spark, sf):
    path = scratch_path(spark, "authors")
    V.authors(spark, sf).select("author_id", "followers").write.csv(path, header=True)
    return readers.read_authors(spark, path).select("author_id", F.round("followers", 4).alias("followers"))


@query
def read_entities_csv(spark, sf):
    path = scratch_path(spark, "entities")
    V.named_entities(spark, sf).drop("entity_pos").coalesce(1).write.csv(path, header=True)
    return readers.read_entities(spark, path).select("entity_id", "canonical_name", F.trim("aliases").alias("aliases"))


@query
def write_resolved_posts(spark, sf):
    path = scratch_path(spark, "resolved")
    sinks.write_resolved(resolved(spark, sf), path)
    back = spark.read.schema("post_id string, resolved_entities string, resolution_method string").json(path)
    matches = F.from_json("resolved_entities", E.MATCH_ARRAY)
    return back.select(
        "post_id", "resolution_method", F.size(matches).cast("bigint").alias("matches"),
        F.coalesce(F.get(matches, F.lit(0)).getField("mention_text"), F.lit("")).alias("first_mention"),
    )


@query
def write_clustered_posts(spark, sf):
    path = scratch_path(spark, "clustered")
    rows = clustered(spark, sf).withColumn("risk_embedding", F.array(F.lit(1.0)))
    sinks.write_clustered(rows, path)
    back = spark.read.json(path)
    return back.groupBy("narrative_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit("risk_embedding" in back.columns).alias("has_embedding"),
    )


@query
def write_rejected_posts(spark, sf):
    path = scratch_path(spark, "rejects")
    sinks.write_rejects(P.dropped(evaluated(spark, sf)), path)
    return spark.read.json(path).select("post_id", F.col("_drop_reason").alias("drop_reason"))


@query
def write_narrative_summary(spark, sf):
    path = scratch_path(spark, "narratives")
    sinks.write_narratives(narratives_of(clustered(spark, sf), spark, sf), path)
    return spark.read.schema(readers.NARRATIVES).json(path).select(
        "narrative_id", "title", "score", "risk_score_confidence", "volume",
        F.array_join("taxonomy_labels", "|").alias("taxonomy_labels"),
    )


@query
def load_stored_artifacts(spark, sf):
    folder = scratch_path(spark, "artifacts")
    rows = clustered(spark, sf)
    sinks.write_clustered(rows, f"{folder}/clustered_posts")
    sinks.write_narratives(narratives_of(rows, spark, sf), f"{folder}/narratives")
    return readers.load_artifacts(spark, folder, sinks.stored_posts(rows).schema).select(
        "post_id", "entity_id", "narrative_id",
        F.array_join("narrative_taxonomy_labels", "|").alias("labels"),
    )


@query
def artifact_files(spark, sf):
    folder = scratch_path(spark, "artifacts")
    sinks.write_resolved(resolved(spark, sf), f"{folder}/resolved_posts")
    files = readers.artifact_manifest(spark, folder).groupBy(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder")).agg(
        (F.sum("length") > 0).alias("filled")
    )
    lines = spark.read.text(f"{folder}/resolved_posts").groupBy(F.lit("resolved_posts").alias("folder")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return files.join(lines, "folder")


@query
def append_feedback_rows(spark, sf):
    path = scratch_path(spark, "feedback")
    rows = V.feedback(spark, sf)
    sinks.append_feedback(rows.filter("rating <= 3"), path)
    sinks.append_feedback(rows.filter("rating > 3"), path)
    return readers.read_or_empty(spark, path, readers.FEEDBACK).groupBy("narrative_id", "rating").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query
def append_override_rows(spark, sf):
    """Overrides appended in two parts, read back: the latest per narrative."""
    path = scratch_path(spark, "overrides")
    rows = V.overrides(spark, sf)
    sinks.append_overrides(rows.filter("score <= 50"), path)
    sinks.append_overrides(rows.filter("score > 50"), path)
    latest = spark.read.schema(rows.select("narrative_id", "score", "confidence", "reasoning", "at").schema).parquet(path)
    return latest.groupBy("narrative_id").agg(
        F.max_by("score", "at").alias("score"), F.max_by("reasoning", "at").alias("reasoning"), F.count(F.lit(1)).alias("rows")
    )


@query
def append_mark_rows(spark, sf):
    """Marks appended in two parts, read back and counted."""
    path = scratch_path(spark, "marks")
    rows = V.marks(spark, sf)
    sinks.append_marks(rows.filter("entity IS NULL"), path)
    sinks.append_marks(rows.filter("entity IS NOT NULL"), path)
    stored = spark.read.schema(rows.select("post_id", "narrative_id", "entity", "at").schema).parquet(path)
    return stored.groupBy("narrative_id", F.coalesce("entity", F.lit("")).alias("entity")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("at").alias("newest")
    )


@query
def tolerant_read(spark, sf):
    path = scratch_path(spark, "feedback")
    V.feedback(spark, sf).write.json(path)
    absent = readers.read_or_empty(spark, f"{path}-absent", readers.FEEDBACK)
    return readers.read_or_empty(spark, path, readers.FEEDBACK).unionByName(absent).groupBy("rating").agg(
        F.count(F.lit(1)).alias("rows")
    )


# ---- projections, filters, predicates -----------------------------------------------------------

@query
def signal_texts(spark, sf):
    number = F.col("post_id").cast("long") % 3
    altered = F.when(number == 0, F.concat(F.lit("altered: "), "text")).when(number == 1, F.lit(" \t "))
    posts = V.post_texts(spark, sf).withColumn("text_altered", altered)
    return posts.select("post_id", P.signal_text(posts).alias("signal_text"))


@query
def word_counts(spark, sf):
    return evaluated(spark, sf).select("post_id", F.col("_word_count").cast("bigint").alias("words"))


@query
def sentiment_compound(spark, sf):
    return evaluated(spark, sf).select("post_id", F.round("_vader_compound", 9).alias("compound"))


@query
def prefilter_reasons(spark, sf):
    return evaluated(spark, sf).select("post_id", F.coalesce("_drop_reason", F.lit("kept")).alias("reason"))


@query
def kept_posts(spark, sf):
    return kept(spark, sf).select("post_id", "text", "platform", "author_id")


@query
def dropped_posts(spark, sf):
    return P.dropped(evaluated(spark, sf)).select(
        "post_id", F.col("_word_count").cast("bigint").alias("words"), F.col("_drop_reason").alias("reason"),
        F.round("_vader_compound", 9).alias("compound"),
    )


@query
def numeric_coercion(spark, sf):
    events = V.table(spark, sf, "events")
    inner = F.get_json_object("props", "$.k")
    mixed = F.when(F.col("event_id") % 3 == 0, inner).when(F.col("event_id") % 3 == 1, F.col("event_type"))
    return events.select("event_id", N.num(mixed).alias("zero_default"), N.num(mixed, 0.5).alias("half_default"))


@query
def engagement_per_post(spark, sf):
    posts = V.posts(spark, sf)
    return posts.select(
        "post_id", F.round(N.engagement(posts), 4).alias("engagement"),
        N.engagement(posts.drop("likes", "views")).alias("without_likes_views"),
    )


@query
def text_forms(spark, sf):
    return V.post_texts(spark, sf).select(
        "post_id", T.normalize("text").alias("normalized"), T.compact("text").alias("compacted"),
        T.strip_quotes(T.squash("text")).alias("unquoted"), T.bounded_summary("text").alias("bounded"),
    )


@query
def quality_predicates(spark, sf):
    first = F.get(T.sentences("text"), F.lit(0))
    head = F.element_at(F.split(T.squash("text"), " "), 1)
    title = F.when(F.col("post_id").cast("long") % 2 == 0, F.concat(head, F.lit(" Narrative"))).otherwise(first)
    summary = F.when(F.col("post_id").cast("long") % 5 == 0, F.concat(F.lit(" Posts  mentioning "), head)).otherwise(first)
    return V.post_texts(spark, sf).select(
        "post_id", T.has_quotes("text").alias("has_quotes"), T.is_generic_title(title).alias("generic_title"),
        T.is_generic_summary(summary).alias("generic_summary"),
    )


@query
def first_existing_columns(spark, sf):
    """Time and author columns are found under any of their names."""
    rows = V.posts(spark, sf).withColumnsRenamed({"created_at": "posted_at", "author_id": "username"})
    return rows.select(
        "post_id", F.date_format(S.time_column(rows), "yyyy-MM-dd HH:mm").alias("time"),
        F.col(S.author_column(rows)).alias("author"),
        F.lit(first_existing(rows, ["absent", "posted_at"])).alias("time_column"),
    )


@query
def entity_filter(spark, sf):
    return D.filter_entity(expanded(spark, sf), "Tiontion").select("post_id", "entity", "resolution_confidence")


@query
def entity_option_list(spark, sf):
    return D.entity_options(V.named_entities(spark, sf))


@query
def narrative_lookup(spark, sf):
    rows = clustered(spark, sf)
    return D.narrative_by_id(narratives_of(rows, spark, sf), 3).select("narrative_id", "entity_id", "volume", "score")


@query
def valid_selection(spark, sf):
    ids = V.feedback(spark, sf).select("narrative_id").distinct()
    return D.existing_ids(narratives_of(clustered(spark, sf), spark, sf), ids)


@query
def score_bands(spark, sf):
    posts = V.posts(spark, sf)
    score = F.least(F.lit(100.0), F.round(posts["likes"] * 4, 1))
    stored = F.when(F.col("post_id").cast("long") % 2 == 0, F.lit("  ")).otherwise(F.lit(" Medium "))
    return posts.select(
        "post_id", N.score_band(score).alias("band"), N.severity_band(score).alias("severity"),
        N.match_band(score / 100).alias("match"), N.effective_confidence(stored, score).alias("effective"),
    )


# ---- text context -------------------------------------------------------------------------------

@query
def sentence_split(spark, sf):
    return V.post_texts(spark, sf).select(
        "post_id", F.posexplode(T.sentences("text")).alias("position", "sentence")
    ).select("post_id", F.col("position").cast("bigint").alias("position"), "sentence")


@query
def risk_contexts(spark, sf):
    rows = E.expand(resolved_all(spark, sf))
    return K.context_words(rows).select("post_id", "entity_id", "mention_text", "risk_context")


@query
def cluster_contexts(spark, sf):
    rows = E.expand(resolved_all(spark, sf))
    return K.context_chars(rows).select("post_id", "entity_id", "cluster_context")


@query
def narrative_snippets(spark, sf):
    rows = K.context_words(clustered(spark, sf), name="risk_summary")
    return S.snippets(rows).select("narrative_id", "snippet", "first_post")


@query
def narrative_quotes(spark, sf):
    rows = K.context_words(clustered(spark, sf))
    return X.quotes(rows).select("narrative_id", F.col("position").cast("bigint").alias("position"), "quote")


@query
def narrative_quotes_from_copies(spark, sf):
    """Narratives whose posts all share one context, so that quotes come from its chunks."""
    rows = C.single_narratives(V.post_texts(spark, sf).withColumn("entity_id", F.col("platform")))
    same = rows.withColumn(
        "risk_context", F.concat(F.lit("one  shared context of platform "), "platform",
                                 F.lit(" with more words than a single chunk can hold so that it is cut in two parts"))
    )
    return X.quotes(same).select("narrative_id", F.col("position").cast("bigint").alias("position"), "quote")


@query
def narrative_descriptions(spark, sf):
    scored = narratives_of(clustered(spark, sf), spark, sf)
    mixed = scored.withColumn(
        "summary", F.when(F.col("narrative_id") % 2 == 0, F.lit("A \"stored\"  summary’s text")).otherwise("")
    )
    return X.descriptions(mixed, seeds.IMPACT)


# ---- entity resolution --------------------------------------------------------------------------

@query
def alias_dictionary(spark, sf):
    terms = E.alias_dict(V.named_entities(spark, sf), V.named_extras(spark, sf))
    return terms.select(
        "entity_id", F.col("tier").cast("bigint").alias("tier"), F.col("alias_pos").cast("bigint").alias("alias_pos"),
        "term", "term_norm",
    )


@query
def alias_search_lists(spark, sf):
    lists = E.search_lists(V.named_entities(spark, sf), V.named_extras(spark, sf))
    return lists.select("entity_id", F.array_join("search_list", "|").alias("search_list"))


def _tier(spark, sf, tier):
    dictionary = E.alias_dict(V.entities(spark), V.extra_aliases(spark)).filter(F.col("tier") == tier)
    matches = E.exact_matches(E.with_hits(V.post_texts(spark, sf), dictionary))
    return matches.select("post_id", F.explode("_matches").alias("m")).select(
        "post_id", "m.entity_id", "m.mention_text", (-F.col("m.neg")).alias("confidence"), "m.method"
    )


@query
def exact_tier(spark, sf):
    return _tier(spark, sf, E.EXACT)


@query
def seed_alias_tier(spark, sf):
    return _tier(spark, sf, E.SEED_ALIAS)


@query
def extra_alias_tier(spark, sf):
    return _tier(spark, sf, E.EXTRA_ALIAS)


@query
def large_dictionary_tier(spark, sf):
    """The same matches through the equi-join that serves dictionaries too large for a row."""
    dictionary = E.alias_dict(V.entities(spark), V.extra_aliases(spark))
    matches = E.exact_matches(E.with_hits(V.post_texts(spark, sf), dictionary, in_row_terms=0))
    return matches.select("post_id", F.explode("_matches").alias("m")).select(
        "post_id", "m.entity_id", "m.mention_text", (-F.col("m.neg")).alias("confidence"), "m.method"
    )


@query
def entity_mentions(spark, sf):
    """Every kept match of every post, in confidence order."""
    return resolved_all(spark, sf).select("post_id", F.posexplode("resolved_entities").alias("position", "m")).select(
        "post_id", F.col("position").cast("bigint").alias("position"), "m.entity_id", "m.mention_text", "m.confidence"
    )


@query
def fuzzy_tier(spark, sf):
    everything = E.resolve(V.post_texts(spark, sf), V.entities(spark), V.extra_aliases(spark))
    return everything.filter("resolution_method = 'fuzzy'").select(
        "post_id", F.explode("resolved_entities").alias("m")
    ).select("post_id", "m.*")


@query
def resolved_posts(spark, sf):
    return resolved_all(spark, sf).select(
        "post_id", F.size("resolved_entities").cast("bigint").alias("matches"), "resolution_method",
        "entity", "resolution_confidence",
    )


@query
def resolved_every_tier(spark, sf):
    """Resolution of all posts with the fuzzy tier for those that nothing else matched."""
    everything = E.resolve(V.post_texts(spark, sf), V.entities(spark), V.extra_aliases(spark))
    return everything.select(
        "post_id", F.size("resolved_entities").cast("bigint").alias("matches"), "resolution_method",
        "entity", "resolution_confidence",
    )


@query
def expanded_posts(spark, sf):
    return E.expand(resolved_all(spark, sf), V.entities(spark)).select(
        "post_id", "entity_id", "entity", "mention_text", "resolution_confidence"
    )


@query
def entity_name_lookup(spark, sf):
    """Names by id where ids repeat (the last one wins) and where an id is unknown."""
    names = V.named_entities(spark, sf)
    again = names.filter("entity_pos % 3 = 0").withColumns(
        {"canonical_name": F.concat("canonical_name", F.lit(" v2")), "entity_pos": F.col("entity_pos") + 1_000_000_000}
    )
    rows = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("post_id"),
        F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.concat(F.lit("c"), F.col("o_custkey"))).alias("entity_id"),
        F.lit("kept label").alias("entity"),
    )
    return E.with_entity_names(rows, names.unionByName(again)).select("post_id", "entity_id", "entity")


# ---- risk gate ----------------------------------------------------------------------------------

@query
def risk_context_rows(spark, sf):
    return risk_rows(spark, sf).select("post_id", "entity_id", "entity_label", "risk_context", "item_id")


@query
def risk_work_items(spark, sf):
    return K.work_items(risk_rows(spark, sf))


@query
def work_item_batches(spark, sf):
    items = pinned(K.work_items(risk_rows(spark, sf)), "items")  # numbering reads them twice
    return K.batched(items, K.DECISION_BATCH).select("id", F.col("batch").cast("bigint").alias("batch"))


@query
def keyword_risk_decisions(spark, sf):
    return K.keyword_decisions(K.work_items(risk_rows(spark, sf)), TAXONOMY)


def payloads(spark, sf):
    """Raw decision payloads derived from the label table: plain, fenced and broken ones."""
    labels = V.table(spark, sf, "labels")
    row = F.concat(
        F.lit('{"results":[{"id":" '), F.col("doc_id"), F.lit('","is_risk":'),
        F.when(F.col("toxic") == 1, "true").otherwise("false"), F.lit(',"summary":"It\'s  a claim '),
        F.col("doc_id"), F.lit('"}]}'),
    )
    fenced = F.concat(F.lit("```json\n"), row, F.lit("\n```"))
    kind = F.col("doc_id") % 7
    return labels.select(
        "doc_id", F.when(kind == 3, F.lit('{"results":[')).when(kind == 4, F.lit("  "))
        .when(kind == 5, fenced).otherwise(row).alias("payload"),
    )


@query
def decision_payloads(spark, sf):
    return K.parse_decisions(payloads(spark, sf)).select(
        "doc_id", "id", "is_risk", "summary", F.coalesce("reason", F.lit("ok")).alias("reason")
    )


@query
def decision_violations(spark, sf):
    """A label-derived table misses unlabelled items and also holds ids that nothing asked for."""
    rows = cut_lineage(risk_rows(spark, sf))
    decisions = label_decisions(rows, spark, sf)
    stray = V.table(spark, sf, "labels").select(
        F.concat(F.lit("stray-"), F.col("doc_id") % 10).alias("id"), (F.col("toxic") == 1).alias("is_risk"),
        F.lit("posts mentioning things").alias("summary"),
    )
    return K.validate_decisions(K.work_items(rows), decisions.unionByName(stray))


@query
def routed_rows(spark, sf):
    rows = cut_lineage(risk_rows(spark, sf))
    routed = K.apply_decisions(rows, K.keyword_decisions(K.work_items(rows), TAXONOMY))
    return routed.select(
        "post_id", "entity_id", F.coalesce("_drop_reason", F.lit("accepted")).alias("route"),
        F.coalesce("risk_summary", F.lit("")).alias("risk_summary"),
    )


def _accepted(spark, sf):
    rows = cut_lineage(risk_rows(spark, sf))
    return K.accepted_rows(K.apply_decisions(rows, K.keyword_decisions(K.work_items(rows), TAXONOMY)))


@query
def summary_embeddings(spark, sf):
    """Every accepted row has a unit vector, and equal summaries have the same one."""
    rows = K.embed(_accepted(spark, sf))
    norm = F.sqrt(N.dot(F.col("risk_embedding"), F.col("risk_embedding")))
    return rows.groupBy("risk_summary").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("risk_embedding").alias("vectors"),
        F.round(F.min(norm), 6).alias("norm"),
    )


@query
def missing_summary_embeddings(spark, sf):
    """Summaries that a vector table does not cover: here it holds another text for those of even length."""
    rows = _accepted(spark, sf)
    other = F.when(F.length("risk_summary") % 2 == 1, F.col("risk_summary")).otherwise(F.concat(F.lit("\u001f"), "risk_summary"))
    table = rows.select(other.alias("risk_summary")).distinct().withColumn("risk_embedding", F.array(F.lit(1.0)))
    return K.missing_embeddings(K.embed(rows, table))


# ---- clustering ---------------------------------------------------------------------------------

@query
def cluster_sizes(spark, sf):
    return C.cluster_counts(V.vectors(spark, sf)).select("entity_id", "n", F.col("k").cast("bigint").alias("k"))


@query
def normalized_vectors(spark, sf):
    rows = C.l2_normalize(V.vectors(spark, sf))
    return rows.select("post_id", F.posexplode("risk_embedding").alias("dim", "value")).select(
        "post_id", F.col("dim").cast("bigint").alias("dim"), (F.round("value", 6) + 0.0).alias("value")
    )


@query
def grouped_clusters(spark, sf):
    """The contract of the grouped clustering: k, whole groups, no cost above the first round's."""
    rows = V.vectors(spark, sf)
    counts = C.cluster_counts(rows)
    points, centers = C.grouped_kmeans(rows, counts)
    per_entity = centers.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("points"),
        F.max("cost").alias("cost"), F.max("first_cost").alias("first_cost"),
    )
    return per_entity.join(counts, "entity_id").select(
        "entity_id", F.col("points").cast("bigint").alias("points"),
        (F.col("clusters") <= F.col("k")).alias("at_most_k"), (F.col("clusters") > 1).alias("more_than_one"),
        (F.col("cost") <= F.col("first_cost") + 1e-9).alias("cost_not_above_first"),
    )


@query
def lloyd_round(spark, sf):
    """One k-means round of all entities from the five lowest post ids of each."""
    rows = V.vectors(spark, sf)
    points = C.distinct_points(rows, C.cluster_counts(rows))
    first = W.partitionBy("entity_id").orderBy(F.col("post_id").cast("long"))
    start = rows.withColumn("cluster", F.row_number().over(first) - 1).filter("cluster < 5").select(
        "entity_id", F.lit(0).alias("trial"), F.col("cluster").cast("int").alias("cluster"), N.unit("risk_embedding").alias("vec")
    )
    moved = C.lloyd_step(points, start)
    return moved.select(
        "entity_id", F.col("cluster").cast("bigint").alias("cluster"), F.col("n").cast("bigint").alias("n"),
        F.round("cost", 6).alias("cost"), F.posexplode("vec").alias("dim", "value"),
    ).withColumns({"dim": F.col("dim").cast("bigint"), "value": F.round("value", 6) + 0.0})


@query
def cluster_fill(spark, sf):
    """Clusters and points of every entity after k-means: as many clusters as asked for, none of them empty."""
    rows = V.vectors(spark, sf)
    _, centers = C.grouped_kmeans(rows, C.cluster_counts(rows), trials=2)
    return centers.groupBy("entity_id").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("clusters"), F.sum("n").cast("bigint").alias("points")
    )


@query
def cluster_centroids(spark, sf):
    c = C.centroids(weighted(local_groups(spark, sf)))
    return c.select(
        "entity_id", F.col("cluster").cast("bigint").alias("cluster"), F.col("n").cast("bigint").alias("n"),
        F.posexplode("vec").alias("dim", "value"),
    ).select(
        "entity_id", "cluster", "n", F.col("dim").cast("bigint").alias("dim"), (F.round("value", 6) + 0.0).alias("value")
    )


@query
def nearest_cluster_pairs(spark, sf):
    near = C.nearest_clusters(C.centroids(weighted(local_groups(spark, sf))))
    return near.select(
        "entity_id", F.col("cluster").cast("bigint").alias("cluster"), F.col("nearest").cast("bigint").alias("nearest"),
        F.round("similarity", 6).alias("similarity"),
    )


@query
def merged_clusters(spark, sf):
    """Merging to a fixpoint leaves no mutual pair above the threshold and loses no cluster."""
    clusters = C.centroids(weighted(local_groups(spark, sf)))
    merged = C.merge_clusters(clusters, 0.2)
    return merged.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.bool_and(F.col("kept") <= F.col("cluster")).alias("kept_is_lowest"),
        F.min("kept").cast("bigint").alias("lowest"),
    )


@query
def merge_pairs(spark, sf):
    """Clusters that one merging round moves, and where they go."""
    pairs = C.merge_pairs(C.centroids(weighted(local_groups(spark, sf))), 0.1)
    return pairs.select("entity_id", *(F.col(c).cast("bigint").alias(c) for c in ("cluster", "target")))


@query
def merge_fixpoint(spark, sf):
    """Where every cluster ends up when merging has come to rest."""
    merged = C.merge_clusters(C.centroids(weighted(local_groups(spark, sf))), 0.1)
    return merged.select("entity_id", *(F.col(c).cast("bigint").alias(c) for c in ("cluster", "kept")))


@query
def contiguous_labels(spark, sf):
    """Local numbers without gaps where label 2 is skipped."""
    rows = local_groups(spark, sf).withColumn("cluster", F.col("cluster") + (F.col("cluster") >= 2).cast("int"))
    merged = rows.select("entity_id", "cluster").distinct().withColumn("kept", F.col("cluster"))
    return C.relabel(merged).select(
        "entity_id", F.col("cluster").cast("bigint").alias("cluster"), F.col("local_id").cast("bigint").alias("local_id")
    )


@query
def global_narrative_ids(spark, sf):
    rows = local_groups(spark, sf).drop("risk_embedding").withColumnRenamed("cluster", "local_id")
    return C.global_ids(rows).select("post_id", "entity_id", "narrative_id")


@query
def single_narrative_rows(spark, sf):
    return clustered(spark, sf).select("post_id", "entity_id", "narrative_id")


@query
def embedding_modes(spark, sf):
    """Entities with a missing vector are clustered on text."""
    vec = F.when(F.col("post_id").cast("long") % 97 != 5, F.col("risk_embedding"))
    return C.vector_mode(V.vectors(spark, sf).withColumn("risk_embedding", vec))


@query
def clustered_vectors(spark, sf):
    """All vectors through the whole clustering: nothing lost, narratives stay within entities."""
    rows = V.vectors(spark, sf).withColumn("text", F.lit(""))
    out = C.cluster(rows)
    per_narrative = out.groupBy("narrative_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("e"), F.min("entity_id").alias("entity_id")
    )
    return per_narrative.groupBy("entity_id").agg(
        F.sum("n").alias("rows"), F.bool_and(F.col("e") == 1).alias("one_entity_each")
    )


@query
def clustered_texts(spark, sf):
    """Expanded rows clustered on the context around their mention (text mode)."""
    out = C.cluster(expanded(spark, sf))
    return out.groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows"))


# ---- scoring ------------------------------------------------------------------------------------

@query
def narrative_totals(spark, sf):
    return S.narrative_base(clustered(spark, sf)).select(
        "entity_id", "narrative_id", "volume", F.round("engagement", 4).alias("engagement"), "entity",
        F.round("mean_confidence", 9).alias("mean_confidence"),
    )


@query
def row_followers(spark, sf):
    """Followers by author where author ids repeat (the first one wins)."""
    authors = V.authors(spark, sf)
    again = authors.filter("load_order % 2 = 0").withColumns(
        {"author_id": F.concat(F.lit(" "), "author_id"), "followers": F.col("followers") + 1.0,
         "load_order": F.col("load_order") + 1_000_000_000}
    )
    rows = V.posts(spark, sf)
    return S.with_followers(rows, authors.unionByName(again)).select(
        "post_id", F.round("_followers", 4).alias("followers")
    )


@query
def narrative_influence(spark, sf):
    return S.author_influence(clustered(spark, sf), V.authors(spark, sf)).select(
        "narrative_id", F.round("influence", 9).alias("influence")
    )


@query
def base_score_components(spark, sf):
    rows = clustered(spark, sf)
    df = S.same_narrative(S.narrative_base(rows), S.author_influence(rows, V.authors(spark, sf)))
    return S.base_components(df).select(
        "narrative_id", "volume_pressure", "engagement_pressure", "influence_pressure"
    )


@query
def match_confidence_labels(spark, sf):
    """Per author and entity, so that all three labels occur."""
    rows = expanded(spark, sf).withColumn("narrative_id", F.col("author_id").cast("long"))
    base = S.narrative_base(rows)
    return base.select(
        "entity_id", "narrative_id", S.confidence_label(F.col("mean_confidence"), F.col("volume")).alias("label")
    )


@query
def taxonomy_keyword_hits(spark, sf):
    hits = S.taxonomy_hits(clustered(spark, sf), TAXONOMY, WEIGHTS)
    return hits.select("narrative_id", "contributions", F.explode("hits").alias("label", "hits")).select(
        "narrative_id", "label", F.col("hits").cast("bigint").alias("hits"),
        F.col("contributions")[F.col("label")].alias("contribution"),
    )


@query
def taxonomy_top_labels(spark, sf):
    hits = S.taxonomy_hits(clustered(spark, sf), TAXONOMY, WEIGHTS)
    return hits.select("narrative_id", F.array_join("keyword_labels", "|").alias("labels"))


def supplied_lists(spark, sf):
    """Label lists derived from the label table: unknown, repeated, padded and missing ones."""
    names = list(WEIGHTS)
    pick = F.array(*[F.lit(n) for n in names])
    i, j = (F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 5).cast("int")
    return V.table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>"))
        .when(F.col("doc_id") % 3 == 0, F.array(F.lit("Not A Label"), F.concat(F.lit(" "), F.get(pick, i)), F.get(pick, j)))
        .otherwise(F.array(F.get(pick, i), F.get(pick, i), F.get(pick, j), F.get(pick, F.lit(6)))).alias("labels"),
    )


@query
def label_list_validation(spark, sf):
    checked = S.valid_labels(F.col("labels"), list(WEIGHTS))
    return supplied_lists(spark, sf).select(
        "doc_id", F.array_join(checked, "|").alias("valid"), (F.size(checked) == 0).alias("rejected")
    )


@query
def label_rank_points(spark, sf):
    points = S.label_points(F.col("labels"), WEIGHTS)
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in WEIGHTS]), F.array(*points))
    return supplied_lists(spark, sf).select("doc_id", F.explode(named).alias("label", "points"))


@query
def narrative_labels(spark, sf):
    """Supplied labels where there are any, else the keyword labels, else the default."""
    supplied = supplied_lists(spark, sf).select(F.col("doc_id").alias("narrative_id"), "labels")
    hits = S.taxonomy_hits(clustered(spark, sf), TAXONOMY, WEIGHTS)
    joined = hits.join(supplied, "narrative_id", "left")
    return joined.select(
        "narrative_id", F.array_join(S.chosen_labels(F.col("labels"), F.col("keyword_labels")), "|").alias("labels")
    )


@query
def score_component_map(spark, sf):
    return narratives_of(clustered(spark, sf), spark, sf).select(
        "narrative_id", F.explode("score_components").alias("component", "points")
    )


@query
def narrative_scores(spark, sf):
    return narratives_of(clustered(spark, sf), spark, sf).select(
        "narrative_id", "entity_id", "entity", "volume", "engagement", "score", "risk_score_confidence",
        F.array_join("taxonomy_labels", "|").alias("taxonomy_labels"),
    )


@query
def author_narrative_scores(spark, sf):
    """Scores of small groups (one per author and entity), where the clamp does not bite."""
    rows = cut_lineage(
        expanded(spark, sf).withColumns({"narrative_id": F.col("author_id").cast("long"), "views": F.lit(0.0)})
    )
    return narratives_of(rows, spark, sf).select(
        "entity_id", "narrative_id", "volume", "score", "risk_score_confidence",
        F.array_join("taxonomy_labels", "|").alias("taxonomy_labels"),
    )


@query
def narrative_trends(spark, sf):
    return S.trend(clustered(spark, sf)).select(
        "narrative_id", F.posexplode("trend").alias("point", "value")
    ).select("narrative_id", F.col("point").cast("bigint").alias("point"), F.round("value", 6).alias("value"))


@query
def author_trends(spark, sf):
    """Trends of small groups, which have one dated day, several, or none."""
    rows = expanded(spark, sf).withColumn("narrative_id", F.coalesce(F.col("author_id").cast("long") % 20, F.lit(-1)))
    return S.trend(rows).select(
        "entity_id", "narrative_id", F.posexplode("trend").alias("point", "value")
    ).select(
        "entity_id", "narrative_id", F.col("point").cast("bigint").alias("point"), F.round("value", 6).alias("value")
    )


@query
def narrative_titles(spark, sf):
    """Seeded titles of which some are blank or old truncated ones."""
    kind = F.col("narrative_id") % 3
    seeded = F.when(kind == 0, F.lit(" It's a “seeded” title ")).when(kind == 1, F.lit("An old cut title..."))
    rows = clustered(spark, sf).withColumns({"narrative_title": seeded, "narrative_summary": F.lit(' Stored  "text" ')})
    return narratives_of(rows, spark, sf).select("narrative_id", "title", "summary")


@query
def produced_metadata_check(spark, sf):
    """Quality gate of produced titles and summaries, over sentences of the posts."""
    sents = T.sentences("text")
    title = F.when(F.col("post_id").cast("long") % 4 == 0, F.lit("Brand  narrative")).otherwise(F.get(sents, F.lit(0)))
    summary = F.when(F.col("post_id").cast("long") % 6 == 1, F.lit(' " ')).otherwise(F.get(sents, F.lit(1)))
    return V.post_texts(spark, sf).select(
        "post_id", F.coalesce(S.valid_metadata(title, summary), F.lit(False)).alias("valid")
    )


@query
def narrative_entity_names(spark, sf):
    """Names per narrative where a narrative spans entities."""
    rows = expanded(spark, sf).withColumns({"narrative_id": F.col("author_id").cast("long") % 10, "entity_id": F.lit("all")})
    return S.entity_names(rows).select("narrative_id", "entity_names")


@query
def narrative_post_ids(spark, sf):
    return S.narrative_posts(clustered(spark, sf)).select("narrative_id", "post_id")


@query
def ranked_narratives(spark, sf):
    """Flagship: posts to ranked, entity-scoped narratives."""
    scored = S.ranked(narratives_of(clustered(spark, sf), spark, sf))
    return scored.select("rank", "narrative_id", "entity_id", "entity", "title", "score", "volume", "engagement")


@query
def gated_narratives(spark, sf):
    """Ranked narratives of posts that went through every resolution tier and the risk gate."""
    scored = S.ranked(narratives_of(gated(spark, sf), spark, sf))
    return scored.select("rank", "narrative_id", "entity_id", "entity", "title", "score", "volume", "engagement")


def _served(spark, sf, entity_id=None):
    folder = scratch_path(spark, "store")
    rows = gated(spark, sf)
    narratives = narratives_of(rows, spark, sf)
    store.save(S.attach_metadata(rows, narratives), narratives, folder)
    return serve.overview(spark, folder, V.authors(spark, sf), TAXONOMY, WEIGHTS, entity_id)


@query
def serve_overview(spark, sf):
    """The overview table from stored posts of all entities, scored again with stored titles and labels."""
    return _served(spark, sf).table.select(
        "rank", "narrative_id", "description", "entity", "volume", F.array_join("drivers", "|").alias("drivers"),
        "confidence", "risk_delta", "score",
    )


@query
def serve_entity(spark, sf):
    """Narratives per risk type of one entity, from its own folder of the store."""
    return D.with_acronym(_served(spark, sf, V.SERVED_ENTITY).narratives_by_type, seeds.ACRONYMS)


@query
def observed_stage_counts(spark, sf):
    """Rows of each stage of a whole build, as its writes reported them."""
    return built(spark, sf).counts().filter("stage <> 'narratives'")


@query
def attached_metadata(spark, sf):
    rows = clustered(spark, sf)
    known = F.when(F.col("narrative_id") % 2 == 1, F.col("narrative_id")).otherwise(-F.col("narrative_id"))
    scored = cut_lineage(narratives_of(rows, spark, sf).withColumn("narrative_id", known))
    return S.attach_metadata(rows, scored).select("post_id", "entity_id", "narrative_title", "narrative_summary")


@query
def build_stage_counts(spark, sf):
    known, rows, routed = counted_stages(spark, sf, "input_posts", "kept_posts", "dropped_posts")
    return S.stage_counts(
        {
            "entity_rows_after_resolution": rows, "entity_rows_risk_relevant": K.accepted_rows(routed),
            "entity_rows_dropped_no_risk": K.rejected_rows(routed),
        }, known,
    )


@query
def full_build(spark, sf):
    """The whole build with every default producer, fuzzy tier and clustering included."""
    return S.ranked(built(spark, sf).narratives).drop("trend", "score_components")


# ---- dashboard ----------------------------------------------------------------------------------

@query
def followers_enrichment(spark, sf):
    """Own followers where present, else the author's last entry, else 0."""
    authors = V.authors(spark, sf)
    again = authors.filter("load_order % 2 = 0").withColumns(
        {"followers": F.col("followers") + 1.0, "load_order": F.col("load_order") + 1_000_000_000}
    )
    own = F.when(F.col("post_id").cast("long") % 4 == 0, F.col("views"))
    rows = V.posts(spark, sf).withColumn("followers", own)
    return D.followers_enriched(rows, authors.unionByName(again)).select(
        "post_id", F.round("followers", 4).alias("followers")
    )


@query
def total_matched_posts(spark, sf):
    return D.total_posts(narratives_of(clustered(spark, sf), spark, sf))


@query
def posts_per_day(spark, sf):
    return D.posts_by_day(V.posts(spark, sf))


@query
def posts_trend_line(spark, sf):
    line = D.trend_line(D.posts_by_day(V.posts(spark, sf)), "date", "posts")
    return line.select(F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query
def narratives_per_type(spark, sf):
    kinds = D.narratives_by_type(narratives_of(clustered(spark, sf), spark, sf))
    return D.with_acronym(kinds, seeds.ACRONYMS)


@query
def label_lists_per_type(spark, sf):
    """The same over the label table's lists, with unknown and missing labels."""
    lists = supplied_lists(spark, sf).select(
        (F.col("doc_id") % 50).alias("narrative_id"), F.col("labels").alias("taxonomy_labels")
    )
    return D.with_acronym(D.narratives_by_type(lists), seeds.ACRONYMS)


@query
def match_confidence_histogram(spark, sf):
    return D.confidence_histogram(expanded(spark, sf)).select(
        F.col("bin").cast("bigint").alias("bin"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "frequency"
    )


@query
def event_value_histogram(spark, sf):
    """The histogram over values that fall into every bin and outside the range."""
    rows = V.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 13 != 0, F.col("value") / 40).alias("resolution_confidence")
    )
    return D.confidence_histogram(rows).select(F.col("bin").cast("bigint").alias("bin"), "frequency")


@query
def median_match_confidence(spark, sf):
    return D.median_confidence(expanded(spark, sf))


@query
def daily_total_risk(spark, sf):
    rows = clustered(spark, sf)
    daily = D.daily_total_risk(rows, narratives_of(rows, spark, sf))
    return daily.select("date", F.round("total_risk", 4).alias("total_risk"))


@query
def daily_risk_trend_line(spark, sf):
    rows = clustered(spark, sf)
    line = D.trend_line(D.daily_total_risk(rows, narratives_of(rows, spark, sf)), "date", "total_risk")
    return line.select(F.round("slope", 4).alias("slope"), F.round("intercept", 1).alias("intercept"))


@query
def narrative_overview_table(spark, sf):
    rows = clustered(spark, sf)
    made = D.narrative_table(narratives_of(rows, spark, sf), rows, include_entity=True)
    return made.select(
        "rank", "narrative_id", "description", "entity", "volume", F.array_join("drivers", "|").alias("drivers"),
        "confidence", "risk_delta", "score",
    )


@query
def majority_entities(spark, sf):
    rows = expanded(spark, sf).withColumns({"narrative_id": F.col("author_id").cast("long") % 10, "entity_id": F.lit("all")})
    return D.majority_entity(rows).select("narrative_id", "majority_entity")


@query
def risk_driver_lists(spark, sf):
    return narratives_of(clustered(spark, sf), spark, sf).select(
        "narrative_id", F.array_join(D.risk_drivers(threshold=9.0), "|").alias("drivers")
    )


@query
def narrative_header_facts(spark, sf):
    facts = X.header_facts(clustered(spark, sf))
    return facts.select(
        "narrative_id", "first_seen", "posts", F.round("engagement", 4).alias("engagement"), "authors",
        F.array_join("platforms", "|").alias("platforms"),
    )


@query
def daily_risk_delta(spark, sf):
    rows = clustered(spark, sf)
    return D.risk_delta(rows, narratives_of(rows, spark, sf)).select("narrative_id", "risk_delta")


@query
def narrative_risk_series(spark, sf):
    rows = clustered(spark, sf)
    series = X.risk_series(rows, narratives_of(rows, spark, sf))
    return series.select("narrative_id", "date", F.round("risk", 6).alias("risk"))


@query
def risk_series_trend_lines(spark, sf):
    rows = clustered(spark, sf)
    line = D.trend_line(X.risk_series(rows, narratives_of(rows, spark, sf)), "date", "risk", ["narrative_id"])
    return line.select("narrative_id", F.round("slope", 4).alias("slope"))


@query
def narrative_activity_series(spark, sf):
    series = X.activity_series(clustered(spark, sf))
    return series.select("narrative_id", "date", "posts", "authors", F.round("engagement", 4).alias("engagement"))


@query
def component_strengths(spark, sf):
    made = X.component_ranking(narratives_of(clustered(spark, sf), spark, sf))
    return made.select(
        "narrative_id", "feature", "contribution", "abs_contribution", F.round("strength", 9).alias("strength")
    )


@query
def types_and_drivers(spark, sf):
    made = D.type_and_drivers(narratives_of(clustered(spark, sf), spark, sf))
    return made.select(
        "narrative_id", F.array_join("risk_types", "|").alias("risk_types"), F.array_join("drivers", "|").alias("drivers")
    )


@query
def matched_post_table(spark, sf):
    rows = D.followers_enriched(clustered(spark, sf), V.authors(spark, sf))
    return X.matched_posts(rows).select(
        "narrative_id", "post_id", F.coalesce("created", F.lit("-")).alias("created"), "platform",
        F.length("text").cast("bigint").alias("text_length"), F.round("followers", 4).alias("followers"),
        F.round("engagement", 4).alias("engagement"), "match_confidence",
    )


@query
def post_inspection(spark, sf):
    return X.post_details(V.posts(spark, sf)).select("post_id", "author", "url")


@query
def keyword_types_head(spark, sf):
    return X.classify_by_keywords(clustered(spark, sf), OVERVIEW, X.HEAD_POSTS).select("narrative_id", "type")


@query
def keyword_types_all(spark, sf):
    return X.classify_by_keywords(clustered(spark, sf), DETAIL).select("narrative_id", "type")


@query
def author_keyword_types(spark, sf):
    rows = expanded(spark, sf).withColumn("narrative_id", F.col("author_id").cast("long"))
    return X.classify_by_keywords(rows, DETAIL).select("entity_id", "narrative_id", "type")


@query
def entity_overview_facts(spark, sf):
    return D.entity_overview(expanded(spark, sf))


# ---- report -------------------------------------------------------------------------------------

@query
def stage_funnel(spark, sf):
    known, _, routed = counted_stages(spark, sf, "Raw posts", "Resolved rows", "Dropped posts")
    accepted = K.accepted_rows(routed)
    return R.funnel(
        {
            "Dropped entity rows": K.rejected_rows(routed), "Clustered rows": accepted,
            "Narratives": accepted.select("entity_id").distinct(),
        }, known,
    )


@query
def resolution_method_mix(spark, sf):
    return R.method_mix(resolved_all(spark, sf))


@query
def resolution_confidence_bins(spark, sf):
    return R.confidence_bins(resolved_all(spark, sf)).select(F.col("bin").cast("bigint").alias("bin"), "count")


@query
def narrative_size_distribution(spark, sf):
    return R.size_distribution(clustered(spark, sf))


@query
def score_distribution(spark, sf):
    """Scores of small groups, which spread over the bins."""
    rows = cut_lineage(
        expanded(spark, sf).withColumns({"narrative_id": F.col("author_id").cast("long"), "views": F.lit(0.0)})
    )
    return R.score_distribution(narratives_of(rows, spark, sf)).select(F.col("bin").cast("bigint").alias("bin"), "count")


@query
def confidence_label_counts(spark, sf):
    return R.confidence_counts(narratives_of(clustered(spark, sf), spark, sf))


@query
def taxonomy_label_counts(spark, sf):
    """Label lists stored as arrays in string form, next to plain text labels."""
    lists = supplied_lists(spark, sf).select(
        F.when(F.col("doc_id") % 9 == 4, F.lit(" One plain label ")).otherwise(F.to_json("labels")).alias("taxonomy_labels")
    )
    return R.label_counts(lists)


# ---- overlays and feedback ----------------------------------------------------------------------

@query
def analyst_overrides(spark, sf):
    scored = narratives_of(clustered(spark, sf), spark, sf)
    return X.with_overrides(scored, V.overrides(spark, sf)).select(
        "narrative_id", "score", "risk_score_confidence", "reasoning"
    )


@query
def false_positive_posts(spark, sf):
    marks = V.marks(spark, sf)
    return X.without_false_positives(clustered(spark, sf), marks).select("post_id", "entity_id", "entity")


@query
def unmarked_narratives(spark, sf):
    marks = V.marks(spark, sf).filter("entity = 'None'")
    return X.unmarked_narratives(narratives_of(clustered(spark, sf), spark, sf), marks).select("narrative_id")


@query
def narrative_feedback(spark, sf):
    return X.feedback_summary(V.feedback(spark, sf)).select(
        "narrative_id", "ratings", F.round("mean_rating", 9).alias("mean_rating")
    )
