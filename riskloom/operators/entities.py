"""Entity resolution: dictionary, exact and alias tiers, collection, expansion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import blank, let, normalize, strip
from riskloom.operators.fuzzy import fuzzy_matches, fuzzy_terms
from riskloom.session import BROADCAST_BYTES, bounded_rows, broadcast_blocks, pinned, pinned_union, row_keyed

# Confidence and method of each tier.
EXACT, SEED_ALIAS, EXTRA_ALIAS = 1, 2, 3
CONFIDENCE = {EXACT: 0.97, SEED_ALIAS: 0.92, EXTRA_ALIAS: 0.88}
METHOD = {EXACT: "exact", SEED_ALIAS: "exact alias", EXTRA_ALIAS: "exact alias"}

IN_ROW_TERMS = 256
ANCHOR_LENGTHS = [1, 2, 3, 4, 6, 8]
#: Words of 64 bits per anchor of the mask over them, and its words at most; more anchors only make it let more windows pass.
MASK_SPARSE, MASK_WORDS = 16, 1 << 16

MATCH_ARRAY = "array<struct<entity_id:string,mention_text:string,confidence:double>>"
HIT = (
    "struct<entity_pos:bigint,tier:int,alias_pos:int,entity_id:string,canonical_name:string,"
    "term:string,term_norm:string>"
)


def _by_tier(values: dict, tier: Column, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k, v in values.items():
        out = F.when(tier == k, F.lit(v)).otherwise(out)
    return out


def _seeds(entities: DataFrame) -> DataFrame:
    position = F.col("entity_pos") if "entity_pos" in entities.columns else F.lit(0)
    lists = (
        F.coalesce("search_list", F.array().cast("array<string>"))
        if "search_list" in entities.columns
        else F.array().cast("array<string>")
    )
    split = F.split(F.coalesce("aliases", F.lit("")), r"\|")
    return entities.select(
        strip("entity_id").alias("entity_id"),
        position.cast("bigint").alias("entity_pos"),
        strip("canonical_name").alias("canonical_name"),
        F.filter(F.transform(split, strip), lambda a: a != "").alias("seed"),
        F.filter(F.transform(lists, strip), lambda a: a != "").alias("listed"),
    ).filter(~blank("entity_id"))


def alias_dict(entities: DataFrame, extra: DataFrame) -> DataFrame:
    """One row per term: (entity_id, canonical_name, entity_pos, tier, alias_pos, term, term_norm).

    ``extra`` holds (entity_id, alias, pos). Null names and ids are absent, not the text "nan".
    """
    seeds = _seeds(entities)
    head = ["entity_id", "canonical_name", "entity_pos"]
    names = F.posexplode(F.array("canonical_name", "entity_id")).alias("alias_pos", "term")
    parts = [
        seeds.select(*head, F.lit(EXACT).alias("tier"), names),
        seeds.select(
            *head, F.lit(SEED_ALIAS).alias("tier"), F.posexplode("seed").alias("alias_pos", "term")
        ),
        seeds.join(extra, "entity_id").select(
            *head, F.lit(EXTRA_ALIAS).alias("tier"), F.col("pos").cast("int").alias("alias_pos"),
            F.col("alias").alias("term"),
        ),
    ]
    terms = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return terms.filter(~blank("term")).withColumn("term_norm", normalize("term"))


def search_lists(entities: DataFrame, extra: DataFrame) -> DataFrame:
    """(entity_id, search_list): sorted distinct seed, extra and listed aliases."""
    seeds = _seeds(entities)
    more = extra.groupBy("entity_id").agg(F.collect_set("alias").alias("more"))
    return seeds.join(more, "entity_id", "left").select(
        "entity_id", "canonical_name", "entity_pos",
        F.array_sort(
            F.array_union(
                F.array_union("seed", "listed"),
                F.coalesce("more", F.array().cast("array<string>")),
            )
        ).alias("search_list"),
    )


def _hits_in_row(posts: DataFrame, rows) -> DataFrame:
    """All dictionary terms tested inside each row; nothing is joined or shuffled."""
    ordered = sorted(rows, key=lambda r: (r["entity_pos"], r["entity_id"], r["tier"], r["alias_pos"]))
    terms = F.from_json(F.lit(json.dumps([r.asDict() for r in ordered])), f"array<{HIT}>")

    def contained(text):
        return F.filter(terms, lambda t: text.contains(t.getField("term_norm")))

    return posts.withColumn("_hits", let(F.col("_norm"), contained))


def _anchored(dictionary: DataFrame) -> DataFrame:
    """Adds ``_anchor``: of a term's pieces of one length, the one that the fewest terms hold.

    The length depends on that of the term, so that few lengths are in use. An opening that many terms share is no
    anchor as long as a term has anything of its own.
    """
    size = F.length("term_norm")
    length = F.lit(ANCHOR_LENGTHS[0])
    for n in ANCHOR_LENGTHS[1:]:
        length = F.when(size >= n, F.lit(n)).otherwise(length)
    terms = dictionary.select("term_norm").distinct().withColumn("_len", length)
    grams = terms.select(
        "term_norm",
        F.posexplode(F.transform(
            F.sequence(F.lit(1), F.length("term_norm") - F.col("_len") + 1),
            lambda i: F.substring(F.col("term_norm"), i, F.col("_len")),
        )).alias("_at", "_gram"),
    )
    held = grams.select("term_norm", "_gram").distinct().groupBy("_gram").agg(F.count(F.lit(1)).alias("_terms"))
    rarest = grams.join(held, "_gram").groupBy("term_norm").agg(
        F.min(F.struct("_terms", "_at", "_gram")).alias("_best")
    )
    return dictionary.join(rarest, "term_norm").select("*", F.col("_best._gram").alias("_anchor")).drop("_best")


def _anchor_mask(anchored: DataFrame):
    """A test that every anchor passes and few other texts do: one bit of a literal, addressed by two hashes."""
    anchors = anchored.select("_anchor").distinct()
    words = min(MASK_WORDS, 1 + anchors.count() * MASK_SPARSE)

    def word(text):
        return F.pmod(F.xxhash64(text), F.lit(words)).cast("int")

    def bit(text):
        return F.pmod(F.hash(text), F.lit(64))

    mask = [0] * words
    for row in anchors.select(word("_anchor").alias("word"), bit("_anchor").alias("bit")).groupBy("word").agg(
        F.collect_set("bit").alias("bits")
    ).collect():
        value = sum(1 << b for b in row["bits"])
        mask[row["word"]] = value - (1 << 64) if value >> 63 else value  # a signed long
    literal = F.from_json(F.lit(json.dumps(mask)), "array<bigint>")
    return lambda text: F.bit_get(F.get(literal, word(text)), bit(text)) == 1


def _hits_by_join(posts: DataFrame, dictionary: DataFrame, block_bytes: int) -> DataFrame:
    """Equi-join of the text's character windows with a rare piece of each term.

    A term can only occur where its anchor does, so no match is lost; ``contains`` then decides. Windows that cannot be an
    anchor are sorted out inside the row, so that the text is not repeated for each of them. The terms go to the
    posts in blocks of bounded bytes: texts and windows are not exchanged, whatever anchors they share.
    """
    posts = row_keyed(posts, "hits")  # ids may repeat or be null
    anchored = pinned(_anchored(dictionary), "anchors")
    lengths = [r[0] for r in anchored.select(F.length("_anchor")).distinct().collect()]
    windows = [
        F.regexp_extract_all("_norm", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sorted(lengths)
    ] or [F.array().cast("array<string>")]
    hit = F.struct(
        "entity_pos", "tier", "alias_pos", "entity_id", "canonical_name", "term", "term_norm"
    )
    possible = _anchor_mask(anchored)
    spread_out = posts.select(
        "_row", "_norm", F.explode(F.array_distinct(F.concat(*[F.filter(w, possible) for w in windows]))).alias("_anchor")
    )
    found = pinned_union([
        spread_out.join(block, "_anchor")
        .filter(F.col("_norm").contains(F.col("term_norm"))).select("_row", hit.alias("_hit"))
        for block in broadcast_blocks(anchored, block_bytes)
    ], "found")
    # a post's hits are bounded by the terms its own text can hold
    order = F.struct("_hit.entity_pos", "_hit.entity_id", "_hit.tier", "_hit.alias_pos", "_hit")
    per_post = found.groupBy("_row").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x.getField("_hit")).alias("_hits")
    )
    return posts.join(per_post, "_row", "left").drop("_row").withColumn(
        "_hits", F.coalesce("_hits", F.array().cast(f"array<{HIT}>"))
    )


def _mention(text: Column, term: Column) -> Column:
    """The term as the raw text spells it, or the term itself when only whitespace differs."""
    pattern = F.concat(F.lit(r"(?iu)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    found = F.call_function("regexp_extract", text, pattern, F.lit(0))
    return F.coalesce(F.nullif(found, F.lit("")), term)


def with_hits(
    posts: DataFrame, dictionary: DataFrame, in_row_terms: int = IN_ROW_TERMS, block_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Adds ``_norm`` and ``_hits``: every dictionary term that the normalized text contains.

    A dictionary of at most ``in_row_terms`` terms is tested inside each row, a larger one is joined in blocks of
    about ``block_bytes``.
    """
    normed = posts.withColumn("_norm", normalize(F.coalesce("text", F.lit(""))))
    rows = bounded_rows(dictionary, in_row_terms)
    if rows is not None:
        return _hits_in_row(normed, rows)
    return _hits_by_join(normed, dictionary, block_bytes)


def _first_spellings(matches: Column) -> Column:
    """Drops later repeats of the same (entity, lowered mention)."""
    def repeated(m, i):
        return F.exists(
            F.slice(matches, F.lit(1), i),
            lambda e: (e.getField("entity_id") == m.getField("entity_id"))
            & (F.lower(e.getField("mention_text")) == F.lower(m.getField("mention_text"))),
        )

    return F.array_sort(F.filter(matches, lambda m, i: ~repeated(m, i)))


def exact_matches(hits: DataFrame) -> DataFrame:
    """Adds ``_matches``: one per (entity, spelling), ordered by confidence and then by dictionary
    order. ``hits`` comes from ``with_hits``."""
    spelled = F.transform(
        "_hits",
        lambda h, i: F.struct(
            (-_by_tier(CONFIDENCE, h.getField("tier"), "double")).alias("neg"),
            i.alias("ord"),
            h.getField("entity_id").alias("entity_id"),
            _mention(F.col("text"), h.getField("term")).alias("mention_text"),
            _by_tier(METHOD, h.getField("tier"), "string").alias("method"),
            h.getField("canonical_name").alias("name"),
        ),
    )
    return hits.withColumn("_matches", let(spelled, _first_spellings)).drop("_hits")


def _collect(df: DataFrame) -> DataFrame:
    """Public match columns from ``_matches``; posts without a match are kept."""
    clean = F.transform(
        "_matches",
        lambda m: F.struct(
            m.getField("entity_id").alias("entity_id"),
            m.getField("mention_text").alias("mention_text"),
            (-m.getField("neg")).alias("confidence"),
        ),
    )
    methods = F.array_sort(F.array_distinct(F.transform("_matches", lambda m: m.getField("method"))))
    matched = F.size("_matches") > 0
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        clean.alias("resolved_entities"),
        F.when(matched, F.array_join(methods, ", ")).otherwise("none").alias("resolution_method"),
        F.when(matched, F.get("_matches", F.lit(0)).getField("name")).alias("entity"),
        F.when(matched, -F.get("_matches", F.lit(0)).getField("neg")).otherwise(0.0)
        .alias("resolution_confidence"),
    )


def resolve(
    posts: DataFrame,
    entities: DataFrame,
    extra: DataFrame,
    fuzzy: bool = True,
    threshold: float = 0.9,
) -> DataFrame:
    """Every post with its matches. The fuzzy tier only sees posts that nothing else matched.

    Rows are matched one by one: repeated or null post ids make no difference. With the fuzzy tier the exact matches are
    written once, under a row key; posts that have one are read back as they are, only the others are joined with
    their near terms.
    """
    matched = exact_matches(with_hits(posts, alias_dict(entities, extra)))
    if not fuzzy:
        return _collect(matched)
    tried = row_keyed(matched, "matched")
    found, rest = tried.filter(F.size("_matches") > 0).drop("_row"), tried.filter(F.size("_matches") == 0)
    terms = fuzzy_terms(search_lists(entities, extra))
    near = fuzzy_matches(rest.select(F.col("_row").alias("post_id"), "_norm"), terms, threshold)
    joined = rest.join(near.withColumnRenamed("post_id", "_row"), "_row", "left").withColumn(
        "_matches", F.coalesce("_near", "_matches")
    )
    return _collect(found).unionByName(_collect(joined))


def expand(resolved: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row per (post, entity) with the most confident mention; ties keep the earliest match.

    Choosing happens inside each post's own array, so the expansion needs no shuffle.
    """
    ranked = F.array_sort(
        F.transform(
            F.filter("resolved_entities", lambda m: ~blank(m.getField("entity_id"))),
            lambda m, i: F.struct(
                (-F.coalesce(m.getField("confidence"), F.lit(0.0))).alias("neg"),
                i.alias("ord"),
                strip(m.getField("entity_id")).alias("entity_id"),
                strip(m.getField("mention_text")).alias("mention_text"),
            ),
        )
    )

    def first_of_entity(matches):
        def repeated(m, i):
            return F.exists(
                F.slice(matches, F.lit(1), i),
                lambda e: e.getField("entity_id") == m.getField("entity_id"),
            )

        return F.filter(matches, lambda m, i: ~repeated(m, i))

    rows = (
        resolved.withColumn("_m", F.explode(let(ranked, first_of_entity)))
        .withColumns(
            {
                "entity_id": F.col("_m.entity_id"),
                "mention_text": F.col("_m.mention_text"),
                "resolution_confidence": -F.col("_m.neg"),
            }
        )
        .drop("_m")
    )
    return with_entity_names(rows, entities) if entities is not None else rows


def entity_names(entities: DataFrame) -> DataFrame:
    """(entity_id, name); of duplicate ids the last one loaded wins."""
    position = F.col("entity_pos") if "entity_pos" in entities.columns else F.lit(0)
    return (
        entities.filter(F.col("entity_id").isNotNull())
        .groupBy("entity_id").agg(F.max_by("canonical_name", position).alias("_name"))
    )


def with_entity_names(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity label from the entity table; ids it lacks keep the label they have."""
    return (
        rows.join(entity_names(entities), "entity_id", "left")
        .withColumn("entity", F.coalesce("_name", "entity"))
        .drop("_name")
    )
