"""The named queries again, as SQL for DuckDB: the results they are checked against.

Shared steps are common table expressions; ``_sql`` adds those a query needs.
"""

from __future__ import annotations

import re

from riskloom.plans import seeds
from riskloom.plans.queries import DETAIL, OVERVIEW, TAXONOMY, WEIGHTS
from riskloom.plans.views import SERVED_ENTITY


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    def one(v):
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return _text(v) if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def _keywords(sets: dict[str, list[str]]) -> str:
    rows = [(label, i, w) for i, (label, words) in enumerate(sets.items()) for w in words]
    return _values(rows, "label, label_pos, word")


def _squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _no_quotes(c: str) -> str:
    return f"translate({c}, '\"''“”‘’', '')"


def _compact(c: str, n: int) -> str:
    s = _squash(c)
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE substr({s}, 1, {n - 3}) || '...' END"


def _sentences(c: str) -> str:
    marked = f"regexp_replace({_squash(c)}, '([.!?]) ', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def _display(c: str) -> str:
    return (
        f"CASE {c} WHEN 'Volume pressure' THEN 'High Volume' WHEN 'Engagement pressure' THEN 'High Engagement' "
        f"WHEN 'Author influence pressure' THEN 'Influential Authors' "
        f"ELSE regexp_replace({c}, '^Language signal: *', 'Language Risk: ') END"
    )


WORDS = r"'[A-Za-z0-9#@$&''\-]+'"

CTES: dict[str, str] = {
    "lexicon": _values(seeds.DRIVER_LEXICON, "token, valence"),
    "entities": _values([(*r, i) for i, r in enumerate(seeds.DRIVER_ENTITIES)], "entity_id, canonical_name, aliases, entity_pos"),
    "extra": _values(
        [(e, a, i) for e, names in seeds.DRIVER_EXTRA_ALIASES.items() for i, a in enumerate(names)], "entity_id, alias, pos"
    ),
    "taxonomy": _keywords(TAXONOMY),
    "overview_words": _keywords(OVERVIEW),
    "detail_words": _keywords(DETAIL),
    "weights": _values([(label, i, float(w)) for i, (label, w) in enumerate(WEIGHTS.items())], "label, label_pos, weight"),
    "acronyms": _values(list(seeds.ACRONYMS.items()), "type, acronym"),
    "impact": _values(list(seeds.IMPACT.items()), "label, effect"),
    "posts": """
        SELECT CAST(doc_id AS VARCHAR) AS post_id, text, source AS platform, CAST(n_chars % 50 AS DOUBLE) AS shares,
               CAST(doc_id % 7 AS DOUBLE) AS comments, CAST(n_chars AS DOUBLE) AS views, e.ts AS created_at,
               CAST(e.user_id AS VARCHAR) AS author_id, e.value AS likes
        FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id * 10""",
    "sums": f"""
        SELECT post_id, sum(valence) AS total FROM (
            SELECT post_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS token FROM posts
        ) JOIN lexicon USING (token) GROUP BY post_id""",
    "evaluated": f"""
        SELECT p.*, CAST(len(regexp_extract_all(text, {WORDS})) AS BIGINT) AS words, coalesce(total, 0.0) AS s,
               round(s / sqrt(s * s + 15.0), 4) + 0.0 AS compound,
               CASE WHEN words > 2000 THEN 'too_long_over_2000_words'
                    WHEN compound >= 0 THEN 'non_negative_vader_compound' END AS reason
        FROM posts p LEFT JOIN sums USING (post_id)""",
    "kept": "SELECT * EXCLUDE (words, s, compound, reason) FROM evaluated WHERE reason IS NULL",
    "dict": f"""
        SELECT *, lower({_squash('term')}) AS term_norm FROM (
            SELECT entity_id, canonical_name, entity_pos, 1 AS tier, 0 AS alias_pos, canonical_name AS term FROM entities
            UNION ALL SELECT entity_id, canonical_name, entity_pos, 1, 1, entity_id FROM entities
            UNION ALL SELECT entity_id, canonical_name, entity_pos, 2, generate_subscripts(l, 1) - 1, unnest(l) FROM (
                SELECT *, list_filter(list_transform(string_split(aliases, '|'), lambda a: trim(a)), lambda a: a <> '') AS l
                FROM entities)
            UNION ALL SELECT entity_id, canonical_name, entity_pos, 3, pos, alias FROM entities JOIN extra USING (entity_id)
        ) WHERE trim(term) <> ''""",
}


def _resolution(base: str) -> dict[str, str]:
    """Exact and alias resolution of the posts in ``base``."""
    return {
        f"matches_{base}": f"""
            SELECT *, CASE tier WHEN 1 THEN 0.97 WHEN 2 THEN 0.92 ELSE 0.88 END::DOUBLE AS confidence,
                   CASE tier WHEN 1 THEN 'exact' ELSE 'exact alias' END AS method,
                   row_number() OVER (PARTITION BY post_id ORDER BY tier, entity_pos, alias_pos) - 1 AS spot
            FROM (
                SELECT post_id, entity_id, canonical_name, entity_pos, tier, alias_pos,
                       CASE WHEN instr(lower(text), lower(term)) > 0
                            THEN substr(text, instr(lower(text), lower(term)), length(term)) ELSE term END AS mention_text
                FROM {base} JOIN dict ON contains(lower({_squash('text')}), term_norm)
                QUALIFY row_number() OVER (PARTITION BY post_id, entity_id, lower(mention_text)
                                           ORDER BY entity_pos, tier, alias_pos) = 1)""",
        f"resolved_{base}": f"""
            SELECT p.*, coalesce(m.matches, 0) AS matches, coalesce(m.methods, 'none') AS resolution_method,
                   m.name AS entity, coalesce(m.confidence, 0.0) AS resolution_confidence,
                   coalesce(m.first_mention, '') AS first_mention
            FROM {base} p LEFT JOIN (
                SELECT post_id, count(*) AS matches, string_agg(DISTINCT method, ', ' ORDER BY method) AS methods,
                       min_by(canonical_name, spot) AS name, max(confidence) AS confidence,
                       min_by(mention_text, spot) AS first_mention
                FROM matches_{base} GROUP BY post_id) m USING (post_id)""",
        f"expanded_{base}": f"""
            SELECT p.*, m.entity_id, m.canonical_name AS entity, trim(m.mention_text) AS mention_text,
                   m.confidence AS resolution_confidence
            FROM {base} p JOIN (
                SELECT * FROM matches_{base}
                QUALIFY row_number() OVER (PARTITION BY post_id, entity_id ORDER BY confidence DESC, spot) = 1
            ) m USING (post_id)""",
    }


def _block(alo: str, ahi: str, blo: str, bhi: str) -> str:
    """Longest common block of a[alo:ahi] and b[blo:bhi], the earliest in a, then in b, as one number: its length in the
    millions, then 999 minus each start."""
    same = "substr(a, i, q) = substr(b, j, q)"
    size = f"len(list_filter(range(1, least({ahi} - i, {bhi} - j) + 1), lambda q: {same}))"
    inner = f"list_max(list_transform(range({blo}, {bhi}), lambda j: {size} * 1000000 + (999 - i) * 1000 + 999 - j))"
    return f"list_max(list_transform(range({alo}, {ahi}), lambda i: {inner}))"


CTES.update({
    "fuzzy_terms": r"""
        SELECT entity_id, canonical_name, entity_pos, term_pos, lower(term) AS term_norm,
               len(regexp_extract_all(lower(term), '[A-Za-z0-9#&$@\-]+')) AS width
        FROM (
            SELECT entity_id, canonical_name, entity_pos, 0 AS term_pos, canonical_name AS term FROM entities
            UNION ALL
            SELECT entity_id, canonical_name, entity_pos, row_number() OVER (PARTITION BY entity_id ORDER BY term), term
            FROM (SELECT DISTINCT entity_id, canonical_name, entity_pos, term FROM dict WHERE tier > 1))
        WHERE width > 0""",
    "open_tokens": rf"""
        SELECT post_id, regexp_extract_all(lower({_squash('text')}), '[A-Za-z0-9#&$@\-]+') AS tokens
        FROM posts WHERE post_id NOT IN (SELECT post_id FROM matches_posts)""",
    "open_windows": """
        SELECT post_id, width, start, array_to_string(tokens[start : start + width - 1], ' ') AS win
        FROM (SELECT post_id, width, tokens, unnest(range(1, len(tokens) - width + 2)) AS start
              FROM open_tokens, (SELECT DISTINCT width FROM fuzzy_terms))""",
    "fuzzy_candidates": """
        SELECT term_norm AS a, win AS b
        FROM (SELECT DISTINCT width, win FROM open_windows) JOIN (SELECT DISTINCT width, term_norm FROM fuzzy_terms) USING (width)
        WHERE 2.0 * least(length(a), length(b)) >= 0.9 * (length(a) + length(b)) - 1e-9
          AND 2.0 * list_sum(list_transform(list_distinct(string_split(a, '')), lambda c:
              least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, '')))))
              >= 0.9 * (length(a) + length(b)) - 1e-9""",
    # the parts left and right of a common block are compared again, until nothing is common
    "fuzzy_blocks": f"""
        SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi,
               {_block('1', 'length(a) + 1', '1', 'length(b) + 1')} AS best
        FROM fuzzy_candidates
        UNION ALL
        SELECT *, {_block('alo', 'ahi', 'blo', 'bhi')} AS best FROM (
            SELECT a, b, unnest([alo, i + k]) AS alo, unnest([i, ahi]) AS ahi, unnest([blo, j + k]) AS blo, unnest([j, bhi]) AS bhi
            FROM (SELECT *, best // 1000000 AS k, 999 - (best // 1000) % 1000 AS i, 999 - best % 1000 AS j
                  FROM fuzzy_blocks WHERE best >= 1000000))
        WHERE alo < ahi AND blo < bhi""",
    "fuzzy_ratios": """
        SELECT a, b, 2.0 * sum(best // 1000000) / (length(a) + length(b)) AS ratio FROM fuzzy_blocks GROUP BY a, b
        HAVING ratio >= 0.9""",
})
CTES.update(_resolution("posts"))
CTES.update(_resolution("kept"))


def _context(base: str, window: int, fallback: int) -> str:
    return f"""
        SELECT *, array_to_string(CASE WHEN hit > 0
                   THEN list_slice(sents, greatest(1, hit - {window}), least(len(sents), hit + {window}))
                   ELSE list_slice(sents, 1, {fallback}) END, ' ') AS ctx
        FROM (SELECT *, coalesce(CASE WHEN m <> '' THEN list_position(
                         list_transform(sents, lambda s: contains(lower(s), m)), true) END, 0) AS hit
              FROM (SELECT *, {_sentences('text')} AS sents, lower(trim(mention_text)) AS m FROM {base}))"""


def _risk(base: str) -> str:
    return f"""
        SELECT *, array_to_string(list_slice(string_split(ctx, ' '), 1, 100), ' ') AS risk_context
        FROM ({_context(base, 2, 5)})"""


def _hits(rows: str, words: str) -> str:
    """Keyword counts per group of ``rows`` (entity_id, narrative_id) and label."""
    return f"""
        SELECT entity_id, narrative_id, label, label_pos,
               CAST(sum((length(t) - length(replace(t, word, ''))) // length(word)) AS BIGINT) AS hits
        FROM (SELECT entity_id, narrative_id, lower(text) AS t FROM {rows}) CROSS JOIN {words}
        GROUP BY ALL"""


def _classified(rows: str, words: str) -> str:
    return f"""
        SELECT entity_id, narrative_id, CASE WHEN max(n) = 0 THEN 'Operational Resilience'
               ELSE min_by(label, (-n) * 100 + label_pos) END AS type
        FROM (SELECT entity_id, narrative_id, label, label_pos, count(DISTINCT CASE WHEN contains(t, word) THEN word END) AS n
              FROM (SELECT entity_id, narrative_id, lower(text) AS t FROM {rows}) CROSS JOIN {words} GROUP BY ALL)
        GROUP BY ALL"""


def _scoring(rows: str) -> dict[str, str]:
    """Narratives over ``rows``: base components, labels, points, score."""
    r = rows
    return {
        f"base_{r}": f"""
            SELECT entity_id, narrative_id, count(*) AS volume, sum(coalesce(likes, 0) + shares + comments + views) AS engagement,
                   trim(min_by(entity, post_id)) AS entity, avg(coalesce(resolution_confidence, 0)) AS mean_confidence,
                   ln(1 + greatest(0, sum(coalesce(greatest(c_acctbal, 0), 0)))) AS influence
            FROM {r} LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = author_id GROUP BY ALL""",
        f"hits_{r}": _hits(r, "taxonomy"),
        f"labels_{r}": f"""
            SELECT b.entity_id, b.narrative_id, coalesce(l.labels, ['Operational Resilience']) AS labels
            FROM base_{r} b LEFT JOIN (
                SELECT entity_id, narrative_id, list(label ORDER BY hits DESC, label_pos)[1:3] AS labels
                FROM hits_{r} WHERE hits > 0 GROUP BY ALL) l
            ON b.entity_id = l.entity_id AND b.narrative_id IS NOT DISTINCT FROM l.narrative_id""",
        f"points_{r}": f"""
            SELECT entity_id, narrative_id, label, label_pos,
                   round(weight * CASE list_position(labels, label) WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.0 END, 2)
                   AS points
            FROM labels_{r} CROSS JOIN weights""",
        f"components_{r}": f"""
            SELECT entity_id, narrative_id, component, pos, points FROM (
                SELECT entity_id, narrative_id, 'Volume pressure' AS component, 0 AS pos, round(volume * 5.0::DOUBLE, 2) AS points FROM base_{r}
                UNION ALL SELECT entity_id, narrative_id, 'Engagement pressure', 1, round(engagement * 0.015, 2) FROM base_{r}
                UNION ALL SELECT entity_id, narrative_id, 'Author influence pressure', 2, round(least(20.0, influence * 2.5), 2) FROM base_{r}
                UNION ALL SELECT entity_id, narrative_id, 'Language signal: ' || label, 3 + label_pos, points FROM points_{r})""",
        f"narratives_{r}": f"""
            SELECT b.entity_id, b.narrative_id, b.entity, b.volume, CAST(round(b.engagement) AS BIGINT) AS engagement, l.labels,
                   round(least(100.0, greatest(0.0, c.total)), 1) AS score,
                   CASE WHEN 0.5 * mean_confidence + 0.5 * least(1.0, ln(1 + volume) / ln(13)) >= 0.75 THEN 'High'
                        WHEN 0.5 * mean_confidence + 0.5 * least(1.0, ln(1 + volume) / ln(13)) >= 0.5 THEN 'Medium' ELSE 'Low' END
                   AS risk_score_confidence,
                   b.entity || ': ' || l.labels[1] AS title
            FROM base_{r} b
            JOIN labels_{r} l ON b.entity_id = l.entity_id AND b.narrative_id IS NOT DISTINCT FROM l.narrative_id
            JOIN (SELECT entity_id, narrative_id, sum(points) AS total FROM components_{r} GROUP BY ALL) c
              ON b.entity_id = c.entity_id AND b.narrative_id IS NOT DISTINCT FROM c.narrative_id""",
        f"daily_{r}": f"""
            SELECT entity_id, narrative_id, CAST(created_at AS DATE) AS date, count(*) AS posts,
                   count(DISTINCT author_id) AS authors, sum(coalesce(likes, 0) + shares + comments + views) AS engagement,
                   avg(coalesce(resolution_confidence, 0.5)) AS confidence
            FROM {r} WHERE created_at IS NOT NULL GROUP BY ALL""",
        f"calendar_{r}": f"""
            SELECT entity_id, narrative_id, CAST(last - i AS DATE) AS date FROM (
                SELECT entity_id, narrative_id, max(date) AS last FROM daily_{r} GROUP BY entity_id, narrative_id
            ) CROSS JOIN (SELECT CAST(unnest(range(7)) AS INTEGER) AS i)""",
        f"series_{r}": f"""
            SELECT c.entity_id, c.narrative_id, c.date, coalesce(n.score * d.confidence, 0.0) AS risk,
                   coalesce(d.posts, 0) AS posts, coalesce(d.authors, 0) AS authors, coalesce(d.engagement, 0.0) AS engagement
            FROM calendar_{r} c JOIN narratives_{r} n USING (entity_id, narrative_id)
            LEFT JOIN daily_{r} d USING (entity_id, narrative_id, date)""",
        f"delta_{r}": f"""
            SELECT entity_id, narrative_id, round(sum(CASE WHEN date = last THEN risk WHEN date = last - 1 THEN -risk END), 1) AS risk_delta
            FROM (SELECT *, max(date) OVER (PARTITION BY entity_id, narrative_id) AS last FROM series_{r})
            GROUP BY entity_id, narrative_id""",
        f"trend_{r}": f"""
            SELECT entity_id, narrative_id, i AS point, CASE
                WHEN len(days) = 0 THEN i * greatest(1, total) / 11.0
                WHEN len(days) = 1 THEN days[1]
                ELSE round(days[low + 1] + (p - low) * (days[least(low + 1, len(days) - 1) + 1] - days[low + 1]), 2) END AS value
            FROM (SELECT *, i * (len(days) - 1) / 11.0 AS p, CAST(floor(i * (len(days) - 1) / 11.0) AS BIGINT) AS low FROM (
                SELECT t.entity_id, t.narrative_id, t.total, coalesce(d.days, []) AS days, unnest(range(12)) AS i
                FROM (SELECT entity_id, narrative_id, count(*) AS total FROM {r} GROUP BY ALL) t
                LEFT JOIN (SELECT entity_id, narrative_id, list(CAST(posts AS DOUBLE) ORDER BY date) AS days FROM daily_{r} GROUP BY ALL) d
                ON t.entity_id = d.entity_id AND t.narrative_id IS NOT DISTINCT FROM d.narrative_id))""",
    }


CTES.update(
    {
        "ids": """SELECT entity_id, row_number() OVER (ORDER BY min(post_id), entity_id) AS narrative_id
                  FROM expanded_kept GROUP BY entity_id""",
        "grouped": "SELECT * FROM expanded_kept JOIN ids USING (entity_id)",
        "small": "SELECT * REPLACE (0.0 AS views), CAST(author_id AS BIGINT) AS narrative_id FROM expanded_kept",
        "by_author": "SELECT *, coalesce(CAST(author_id AS BIGINT) % 20, -1) AS narrative_id FROM expanded_kept",
        "spanning": """SELECT * REPLACE ('all' AS entity_id), CAST(author_id AS BIGINT) % 10 AS narrative_id
                       FROM expanded_kept""",
        "risk_posts": _risk("expanded_posts"),
        "chars_posts": f"""
            SELECT *, CASE WHEN length(ctx) > 1200 THEN rtrim(substr(ctx, 1, 1197)) || '...' ELSE ctx END AS cluster_context
            FROM ({_context('expanded_posts', 1, 3)})""",
        "risk_rows": f"SELECT * FROM ({_risk('grouped')})",
        "items": """SELECT DISTINCT sha256(entity || chr(31) || risk_context) AS id, entity, risk_context AS context
                    FROM risk_rows""",
        "decisions": f"""
            SELECT id, hit AND NOT generic AS is_risk, CASE WHEN hit AND NOT generic THEN summary ELSE '' END AS summary
            FROM (SELECT *, lower(summary) AS low, low = '' OR starts_with(low, 'posts mentioning')
                         OR starts_with(low, 'this context indicates risk') OR starts_with(low, 'discussion focused on potential')
                         OR starts_with(low, 'this post indicates risk signals') AS generic
                  FROM (SELECT id, {_squash(_no_quotes(f"coalesce({_sentences('context')}[1], '')"))} AS summary,
                               EXISTS (SELECT 1 FROM taxonomy WHERE contains(lower(context), word)) AS hit FROM items))""",
        "routed": """SELECT r.*, d.is_risk, d.summary, CASE WHEN d.is_risk AND d.summary <> '' THEN 'accepted'
                     ELSE 'llm_marked_not_risk' END AS route
                     FROM (SELECT *, sha256(entity || chr(31) || risk_context) AS id FROM risk_rows) r JOIN decisions d USING (id)""",
        "supplied": """
            SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN []
                WHEN doc_id % 3 = 0 THEN ['Not A Label', ' ' || n[doc_id % 7 + 1], n[doc_id % 5 + 1]]
                ELSE [n[doc_id % 7 + 1], n[doc_id % 7 + 1], n[doc_id % 5 + 1], n[7]] END AS labels
            FROM labels CROSS JOIN (SELECT list(label ORDER BY label_pos) AS n FROM weights)""",
        "named": """SELECT 'c' || c_custkey AS entity_id, c_name AS canonical_name, c_custkey AS entity_pos, c_acctbal,
                           c_custkey AS k, c_mktsegment AS seg FROM customer""",
        "vecs": """SELECT CAST(vec_id AS VARCHAR) AS post_id, CAST(label AS VARCHAR) AS entity_id, vec_id % 5 AS cluster,
                          CAST(embedding AS DOUBLE[]) AS v FROM embeddings""",
        "unit_vecs": """SELECT post_id, entity_id, cluster, list_transform(v, lambda x: x / n) AS v FROM (
                            SELECT *, CASE WHEN sqrt(list_dot_product(v, v)) = 0 THEN 1.0 ELSE sqrt(list_dot_product(v, v)) END AS n FROM vecs)""",
        "cluster_dims": """SELECT entity_id, cluster, dim, count(*) AS n, avg(value) AS value FROM (
                               SELECT entity_id, cluster, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS value FROM unit_vecs) GROUP BY ALL""",
        "centroids": """SELECT entity_id, cluster, n, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (
                            SELECT entity_id, cluster, max(n) AS n, list(value ORDER BY dim) AS v FROM cluster_dims GROUP BY ALL)""",
        "followers_twice": """
            SELECT CAST(c_custkey AS VARCHAR) AS author_id, greatest(c_acctbal, 0) AS followers, c_custkey AS load_order FROM customer
            UNION ALL SELECT CAST(c_custkey AS VARCHAR), greatest(c_acctbal, 0) + 1, c_custkey + 1000000000
            FROM customer WHERE c_custkey % 2 = 0""",
    }
)
_FUZZY = """
    SELECT post_id, entity_id, win AS mention_text, round(least(0.85, greatest(0.75, ratio * 0.9)), 2) AS confidence
    FROM open_windows w JOIN fuzzy_ratios r ON r.b = w.win JOIN fuzzy_terms t ON t.term_norm = r.a AND t.width = w.width
    QUALIFY row_number() OVER (PARTITION BY post_id, entity_id ORDER BY ratio DESC, term_pos, start, win, canonical_name) = 1"""
# every tier, then the risk gate, then one narrative per entity
CTES["every_tier"] = f"""
    SELECT * FROM expanded_kept UNION ALL BY NAME
    SELECT p.*, f.entity_id, e.canonical_name AS entity, trim(f.mention_text) AS mention_text, f.confidence AS resolution_confidence
    FROM kept p JOIN ({_FUZZY}) f USING (post_id) JOIN entities e USING (entity_id)"""
CTES["gate"] = f"""
    SELECT * EXCLUDE (hit), {_squash(_no_quotes(f"coalesce({_sentences('risk_context')}[1], '')"))} AS said, lower(said) AS low,
           EXISTS (SELECT 1 FROM taxonomy WHERE contains(lower(risk_context), word)) AND low <> '' AND NOT (
               starts_with(low, 'posts mentioning') OR starts_with(low, 'this context indicates risk')
               OR starts_with(low, 'discussion focused on potential') OR starts_with(low, 'this post indicates risk signals')) AS accepted
    FROM ({_risk('every_tier')})"""
CTES["gated"] = """
    SELECT *, dense_rank() OVER (ORDER BY first, entity_id) AS narrative_id
    FROM (SELECT *, min(post_id) OVER (PARTITION BY entity_id) AS first FROM gate WHERE accepted)"""
for _rows in ["grouped", "small", "by_author", "gated"]:
    CTES.update(_scoring(_rows))


def _merging(rounds: int, threshold: float) -> dict[str, str]:
    """Merging rounds one after the other; an entity of m clusters is at rest after m - 1 of them."""
    steps = {"merged_0": "SELECT DISTINCT entity_id, cluster, cluster AS kept FROM vecs"}
    for r in range(rounds):
        steps[f"heads_{r}"] = f"""
            SELECT entity_id, kept, max(n) AS n, list(total ORDER BY dim) AS t, list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))) AS v
            FROM (SELECT entity_id, kept, dim, count(*) AS n, sum(value) AS total FROM (
                SELECT entity_id, kept, generate_subscripts(v, 1) AS dim, unnest(v) AS value
                FROM unit_vecs JOIN merged_{r} USING (entity_id, cluster)) GROUP BY ALL) GROUP BY ALL"""
        steps[f"closest_{r}"] = f"""
            SELECT a.entity_id, a.kept, b.kept AS other, a.n, b.n AS other_n, list_dot_product(a.v, b.v) AS s
            FROM heads_{r} a JOIN heads_{r} b ON a.entity_id = b.entity_id AND a.kept <> b.kept
            QUALIFY row_number() OVER (PARTITION BY a.entity_id, a.kept ORDER BY s DESC, b.kept) = 1"""
        steps[f"joined_{r}"] = f"""
            SELECT a.entity_id, a.other AS kept, a.kept AS target FROM closest_{r} a JOIN closest_{r} b
            ON a.entity_id = b.entity_id AND a.other = b.kept AND b.other = a.kept
            WHERE a.kept < a.other AND a.s >= {threshold} + CASE WHEN a.n >= 20 AND a.other_n >= 20 THEN 0.03 ELSE 0 END"""
        steps[f"merged_{r + 1}"] = f"""
            SELECT entity_id, cluster, coalesce(target, kept) AS kept FROM merged_{r} LEFT JOIN joined_{r} USING (entity_id, kept)"""
    return steps


CTES.update(_merging(4, 0.1))
CTES["start_vecs"] = """
    SELECT entity_id, v, row_number() OVER (PARTITION BY entity_id ORDER BY CAST(post_id AS BIGINT)) - 1 AS cluster
    FROM (SELECT entity_id, post_id, v FROM unit_vecs) QUALIFY cluster < 5"""
CTES["start_near"] = """
    SELECT u.entity_id, u.post_id, any_value(u.v) AS v, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS d
    FROM (SELECT u.*, c.cluster, list_sum(list_transform(list_zip(u.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
          FROM (SELECT entity_id, post_id, v FROM unit_vecs) u JOIN start_vecs c USING (entity_id)) u
    JOIN start_vecs c USING (entity_id, cluster) GROUP BY u.entity_id, u.post_id"""


def _needed(sql: str, found: list[str], within: str = "") -> None:
    for name in CTES:
        if name not in found and name != within and re.search(rf"\b{name}\b", sql):
            _needed(CTES[name], found, name)
            if name not in found:
                found.append(name)


def _sql(body: str) -> str:
    found: list[str] = []
    _needed(body, found)
    if not found:
        return body
    recursive = "RECURSIVE " if "fuzzy_blocks" in found else ""
    return f"WITH {recursive}" + ",\n".join(f"{name} AS ({CTES[name]})" for name in found) + "\n" + body


_MATCH = "entity_id, mention_text, confidence, method"
_RANKED = """SELECT row_number() OVER (ORDER BY score DESC, entity_id, narrative_id) AS rank, *
             FROM narratives_grouped"""
_DRIVERS = f"""SELECT narrative_id, string_agg({_display('component')}, '|' ORDER BY abs(points) DESC, pos) AS drivers
               FROM components_grouped"""
_DEFAULTED = """CASE WHEN len(list_filter(list_transform(labels, lambda l: trim(l)), lambda l: l <> '')) > 0
                THEN list_filter(list_transform(labels, lambda l: trim(l)), lambda l: l <> '')
                ELSE ['Operational Resilience'] END"""
_QUOTE_WORDS = " with more words than a single chunk can hold so that it is cut in two parts"


def _quotes(source: str) -> str:
    """First three distinct quotes of (narrative_id, s, post_id) rows."""
    return f"""
        SELECT * FROM (WITH q AS (
            SELECT narrative_id, {_compact('s', 120)} AS quote, 0 AS stage, post_id, 0 AS chunk FROM {source}
            UNION ALL
            SELECT narrative_id, {_compact('c', 120)}, 1, post_id, i FROM (
                SELECT narrative_id, post_id, unnest(range(0, len(w), 18)) AS i,
                       array_to_string(list_slice(w, i + 1, i + 18), ' ') AS c
                FROM (SELECT narrative_id, post_id, string_split(s, ' ') AS w FROM {source}))
        ), d AS (
            SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY narrative_id, lower(quote) ORDER BY stage, post_id, chunk) = 1
        )
        SELECT narrative_id, row_number() OVER (PARTITION BY narrative_id ORDER BY stage, post_id, chunk) AS position, quote
        FROM d QUALIFY position <= 3)"""


def _bins(values: str) -> str:
    return f"""SELECT CAST(greatest(1, ceil(round(least(1, greatest(0, coalesce(c, 0))) * 20, 9))) AS BIGINT) AS bin, count(*) AS n
               FROM ({values}) GROUP BY ALL"""


BODIES: dict[str, str] = {
    # sources and sinks
    "read_posts_json": """SELECT post_id, length(text) AS text_length, platform, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
        author_id, round(likes, 4) AS likes, shares, comments, views FROM posts""",
    "read_authors_csv": "SELECT CAST(c_custkey AS VARCHAR) AS author_id, round(greatest(c_acctbal, 0), 4) AS followers FROM customer",
    "read_entities_csv": """SELECT 'c' || c_custkey AS entity_id, c_name AS canonical_name,
        c_mktsegment || ' ' || c_custkey || '||c' || c_custkey || '|C-' || c_custkey AS aliases FROM customer""",
    "write_resolved_posts": "SELECT post_id, resolution_method, matches, first_mention FROM resolved_kept",
    "write_clustered_posts": 'SELECT narrative_id, count(*) AS "rows", false AS has_embedding FROM grouped GROUP BY ALL',
    "write_rejected_posts": "SELECT CAST(post_id AS VARCHAR) AS post_id, reason AS drop_reason FROM evaluated WHERE reason IS NOT NULL",
    "write_narrative_summary": """SELECT narrative_id, title, score, risk_score_confidence, volume,
        array_to_string(labels, '|') AS taxonomy_labels FROM narratives_grouped""",
    "load_stored_artifacts": """SELECT post_id, r.entity_id, r.narrative_id, array_to_string(n.labels, '|') AS labels
        FROM grouped r JOIN narratives_grouped n USING (narrative_id)""",
    "append_feedback_rows": """SELECT doc_id % 50 AS narrative_id, CAST(1 + doc_id % 5 AS INTEGER) AS rating, count(*) AS "rows"
        FROM labels GROUP BY ALL""",
    "artifact_files": "SELECT 'resolved_posts' AS folder, true AS filled, count(*) AS \"rows\" FROM kept",
    "append_override_rows": """SELECT narrative_id, arg_max(score, moment) AS score, arg_max(reasoning, moment) AS reasoning, count(*) AS "rows"
        FROM (SELECT user_id % 50 AS narrative_id, least(100.0, value) AS score, 'event ' || event_id AS reasoning, (ts, event_id) AS moment
              FROM events WHERE event_type = 'error') GROUP BY narrative_id""",
    "append_mark_rows": """SELECT user_id % 50 AS narrative_id,
        CASE user_id % 4 WHEN 0 THEN 'Tiontion' WHEN 1 THEN 'None' ELSE '' END AS entity, count(*) AS "rows", max(ts) AS newest
        FROM events WHERE event_type = 'purchase' GROUP BY ALL""",
    "tolerant_read": 'SELECT CAST(1 + doc_id % 5 AS INTEGER) AS rating, count(*) AS "rows" FROM labels GROUP BY ALL',
    # projections, filters, predicates
    "signal_texts": """SELECT CAST(doc_id AS VARCHAR) AS post_id, CASE WHEN doc_id % 3 = 0 THEN 'altered: ' || text ELSE text END
        AS signal_text FROM documents""",
    "word_counts": "SELECT post_id, words FROM evaluated",
    "sentiment_compound": "SELECT post_id, round(compound, 9) AS compound FROM evaluated",
    "prefilter_reasons": "SELECT post_id, coalesce(reason, 'kept') AS reason FROM evaluated",
    "kept_posts": "SELECT post_id, text, platform, author_id FROM kept",
    "dropped_posts": "SELECT post_id, words, reason, round(compound, 9) AS compound FROM evaluated WHERE reason IS NOT NULL",
    "numeric_coercion": """SELECT event_id, coalesce(TRY_CAST(m AS DOUBLE), 0.0) AS zero_default, coalesce(TRY_CAST(m AS DOUBLE), 0.5) AS half_default
        FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props ->> '$.k' WHEN 1 THEN event_type END AS m FROM events)""",
    "engagement_per_post": """SELECT post_id, round(coalesce(likes, 0) + shares + comments + views, 4) AS engagement,
        shares + comments AS without_likes_views FROM posts""",
    "text_forms": f"""SELECT post_id, lower({_squash('text')}) AS normalized, {_compact('text', 180)} AS compacted,
        trim({_no_quotes(_squash('text'))}) AS unquoted,
        CASE WHEN length(trim({_no_quotes(_squash('text'))})) > 1200 THEN rtrim(substr(trim({_no_quotes(_squash('text'))}), 1, 1197)) || '...'
             ELSE trim({_no_quotes(_squash('text'))}) END AS bounded FROM posts""",
    "quality_predicates": f"""SELECT post_id, regexp_matches(text, '["''“”‘’]') AS has_quotes,
        coalesce(title = '' OR regexp_matches(lower(title), '^([\\p{{L}}\\p{{N}}_]+ )?narrative$'), true) AS generic_title,
        coalesce(summary = '' OR starts_with(lower(summary), 'posts mentioning') OR starts_with(lower(summary), 'this context indicates risk')
            OR starts_with(lower(summary), 'discussion focused on potential') OR starts_with(lower(summary), 'this post indicates risk signals'), true)
            AS generic_summary
        FROM (SELECT post_id, text, {_squash("CASE WHEN CAST(post_id AS BIGINT) % 2 = 0 THEN head || ' Narrative' ELSE first END")} AS title,
                     {_squash("CASE WHEN CAST(post_id AS BIGINT) % 5 = 0 THEN ' Posts  mentioning ' || head ELSE first END")} AS summary
              FROM (SELECT *, string_split({_squash('text')}, ' ')[1] AS head, {_sentences('text')}[1] AS first FROM posts))""",
    "first_existing_columns": """SELECT post_id, strftime(created_at, '%Y-%m-%d %H:%M') AS time, author_id AS author,
        'posted_at' AS time_column FROM posts""",
    "entity_filter": "SELECT post_id, entity, resolution_confidence FROM expanded_kept WHERE entity = 'Tiontion'",
    "entity_option_list": "SELECT 'All' AS option UNION ALL SELECT c_name FROM customer WHERE c_name IS NOT NULL",
    "narrative_lookup": "SELECT narrative_id, entity_id, volume, score FROM narratives_grouped WHERE narrative_id = 3",
    "valid_selection": """SELECT DISTINCT doc_id % 50 AS narrative_id FROM labels
        WHERE doc_id % 50 IN (SELECT narrative_id FROM narratives_grouped)""",
    "score_bands": """SELECT post_id, CASE WHEN s >= 70 THEN 'High' WHEN s >= 40 THEN 'Medium' ELSE 'Low' END AS band,
        CASE WHEN s >= 80 THEN 'high' WHEN s >= 60 THEN 'elevated' WHEN s >= 40 THEN 'moderate' ELSE 'emerging' END AS severity,
        CASE WHEN s / 100 >= 0.7 THEN 'High' WHEN s / 100 >= 0.4 THEN 'Medium' ELSE 'Low' END AS match,
        CASE WHEN CAST(post_id AS BIGINT) % 2 = 1 THEN 'Medium' WHEN round(s, 1) >= 70 THEN 'High' WHEN round(s, 1) >= 40 THEN 'Medium' ELSE 'Low' END
            AS effective
        FROM (SELECT post_id, least(100.0, round(likes * 4, 1)) AS s FROM posts)""",
    # text context
    "sentence_split": f"""SELECT post_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS sentence
        FROM (SELECT post_id, {_sentences('text')} AS l FROM posts)""",
    "risk_contexts": "SELECT post_id, entity_id, mention_text, risk_context FROM risk_posts",
    "cluster_contexts": "SELECT post_id, entity_id, cluster_context FROM chars_posts",
    # HAVING on the alias would make GROUP BY ALL group by the whole context too
    "narrative_snippets": f"""SELECT narrative_id, snippet, min(post_id) AS first_post
        FROM (SELECT narrative_id, post_id, {_compact('risk_context', 260)} AS snippet FROM risk_rows)
        WHERE snippet <> '' GROUP BY narrative_id, snippet""",
    "narrative_quotes": _quotes(f"(SELECT narrative_id, {_squash('risk_context')} AS s, post_id FROM risk_rows)"),
    "narrative_quotes_from_copies": _quotes(
        f"""(SELECT narrative_id, 'one shared context of platform ' || platform || '{_QUOTE_WORDS}' AS s, post_id FROM posts
             JOIN (SELECT platform, row_number() OVER (ORDER BY min(post_id), platform) AS narrative_id FROM posts GROUP BY platform) USING (platform))"""
    ),
    "narrative_descriptions": """SELECT narrative_id, CASE WHEN narrative_id % 2 = 0 THEN 'A stored summarys text' ELSE
        'Across ' || volume || ' matched posts, this ' || entity || '-linked narrative shows ' ||
        CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'elevated' WHEN score >= 40 THEN 'moderate' ELSE 'emerging' END ||
        ' risk centered on ' || n.labels[1] || coalesce(' with overlap into ' || n.labels[2], '') ||
        '. The common pattern suggests ' || coalesce(effect, 'reputational and operational pressure.') END AS description
        FROM narratives_grouped n LEFT JOIN impact ON label = n.labels[1]""",
    # entity resolution
    "alias_dictionary": f"""SELECT entity_id, CAST(tier AS BIGINT) AS tier, CAST(alias_pos AS BIGINT) AS alias_pos, term, lower({_squash('term')}) AS term_norm FROM (
        SELECT entity_id, 1 AS tier, 0 AS alias_pos, canonical_name AS term FROM named
        UNION ALL SELECT entity_id, 1, 1, entity_id FROM named
        UNION ALL SELECT entity_id, 2, 0, seg || ' ' || k FROM named
        UNION ALL SELECT entity_id, 2, 1, 'c' || k FROM named
        UNION ALL SELECT entity_id, 2, 2, 'C-' || k FROM named
        UNION ALL SELECT entity_id, 3, 0, '$C' || k FROM named)""",
    "alias_search_lists": """SELECT entity_id, string_agg(term, '|' ORDER BY term) AS search_list FROM (
        SELECT entity_id, seg || ' ' || k AS term FROM named UNION SELECT entity_id, 'c' || k FROM named
        UNION SELECT entity_id, 'C-' || k FROM named UNION SELECT entity_id, '$C' || k FROM named) GROUP BY ALL""",
    "large_dictionary_tier": f"SELECT post_id, {_MATCH} FROM matches_posts",
    "entity_mentions": "SELECT post_id, spot AS position, entity_id, mention_text, confidence FROM matches_posts",
    "resolved_posts": "SELECT post_id, matches, resolution_method, entity, resolution_confidence FROM resolved_posts",
    "expanded_posts": "SELECT post_id, entity_id, entity, mention_text, resolution_confidence FROM expanded_posts",
    "entity_name_lookup": """SELECT CAST(o_orderkey AS VARCHAR) AS post_id, e AS entity_id,
        coalesce(c_name || CASE WHEN c_custkey % 3 = 0 THEN ' v2' ELSE '' END, 'kept label') AS entity
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'c' || o_custkey END AS e FROM orders)
        LEFT JOIN customer ON 'c' || c_custkey = e""",
    # risk gate
    "risk_context_rows": """SELECT post_id, entity_id, entity AS entity_label, risk_context,
        sha256(entity || chr(31) || risk_context) AS item_id FROM risk_rows""",
    "risk_work_items": "SELECT id, entity, context FROM items",
    "work_item_batches": "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 2 AS batch FROM items",
    "keyword_risk_decisions": "SELECT id, is_risk, summary FROM decisions",
    "decision_payloads": """SELECT doc_id, CASE WHEN ok THEN CAST(doc_id AS VARCHAR) END AS id, CASE WHEN ok THEN toxic = 1 END AS is_risk,
        CASE WHEN ok THEN CASE WHEN toxic = 1 THEN 'Its a claim ' || doc_id ELSE '' END END AS summary,
        CASE doc_id % 7 WHEN 3 THEN 'invalid_schema' WHEN 4 THEN 'empty_payload' ELSE 'ok' END AS reason
        FROM (SELECT *, doc_id % 7 NOT IN (3, 4) AS ok FROM labels)""",
    "decision_violations": f"""
        SELECT * FROM (WITH label_rows AS (SELECT sha256(entity || chr(31) || risk_context) AS id, toxic, {_sentences('risk_context')}[1] AS first
                            FROM risk_rows JOIN labels ON CAST(doc_id AS VARCHAR) = post_id),
        d AS (SELECT id, bool_or(toxic = 1) AS is_risk, CASE WHEN bool_or(toxic = 1) THEN {_squash(_no_quotes('min(first)'))} ELSE '' END AS summary
              FROM label_rows GROUP BY id),
        s AS (SELECT 'stray-' || (doc_id % 10) AS id, count(*) AS n, bool_or(toxic = 1) AS risky, bool_or(toxic <> 1) AS calm FROM labels GROUP BY ALL)
        SELECT id, 'missing_id' AS reason FROM items WHERE id NOT IN (SELECT id FROM d)
        UNION ALL SELECT id, 'generic_summary' FROM d WHERE is_risk AND coalesce(summary, '') = ''
        UNION ALL SELECT id, 'unexpected_id' FROM s
        UNION ALL SELECT id, 'duplicate_id' FROM s WHERE n > 1
        UNION ALL SELECT id, 'generic_summary' FROM s WHERE risky
        UNION ALL SELECT id, 'summary_without_risk' FROM s WHERE calm)""",
    "routed_rows": """SELECT post_id, entity_id, route, coalesce(summary, '') AS risk_summary FROM routed""",
    "summary_embeddings": """SELECT summary AS risk_summary, count(*) AS "rows", 1 AS vectors, 1.0::DOUBLE AS norm FROM routed
        WHERE route = 'accepted' GROUP BY ALL""",
    "missing_summary_embeddings": """SELECT DISTINCT summary AS risk_summary FROM routed
        WHERE route = 'accepted' AND length(summary) % 2 = 0""",
    # clustering
    "cluster_sizes": """SELECT CAST(label AS VARCHAR) AS entity_id, count(*) AS n, CAST(CASE WHEN count(*) <= 3 THEN 1
        ELSE least(40, greatest(2, floor(pow(count(*), 0.6))), count(*)) END AS BIGINT) AS k FROM embeddings GROUP BY ALL""",
    "normalized_vectors": """SELECT post_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 6) + 0.0 AS value FROM unit_vecs""",
    "grouped_clusters": """SELECT CAST(label AS VARCHAR) AS entity_id, count(*) AS points, true AS at_most_k, true AS more_than_one,
        true AS cost_not_above_first FROM embeddings GROUP BY ALL""",
    "lloyd_round": """
        SELECT entity_id, cluster, count(*) AS n, round(any_value(cost), 6) AS cost, dim, round(avg(value), 6) + 0.0 AS value FROM (
            SELECT entity_id, cluster, sum(d) OVER (PARTITION BY entity_id) AS cost, v FROM start_near), LATERAL (
            SELECT generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS value) GROUP BY entity_id, cluster, dim""",
    "cluster_fill": """SELECT CAST(label AS VARCHAR) AS entity_id, CAST(CASE WHEN count(*) <= 3 THEN 1
        ELSE least(40, greatest(2, floor(pow(count(*), 0.6))), count(*)) END AS BIGINT) AS clusters, count(*) AS points
        FROM embeddings GROUP BY ALL""",
    "merge_pairs": "SELECT entity_id, kept AS cluster, target FROM joined_0",
    "merge_fixpoint": "SELECT entity_id, cluster, kept FROM merged_4",
    "cluster_centroids": """SELECT entity_id, cluster, n, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 6) + 0.0 AS value FROM centroids""",
    "nearest_cluster_pairs": """SELECT a.entity_id, a.cluster, b.cluster AS nearest, round(list_dot_product(a.v, b.v), 6) AS similarity
        FROM centroids a JOIN centroids b ON a.entity_id = b.entity_id AND a.cluster <> b.cluster
        QUALIFY row_number() OVER (PARTITION BY a.entity_id, a.cluster ORDER BY list_dot_product(a.v, b.v) DESC, b.cluster) = 1""",
    "merged_clusters": """SELECT entity_id, count(DISTINCT cluster) AS clusters, true AS kept_is_lowest, min(cluster) AS lowest
        FROM vecs GROUP BY ALL""",
    "contiguous_labels": """SELECT entity_id, cluster, dense_rank() OVER (PARTITION BY entity_id ORDER BY cluster) - 1 AS local_id
        FROM (SELECT DISTINCT entity_id, cluster + CAST(cluster >= 2 AS INT) AS cluster FROM vecs)""",
    "global_narrative_ids": """SELECT post_id, entity_id, dense_rank() OVER (ORDER BY first, entity_id, cluster) AS narrative_id
        FROM (SELECT *, min(post_id) OVER (PARTITION BY entity_id) AS first FROM vecs)""",
    "single_narrative_rows": "SELECT post_id, entity_id, narrative_id FROM grouped",
    "embedding_modes": "SELECT entity_id, bool_and(CAST(post_id AS BIGINT) % 97 <> 5) AS supplied FROM vecs GROUP BY ALL",
    "clustered_vectors": """SELECT entity_id, count(*) AS "rows", true AS one_entity_each FROM vecs GROUP BY ALL""",
    "clustered_texts": """SELECT entity_id, count(*) AS "rows" FROM expanded_kept GROUP BY ALL""",
    # scoring
    "narrative_totals": """SELECT entity_id, narrative_id, volume, round(engagement, 4) AS engagement, entity,
        round(mean_confidence, 9) AS mean_confidence FROM base_grouped""",
    "row_followers": """SELECT post_id, round(coalesce(greatest(c_acctbal, 0), 0), 4) AS followers FROM posts
        LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = author_id""",
    "narrative_influence": "SELECT narrative_id, round(influence, 9) AS influence FROM base_grouped",
    "base_score_components": """SELECT narrative_id, round(volume * 5.0::DOUBLE, 2) AS volume_pressure, round(engagement * 0.015, 2) AS engagement_pressure,
        round(least(20.0, influence * 2.5), 2) AS influence_pressure FROM base_grouped""",
    "match_confidence_labels": "SELECT entity_id, narrative_id, risk_score_confidence AS label FROM narratives_small",
    "taxonomy_keyword_hits": """SELECT h.narrative_id, h.label, h.hits,
        round(weight * least(1.0, ln(1 + h.hits) / ln(1 + greatest(3, 2 * volume))), 2) AS contribution
        FROM hits_grouped h JOIN base_grouped USING (narrative_id) JOIN weights ON weights.label = h.label""",
    "taxonomy_top_labels": """SELECT b.narrative_id, coalesce(l.v, '') AS "labels" FROM base_grouped b LEFT JOIN (
        SELECT narrative_id, array_to_string(list(label ORDER BY hits DESC, label_pos)[1:3], '|') AS v FROM hits_grouped WHERE hits > 0 GROUP BY ALL) l
        USING (narrative_id)""",
    "label_list_validation": """SELECT doc_id, array_to_string(v, '|') AS valid, len(v) = 0 AS rejected FROM (
        SELECT doc_id, list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 3) AS v FROM (
            SELECT doc_id, list_filter(list_transform(supplied.labels, lambda x: trim(x)), lambda x: list_contains(allowed, x)) AS l
            FROM supplied CROSS JOIN (SELECT list(label) AS allowed FROM weights)))""",
    "label_rank_points": """SELECT doc_id, label, round(weight * CASE list_position(list_transform(list_slice(s.labels, 1, 3), lambda x: trim(x)), label)
        WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.0 END, 2) AS points FROM supplied s CROSS JOIN weights""",
    "narrative_labels": """SELECT n.narrative_id, array_to_string(CASE WHEN len(s.labels) > 0
        THEN list_slice(list_transform(s.labels, lambda x: trim(x)), 1, 3) ELSE n.labels END, '|') AS labels
        FROM narratives_grouped n LEFT JOIN supplied s ON s.doc_id = n.narrative_id""",
    "score_component_map": "SELECT narrative_id, component, points FROM components_grouped",
    "narrative_scores": """SELECT narrative_id, entity_id, entity, volume, engagement, score, risk_score_confidence,
        array_to_string(labels, '|') AS taxonomy_labels FROM narratives_grouped""",
    "author_narrative_scores": """SELECT entity_id, narrative_id, volume, score, risk_score_confidence,
        array_to_string(labels, '|') AS taxonomy_labels FROM narratives_small""",
    "narrative_trends": "SELECT narrative_id, point, round(value, 6) AS value FROM trend_grouped",
    "author_trends": "SELECT entity_id, narrative_id, point, round(value, 6) AS value FROM trend_by_author",
    "narrative_titles": """SELECT narrative_id, CASE WHEN narrative_id % 3 = 0 THEN 'Its a seeded title' ELSE title END AS title,
        CASE WHEN narrative_id % 3 = 0 THEN 'Stored text' ELSE 'No narrative summary available.' END AS summary FROM narratives_grouped""",
    "produced_metadata_check": f"""SELECT post_id, coalesce(t <> '' AND s <> '' AND NOT regexp_matches(lower(t), '^([\\p{{L}}\\p{{N}}_]+ )?narrative$'), false) AS valid
        FROM (SELECT post_id, trim({_no_quotes(_squash("CASE WHEN CAST(post_id AS BIGINT) % 4 = 0 THEN 'Brand  narrative' ELSE l[1] END"))}) AS t,
                     trim({_no_quotes(_squash("CASE WHEN CAST(post_id AS BIGINT) % 6 = 1 THEN ' \" ' ELSE l[2] END"))}) AS s
              FROM (SELECT post_id, {_sentences('text')} AS l FROM posts))""",
    "narrative_entity_names": """SELECT narrative_id, string_agg(DISTINCT trim(entity), ', ' ORDER BY trim(entity)) AS entity_names FROM spanning GROUP BY ALL""",
    "narrative_post_ids": "SELECT narrative_id, post_id FROM grouped",
    "ranked_narratives": f"SELECT rank, narrative_id, entity_id, entity, title, score, volume, engagement FROM ({_RANKED})",
    "attached_metadata": """SELECT post_id, r.entity_id, coalesce(n.title, '') AS narrative_title,
        CASE WHEN n.title IS NULL THEN '' ELSE 'No narrative summary available.' END AS narrative_summary
        FROM grouped r LEFT JOIN (SELECT * FROM narratives_grouped WHERE narrative_id % 2 = 1) n USING (narrative_id)""",
    "build_stage_counts": """SELECT 'input_posts' AS stage, count(*) AS "rows" FROM posts
        UNION ALL SELECT 'kept_posts', count(*) FROM kept UNION ALL SELECT 'dropped_posts', count(*) FROM evaluated WHERE reason IS NOT NULL
        UNION ALL SELECT 'entity_rows_after_resolution', count(*) FROM routed
        UNION ALL SELECT 'entity_rows_risk_relevant', count(*) FROM routed WHERE route = 'accepted'
        UNION ALL SELECT 'entity_rows_dropped_no_risk', count(*) FROM routed WHERE route <> 'accepted'""",
    # dashboard
    "followers_enrichment": """SELECT post_id, round(CASE WHEN CAST(post_id AS BIGINT) % 4 = 0 THEN views ELSE coalesce(f, 0) END, 4) AS followers
        FROM posts LEFT JOIN (SELECT author_id, max_by(followers, load_order) AS f FROM followers_twice GROUP BY ALL) USING (author_id)""",
    "total_matched_posts": "SELECT CAST(sum(volume) AS BIGINT) AS total_posts FROM narratives_grouped",
    "posts_per_day": "SELECT CAST(created_at AS DATE) AS date, count(*) AS posts FROM posts WHERE created_at IS NOT NULL GROUP BY ALL",
    "posts_trend_line": """SELECT round(regr_slope(n, d), 6) AS slope, round(regr_intercept(n, d), 3) AS intercept FROM (
        SELECT CAST(CAST(created_at AS DATE) - DATE '1970-01-01' AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS n FROM posts WHERE created_at IS NOT NULL GROUP BY ALL)""",
    "narratives_per_type": """SELECT type, count(DISTINCT narrative_id) AS count, coalesce(max(acronym), 'Other') AS acronym
        FROM (SELECT narrative_id, unnest(labels) AS type FROM narratives_grouped) LEFT JOIN acronyms USING (type) GROUP BY ALL""",
    "label_lists_per_type": f"""SELECT type, count(DISTINCT narrative_id) AS count, coalesce(max(acronym), 'Other') AS acronym
        FROM (SELECT doc_id % 50 AS narrative_id, unnest({_DEFAULTED.replace('labels', 'supplied.labels')}) AS type FROM supplied)
        LEFT JOIN acronyms USING (type) GROUP BY ALL""",
    "match_confidence_histogram": f"""SELECT b.bin, round((b.bin - 1) / 20.0, 4) AS low, round(b.bin / 20.0, 4) AS high, coalesce(n, 0) AS frequency
        FROM (SELECT unnest(range(1, 21)) AS bin) b LEFT JOIN ({_bins('SELECT resolution_confidence AS c FROM expanded_kept')}) h USING (bin)""",
    "event_value_histogram": f"""SELECT b.bin, coalesce(n, 0) AS frequency FROM (SELECT unnest(range(1, 21)) AS bin) b
        LEFT JOIN ({_bins('SELECT CASE WHEN event_id % 13 <> 0 THEN value / 40 END AS c FROM events')}) h USING (bin)""",
    "median_match_confidence": "SELECT median(resolution_confidence) AS median_confidence FROM expanded_kept",
    "daily_total_risk": """SELECT date, round(sum(score * posts), 4) AS total_risk FROM daily_grouped JOIN narratives_grouped USING (entity_id, narrative_id) GROUP BY ALL""",
    "daily_risk_trend_line": """SELECT round(regr_slope(r, d), 4) AS slope, round(regr_intercept(r, d), 1) AS intercept FROM (
        SELECT CAST(date - DATE '1970-01-01' AS DOUBLE) AS d, sum(score * posts) AS r FROM daily_grouped JOIN narratives_grouped USING (entity_id, narrative_id) GROUP BY ALL)""",
    "narrative_overview_table": f"""SELECT rank, n.narrative_id, title AS description, m.name AS entity, volume, coalesce(d.drivers, '') AS drivers,
        risk_score_confidence AS confidence, coalesce(x.risk_delta, 0.0) AS risk_delta, score
        FROM ({_RANKED}) n LEFT JOIN ({_DRIVERS} WHERE abs(points) >= 15 GROUP BY ALL) d USING (narrative_id)
        LEFT JOIN delta_grouped x USING (narrative_id)
        LEFT JOIN (SELECT narrative_id, e AS name FROM (SELECT narrative_id, entity AS e, count(*) AS c FROM grouped GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY narrative_id ORDER BY c DESC, e) = 1) m USING (narrative_id)""",
    "majority_entities": """SELECT narrative_id, entity AS majority_entity FROM (SELECT narrative_id, entity, count(*) AS n FROM spanning GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY narrative_id ORDER BY n DESC, entity) = 1""",
    "risk_driver_lists": f"""SELECT n.narrative_id, coalesce(drivers, '') AS drivers FROM narratives_grouped n
        LEFT JOIN ({_DRIVERS} WHERE abs(points) >= 9 GROUP BY ALL) USING (narrative_id)""",
    "narrative_header_facts": """SELECT narrative_id, coalesce(strftime(min(created_at), '%Y-%m-%d %H:%M'), '-') AS first_seen, count(*) AS posts,
        round(sum(coalesce(likes, 0) + shares + comments + views), 4) AS engagement, count(DISTINCT author_id) AS authors,
        string_agg(DISTINCT platform, '|' ORDER BY platform) AS platforms FROM grouped GROUP BY ALL""",
    "daily_risk_delta": "SELECT narrative_id, risk_delta FROM delta_grouped",
    "narrative_risk_series": "SELECT narrative_id, date, round(risk, 6) AS risk FROM series_grouped",
    "risk_series_trend_lines": """SELECT narrative_id, round(regr_slope(risk, CAST(date - DATE '1970-01-01' AS DOUBLE)), 4) AS slope
        FROM series_grouped GROUP BY ALL""",
    "narrative_activity_series": "SELECT narrative_id, date, posts, authors, round(engagement, 4) AS engagement FROM series_grouped",
    "component_strengths": f"""SELECT narrative_id, {_display('component')} AS feature, points AS contribution, abs(points) AS abs_contribution,
        round(abs(points) / greatest(1.0, max(abs(points)) OVER (PARTITION BY narrative_id)), 9) AS strength FROM components_grouped""",
    "types_and_drivers": f"""SELECT n.narrative_id, array_to_string(n.labels, '|') AS risk_types, drivers FROM narratives_grouped n JOIN (
        {_DRIVERS.replace('components_grouped', '(SELECT * FROM components_grouped QUALIFY row_number() OVER (PARTITION BY narrative_id ORDER BY abs(points) DESC, pos) <= 3)')}
        GROUP BY ALL) USING (narrative_id)""",
    "matched_post_table": """SELECT narrative_id, post_id, coalesce(strftime(created_at, '%Y-%m-%d %H:%M'), '-') AS created, platform,
        length(text) AS text_length, round(coalesce(greatest(c_acctbal, 0), 0), 4) AS followers,
        round(coalesce(likes, 0) + shares + comments + views, 4) AS engagement, resolution_confidence AS match_confidence
        FROM grouped LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = author_id""",
    "post_inspection": "SELECT post_id, coalesce(author_id, '-') AS author, '-' AS url FROM posts",
    "keyword_types_head": "SELECT narrative_id, type FROM ("
    + _classified("(SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY narrative_id ORDER BY post_id) <= 20)", "overview_words") + ")",
    "keyword_types_all": "SELECT narrative_id, type FROM (" + _classified("grouped", "detail_words") + ")",
    "author_keyword_types": _classified("small", "detail_words"),
    "entity_overview_facts": """SELECT count(*) AS matched_posts, round(coalesce(avg(resolution_confidence), 0), 2) AS avg_confidence FROM expanded_kept""",
    # report
    "stage_funnel": """SELECT 'Raw posts' AS stage, count(*) AS "rows" FROM posts UNION ALL SELECT 'Resolved rows', count(*) FROM kept
        UNION ALL SELECT 'Dropped posts', count(*) FROM evaluated WHERE reason IS NOT NULL
        UNION ALL SELECT 'Dropped entity rows', count(*) FROM routed WHERE route <> 'accepted'
        UNION ALL SELECT 'Clustered rows', count(*) FROM routed WHERE route = 'accepted'
        UNION ALL SELECT 'Narratives', count(DISTINCT entity_id) FROM routed WHERE route = 'accepted'""",
    "resolution_method_mix": "SELECT resolution_method AS method, count(*) AS count FROM resolved_posts GROUP BY ALL",
    "resolution_confidence_bins": """SELECT CAST(least(24, floor(round((c - low) / ((high - low) / 25), 9))) AS BIGINT) AS bin, count(*) AS count
        FROM (SELECT resolution_confidence AS c, min(c) OVER () AS low, max(c) OVER () AS high FROM resolved_posts) GROUP BY ALL""",
    "narrative_size_distribution": """SELECT n AS "rows", count(*) AS narratives FROM (SELECT count(*) AS n FROM grouped GROUP BY narrative_id) GROUP BY ALL""",
    "score_distribution": "SELECT CAST(least(19, floor(score * 20 / 100.0)) AS BIGINT) AS bin, count(*) AS count FROM narratives_small GROUP BY ALL",
    "confidence_label_counts": "SELECT risk_score_confidence AS confidence, count(*) AS count FROM narratives_grouped GROUP BY ALL",
    "taxonomy_label_counts": """SELECT label, count(*) AS count FROM (SELECT CASE WHEN doc_id % 9 = 4 THEN 'One plain label' ELSE l END AS label FROM (
        SELECT doc_id, unnest(CASE WHEN doc_id % 9 = 4 THEN ['x'] ELSE supplied.labels END) AS l FROM supplied)) GROUP BY ALL""",
    # overlays and feedback
    "analyst_overrides": """SELECT n.narrative_id, coalesce(o.score, n.score) AS score,
        CASE WHEN o.score IS NULL THEN n.risk_score_confidence ELSE 'High' END AS risk_score_confidence, coalesce(o.reasoning, '') AS reasoning
        FROM narratives_grouped n LEFT JOIN (
            SELECT user_id % 50 AS narrative_id, least(100.0, value) AS score, 'event ' || event_id AS reasoning FROM events WHERE event_type = 'error'
            QUALIFY row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) = 1) o USING (narrative_id)""",
    "false_positive_posts": """SELECT post_id, entity_id, CASE WHEN m.event_id IS NULL THEN entity ELSE 'Tiontion' END AS entity FROM grouped
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') m ON CAST(m.event_id AS VARCHAR) = post_id
        WHERE m.event_id IS NULL OR m.user_id % 4 = 0""",
    "unmarked_narratives": """SELECT narrative_id FROM narratives_grouped WHERE narrative_id NOT IN (
        SELECT user_id % 50 FROM events WHERE event_type = 'purchase' AND user_id % 4 = 1)""",
    "narrative_feedback": "SELECT doc_id % 50 AS narrative_id, count(*) AS ratings, round(avg(1 + doc_id % 5), 9) AS mean_rating FROM labels GROUP BY ALL",
}
BODIES["fuzzy_tier"] = _FUZZY
BODIES["gated_narratives"] = BODIES["ranked_narratives"].replace("narratives_grouped", "narratives_gated")
BODIES["serve_overview"] = re.sub(r"(\w+)_grouped|\bgrouped\b", lambda m: f"{m[1]}_gated" if m[1] else "gated", BODIES["narrative_overview_table"])
BODIES["serve_entity"] = BODIES["narratives_per_type"].replace("narratives_grouped", f"narratives_gated WHERE entity_id = '{SERVED_ENTITY}'")
BODIES["observed_stage_counts"] = """SELECT 'input_posts' AS stage, count(*) AS "rows" FROM posts
    UNION ALL SELECT 'kept_posts', count(*) FROM kept UNION ALL SELECT 'dropped_posts', count(*) FROM evaluated WHERE reason IS NOT NULL
    UNION ALL SELECT 'entity_rows_after_resolution', count(*) FROM gate
    UNION ALL SELECT 'entity_rows_risk_relevant', count(*) FROM gate WHERE accepted
    UNION ALL SELECT 'entity_rows_dropped_no_risk', count(*) FROM gate WHERE NOT accepted"""
BODIES["resolved_every_tier"] = f"""
    SELECT p.post_id, coalesce(n, matches) AS matches, CASE WHEN n > 0 THEN 'fuzzy' ELSE resolution_method END AS resolution_method,
           coalesce(name, entity) AS entity, coalesce(near, resolution_confidence) AS resolution_confidence
    FROM resolved_posts p LEFT JOIN (
        SELECT post_id, count(*) AS n, max(confidence) AS near, arg_min(canonical_name, (-confidence, entity_pos, entity_id)) AS name
        FROM ({_FUZZY}) JOIN entities USING (entity_id) GROUP BY post_id) f USING (post_id)"""
for _name, _tier in [("exact_tier", 1), ("seed_alias_tier", 2), ("extra_alias_tier", 3)]:
    BODIES[_name] = f"""SELECT post_id, entity_id, CASE WHEN instr(lower(text), lower(term)) > 0
            THEN substr(text, instr(lower(text), lower(term)), length(term)) ELSE term END AS mention_text,
        CAST({ {1: 0.97, 2: 0.92, 3: 0.88}[_tier] } AS DOUBLE) AS confidence, '{ {1: 'exact', 2: 'exact alias', 3: 'exact alias'}[_tier] }' AS method
        FROM posts JOIN dict ON tier = {_tier} AND contains(lower({_squash('text')}), term_norm)
        QUALIFY row_number() OVER (PARTITION BY post_id, entity_id, lower(mention_text) ORDER BY alias_pos) = 1"""


def all_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in BODIES.items()}
