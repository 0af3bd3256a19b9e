"""The catalog's queries as plain SQL for an independent engine, same column names.

Each statement is written from the definition of the operator, with full joins and
full-depth windows in place of the blocked scoring the Spark plans use.
"""

from __future__ import annotations

from trovelight.functions.text import STOP_WORDS

# --- fragments ----------------------------------------------------------------------------------


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def key(x: str) -> str:
    return rf"trim(regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'), lambda t: {fold('t')})"


def said(x: str) -> str:
    """Sentences of already squeezed text, empty ones left out."""
    marked = rf"regexp_replace({x}, '([.!?])\s+', concat('\1', chr(1)), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def words(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda w: w <> '')"


def term_list(x: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    found = f"regexp_extract_all({x}, '[A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9+.-]{{2,}}')"
    return (
        f"list_distinct(list_filter(list_transform({found}, lambda t: lower(t)), "
        f"lambda t: NOT list_contains({stop}, t)))"
    )


DOCS = "docs AS (SELECT doc_id, printf('d%07d', doc_id) AS document_id, text, lang, source FROM documents)"


def windows(source: str, text: str, name: str, size: int = 1024, overlap: int = 128, keep: str = "") -> str:
    extra = "".join(f", {c.strip()}" for c in keep.split(",") if c.strip())
    step = size - overlap
    return f"""
{name}_w AS (SELECT document_id{extra}, {words(text)} AS w FROM {source}),
{name}_s AS (SELECT document_id{extra}, w, len(w) AS n,
    unnest(range(0, greatest(len(w) - {overlap}, 1), {step})) AS s FROM {name}_w WHERE len(w) > 0),
{name} AS (SELECT printf('%s::c%02d', document_id, s // {step}) AS chunk_id, document_id{extra},
    s // {step} AS chunk_position, s AS token_start, least(s + {size}, n) AS token_end,
    least(s + {size}, n) - s AS n_tokens, array_to_string(w[s + 1:s + {size}], ' ') AS content
    FROM {name}_s)"""


CHUNKS = DOCS + "," + windows("docs", "text", "chunks", keep="lang")
BENCH = "queries AS (SELECT printf('q%05d', item_id) AS query_id, text AS query FROM benchmark)"
TITLED = DOCS + f""",
titled_s AS (SELECT *, string_split(regexp_replace({squeeze('text')}, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)) AS s
    FROM docs),
titled AS (SELECT document_id, s[1] AS title, array_to_string(s[2:], ' ') AS body,
    'https://site.example/' || source || '/' || lang || '/' || document_id AS url FROM titled_s)"""
AUDIT = DOCS + f""",
audit AS (SELECT doc_id, 'https://site.example/' || source || '/' || lang || '/' || document_id AS url,
    {squeeze('text')} AS body, len({words('text')}) AS token_count, lang AS category FROM docs),
marked AS (SELECT *, sha256(body) AS digest,
    CASE WHEN token_count BETWEEN 50 AND 800 THEN 'eligible' ELSE 'length_excluded' END AS st FROM audit),
deduped AS (SELECT *, CASE WHEN st = 'eligible' AND
    row_number() OVER (PARTITION BY digest, st ORDER BY doc_id) > 1 THEN 'duplicate_excluded' ELSE st END AS status
    FROM marked)"""
TWO_HOP = f"""
spoken AS (SELECT doc_id, document_id, lang, {said(squeeze('text'))} AS s FROM docs),
middle AS (SELECT doc_id, document_id, lang, s[len(s) // 2 + 1] AS fact FROM spoken WHERE len(s) > 0),
raw AS (SELECT printf('q%05d', a.doc_id) AS query_id, a.fact || ' ' || b.fact AS query,
    CASE WHEN a.lang = b.lang THEN 'comparison' ELSE 'inference' END AS question_type,
    a.document_id AS d0, a.fact AS f0, b.document_id AS d1, b.fact AS f1, a.lang, b.lang AS next_lang
    FROM middle a JOIN middle b ON b.doc_id = a.doc_id + 1
    WHERE a.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)),
needs AS (SELECT query_id, 0 AS unit, d0 AS document_id, f0 AS fact FROM raw
    UNION ALL SELECT query_id, 1, d1, f1 FROM raw)"""

# Benchmark questions, some broken (see the catalog).
BROKEN = """
t AS (SELECT *, substr(query_id, 2)::BIGINT AS n FROM raw),
b AS (SELECT query_id, CASE WHEN n % 5 = 1 THEN 'other_query' WHEN n % 7 = 2 THEN 'null_query' ELSE question_type || '_query' END
    AS question_type, CASE WHEN n % 11 <> 3 THEN f1 END AS answer,
    CASE WHEN n % 13 = 4 THEN [d0, d0] WHEN n % 3 = 1 THEN [d0, d1 || 'x'] ELSE [d0, d1] END AS ds,
    [d0 || '::c00', d1 || CASE WHEN n % 4 = 3 THEN '::c99999' ELSE '::c00' END] AS cs FROM t)"""


def hits(needs: str, chunks: str, name: str) -> str:
    return f"""
{name} AS (SELECT n.query_id, n.unit, c.chunk_id FROM {needs} n JOIN {chunks} c
    ON n.document_id = c.document_id AND contains({fold(squeeze('c.content'))}, {fold(squeeze('n.fact'))}))"""


def bm25(chunks: str, queries: str, p: str = "") -> str:
    """{p}bm(query_id, chunk_id, score) over every pair, zero where no term is shared."""
    return f"""
{p}tok AS (SELECT chunk_id, {tokens('content')} AS t FROM {chunks}),
{p}stat AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS mean_length FROM {p}tok),
{p}post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM {p}tok) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}raw_idf AS (SELECT term, df, ln((SELECT n FROM {p}stat) - df + 0.5) - ln(df + 0.5) AS raw FROM {p}df),
{p}idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}raw_idf) ELSE raw END AS idf
    FROM {p}raw_idf),
{p}qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM {queries})
    GROUP BY ALL),
{p}hit AS (SELECT q.query_id, p.chunk_id, sum(q.qtf * i.idf * p.tf * 2.5
    / (p.tf + 1.5 * (0.25 + 0.75 * len(k.t) / (SELECT mean_length FROM {p}stat)))) AS score
    FROM {p}qt q JOIN {p}idf i USING (term) JOIN {p}post p USING (term) JOIN {p}tok k USING (chunk_id)
    GROUP BY q.query_id, p.chunk_id),
{p}bm AS (SELECT q.query_id, c.chunk_id, round(coalesce(h.score, 0), 9) AS score
    FROM {queries} q CROSS JOIN {chunks} c LEFT JOIN {p}hit h USING (query_id, chunk_id))"""


def hashed(source: str, columns: str, text: str, name: str) -> str:
    """{name}(columns, v): hashed vectors of `text`, 64 dimensions."""
    cols = columns
    return f"""
{name}_t AS (SELECT {cols}, row_number() OVER () AS rid, {tokens(text)} AS t FROM {source}),
{name}_c AS (SELECT rid, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS code
    FROM (SELECT rid, unnest(t) AS term FROM {name}_t)),
{name}_d AS (SELECT rid, code % 64 AS dim, sum(CASE WHEN (code // 64) % 2 = 0 THEN 1 ELSE -1 END) AS val
    FROM {name}_c GROUP BY rid, code % 64),
{name}_m AS (SELECT rid, map(list(dim), list(val)) AS m FROM {name}_d GROUP BY rid),
{name} AS (SELECT {cols}, list_transform(range(0, 64), lambda i: coalesce(m[i], 0)::DOUBLE) AS v
    FROM {name}_t LEFT JOIN {name}_m USING (rid))"""


def cos(a: str, b: str) -> str:
    return (
        f"list_dot_product({a}, {b}) / greatest(sqrt(list_dot_product({a}, {a})) "
        f"* sqrt(list_dot_product({b}, {b})), 1e-12)"
    )


POOLS = f"""
facts_s AS (SELECT chunk_id, document_id, chunk_position, {said(squeeze('content'))} AS s FROM chunks),
facts_u AS (SELECT chunk_id, document_id, chunk_position, unnest(s) AS fact, unnest(range(0, len(s))) AS pos FROM facts_s),
facts_k AS (SELECT *, {key('fact')} AS k FROM facts_u),
facts_1 AS (SELECT * FROM facts_k WHERE k <> ''
    QUALIFY row_number() OVER (PARTITION BY chunk_id, k ORDER BY pos) = 1),
facts AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) - 1 AS i,
    count(*) OVER (PARTITION BY chunk_id) AS n FROM facts_1),
dfacts_1 AS (SELECT * FROM facts
    QUALIFY row_number() OVER (PARTITION BY document_id, k ORDER BY chunk_position, i) = 1),
dfacts AS (SELECT document_id, fact, row_number() OVER (PARTITION BY document_id ORDER BY chunk_position, i) - 1 AS i,
    count(*) OVER (PARTITION BY document_id) AS n FROM dfacts_1),
budgets AS (SELECT c.chunk_id, coalesce(any_value(f.n), 0) AS n_facts,
    greatest(5, least(20, round_even(coalesce(any_value(f.n), 0) * 0.5, 0)))::BIGINT AS bounded,
    round_even(coalesce(any_value(f.n), 0) * 0.5, 0)::BIGINT AS unbounded
    FROM chunks c LEFT JOIN facts f USING (chunk_id) GROUP BY c.chunk_id)"""


def asked(source: str, owner: str, name: str, budget: str) -> str:
    """The questions of the offline generator: facts in turn, each turn beginning at another word of them."""
    return f"""
{name}_j AS (SELECT {owner}, n, unnest(range(0, {budget})) AS j FROM {source} WHERE i = 0),
{name} AS (SELECT {owner}, count(*)::INT AS n_asked, sha256(string_agg(question, chr(10) ORDER BY j)) AS digest FROM (
    SELECT {owner}, j, (t + 1) || ': what of ' || array_to_string(w[p + 1:len(w)] || w[1:p], ' ') || '?' AS question FROM (
        SELECT *, (t * len(w) // 5) % len(w) AS p FROM (
            SELECT {name}_j.{owner}, j, j // {name}_j.n AS t, string_split(fact, ' ') AS w
            FROM {name}_j JOIN {source} ON {source}.{owner} = {name}_j.{owner} AND {source}.i = j % {name}_j.n))) GROUP BY {owner})"""


UNBOUNDED = "round_even(n * 0.5, 0)::BIGINT"
BOUNDED = f"greatest(5, least(20, {UNBOUNDED}))"


def turns(source: str, owner: str, pool: str, bounded: bool) -> str:
    budget = "round_even(n * 0.5, 0)::BIGINT"
    if bounded:
        budget = f"greatest(5, least(20, {budget}))"
    return (
        f"SELECT '{pool}' AS pool, {owner} AS owner, i + n * r AS number, "
        f"'Statement ' || (r + 1) || ': ' || fact AS text FROM {source}, range(0, 6) t(r) "
        f"WHERE i + n * r < {budget}"
    )


QUESTIONS = (
    "questions AS ("
    + " UNION ALL ".join(
        [
            turns("facts", "chunk_id", "bounded", True),
            turns("facts", "chunk_id", "unbounded", False),
            turns("dfacts", "document_id", "doc_bounded", True),
            turns("dfacts", "document_id", "doc_unbounded", False),
        ]
    )
    + ")"
)


def signals(queries: str) -> str:
    """sig(query_id, chunk_id, c, bounded, unbounded, doc_bounded, doc_unbounded)."""
    return (
        hashed("chunks", "chunk_id, document_id", "content", "cv")
        + ","
        + hashed(queries, "query_id", "query", "qv")
        + ","
        + hashed("questions", "pool, owner", "text", "uv")
        + f""",
best AS (SELECT q.query_id, u.pool, u.owner, max({cos('q.v', 'u.v')}) AS best FROM qv q CROSS JOIN uv u GROUP BY ALL),
cs AS (SELECT q.query_id, c.chunk_id, c.document_id, {cos('q.v', 'c.v')} AS c FROM qv q CROSS JOIN cv c),
sig AS (SELECT cs.*, b.best AS b, u.best AS u, db.best AS db, du.best AS du FROM cs
    LEFT JOIN best b ON b.pool = 'bounded' AND b.query_id = cs.query_id AND b.owner = cs.chunk_id
    LEFT JOIN best u ON u.pool = 'unbounded' AND u.query_id = cs.query_id AND u.owner = cs.chunk_id
    LEFT JOIN best db ON db.pool = 'doc_bounded' AND db.query_id = cs.query_id AND db.owner = cs.document_id
    LEFT JOIN best du ON du.pool = 'doc_unbounded' AND du.query_id = cs.query_id AND du.owner = cs.document_id)"""
    )


BASE, BND, UNB = "Baseline", "Chunk questions 5-20", "Chunk questions unbounded"
DBND, DUNB = "Chunk and document questions 5-20", "Chunk and document questions unbounded"
RULES = {
    BASE: "c",
    BND: "(c + coalesce(b, c)) / 2",
    UNB: "(c + coalesce(u, c)) / 2",
    DBND: "CASE WHEN db IS NULL THEN (c + coalesce(b, c)) / 2 ELSE (c + coalesce(b, c) + db) / 3 END",
    DUNB: "CASE WHEN du IS NULL THEN (c + coalesce(u, c)) / 2 ELSE (c + coalesce(u, c) + du) / 3 END",
}
UNION_RULES = {**{n: RULES[n] for n in (BASE, BND, UNB)}, DBND: "(c + coalesce(b, c) + coalesce(db, 0)) / 3"}


def ranked(rules: dict[str, str]) -> str:
    """top(query_id, condition, rank, chunk_id, score) from sig and bm."""
    dense = " UNION ALL ".join(
        f"SELECT query_id, chunk_id, '{name}' AS condition, round({rule}, 9) AS s FROM sig"
        for name, rule in rules.items()
    )
    return f"""
fused AS ({dense}),
dr AS (SELECT query_id, chunk_id, condition,
    row_number() OVER (PARTITION BY query_id, condition ORDER BY s DESC, chunk_id) AS r FROM fused),
sr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM bm),
rrf AS (SELECT query_id, dr.condition, chunk_id, 1.0 / (60 + sr.r)::DOUBLE + 1.0 / (60 + dr.r)::DOUBLE AS score
    FROM dr JOIN sr USING (query_id, chunk_id)),
top AS (SELECT query_id, condition, chunk_id, score,
    row_number() OVER (PARTITION BY query_id, condition ORDER BY score DESC, chunk_id) AS rank FROM rrf
    QUALIFY rank <= 10)"""


BASE_SIGNALS = (
    hashed("chunks", "chunk_id, document_id", "content", "cv")
    + ","
    + hashed("queries", "query_id", "query", "qv")
    + f", sig AS (SELECT q.query_id, c.chunk_id, {cos('q.v', 'c.v')} AS c FROM qv q CROSS JOIN cv c)"
)

EVAL = (
    hits("needs", "chunks", "hit_units")
    + """,
solved AS (SELECT query_id FROM hit_units GROUP BY query_id HAVING count(DISTINCT unit) = 2),
units AS (SELECT * FROM hit_units WHERE query_id IN (SELECT query_id FROM solved)),
queries AS (SELECT query_id, trim(query) AS query, question_type FROM raw WHERE query_id IN (SELECT query_id FROM solved))"""
)

METRICS = """
need AS (SELECT query_id, count(DISTINCT unit) AS n_units, count(DISTINCT chunk_id) AS n_gold FROM units GROUP BY query_id),
pairs AS (SELECT condition, query_id FROM top GROUP BY ALL),
uh AS (SELECT t.condition, t.query_id, u.unit, min(t.rank) AS f FROM top t JOIN units u USING (query_id, chunk_id) GROUP BY ALL),
uq AS (SELECT condition, query_id, count(*) FILTER (f <= 1) AS n1, count(*) FILTER (f <= 5) AS n5, count(*) AS n10,
    min(f) AS f FROM uh GROUP BY ALL),
gh AS (SELECT DISTINCT t.condition, t.query_id, t.chunk_id, t.rank FROM top t JOIN units u USING (query_id, chunk_id)),
gq AS (SELECT condition, query_id, sum(1 / log2(rank + 1)) AS dcg FROM gh GROUP BY ALL),
qm AS (SELECT p.condition, p.query_id, coalesce(n1, 0) / n_units AS r1, coalesce(n5, 0) / n_units AS r5,
    coalesce(n10, 0) / n_units AS r10, CASE WHEN coalesce(n5, 0) = n_units THEN 1.0 ELSE 0.0 END AS full5,
    coalesce(1.0 / f, 0) AS mrr,
    coalesce(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg
    FROM pairs p JOIN need USING (query_id) LEFT JOIN uq USING (condition, query_id) LEFT JOIN gq USING (condition, query_id))"""

_NAMES = {
    "r1": "evidence_recall_at_1",
    "r5": "evidence_recall_at_5",
    "r10": "evidence_recall_at_10",
    "full5": "all_evidence_hit_at_5",
    "mrr": "mrr_at_10",
    "ndcg": "ndcg_at_10",
}
VALUES = ", ".join(f"round({c}, 6)::DOUBLE AS {n}" for c, n in _NAMES.items())
MEANS = ", ".join(f"round(avg({c}), 6)::DOUBLE AS {n}" for c, n in _NAMES.items())
AVERAGES = ", ".join(f"avg({c})::DOUBLE AS {n}" for c, n in _NAMES.items())

# Merged study: every id carries its dataset; alignment happens within a dataset.
MERGED = (
    CHUNKS.replace("chunks AS (", "plain AS (")
    + ","
    + TWO_HOP
    + """,
tagged AS (SELECT *, CASE WHEN lang = 'en' THEN 'main' ELSE 'other' END AS dataset FROM plain),
allowed AS (SELECT *, CASE WHEN lang = 'en' THEN 'main' ELSE 'other' END AS dataset FROM raw
    WHERE (lang = 'en') = (next_lang = 'en')),
needs_in AS (SELECT n.* FROM needs n JOIN allowed a USING (query_id)),"""
    + hits("needs_in", "plain", "hit_units")
    + """,
solved AS (SELECT query_id FROM hit_units GROUP BY query_id HAVING count(DISTINCT unit) = 2),
units AS (SELECT a.dataset || '::' || h.query_id AS query_id, unit, a.dataset || '::' || chunk_id AS chunk_id
    FROM hit_units h JOIN allowed a USING (query_id) WHERE h.query_id IN (SELECT query_id FROM solved)),
queries AS (SELECT dataset || '::' || query_id AS query_id, trim(query) AS query, dataset FROM allowed
    WHERE query_id IN (SELECT query_id FROM solved)),
chunks AS (SELECT dataset || '::' || chunk_id AS chunk_id, dataset || '::' || document_id AS document_id,
    chunk_position, content, dataset FROM tagged)"""
)
UNION_STUDY = (
    f"WITH {MERGED}, {POOLS}, {QUESTIONS}, {bm25('chunks', 'queries')}, {signals('queries')}, "
    f"{ranked(UNION_RULES)}, {METRICS}"
)


def _alone(name: str) -> str:
    """{name}_top: every condition's ranking of one dataset against its own chunks."""
    p = f"{name}_"
    return f"""
{p}chunks AS (SELECT * FROM chunks WHERE dataset = '{name}'),
{p}queries AS (SELECT * FROM queries WHERE dataset = '{name}'),
{bm25(p + 'chunks', p + 'queries', p)},
{p}rank AS (SELECT f.query_id, f.condition, f.chunk_id,
    row_number() OVER (PARTITION BY f.query_id, f.condition ORDER BY f.s DESC, f.chunk_id) AS d,
    row_number() OVER (PARTITION BY f.query_id, f.condition ORDER BY b.score DESC, f.chunk_id) AS b
    FROM fused f JOIN {p}bm b USING (query_id, chunk_id)),
{p}top AS (SELECT query_id, condition, chunk_id,
    row_number() OVER (PARTITION BY query_id, condition ORDER BY 1.0 / (60 + d)::DOUBLE + 1.0 / (60 + b)::DOUBLE DESC, chunk_id) AS rank
    FROM {p}rank QUALIFY rank <= 10)"""


# Every document related to another, in order (see `neighbors`).
RELATED = f"""
term_sets AS (SELECT document_id, {term_list("title || ' ' || body")} AS ts, {term_list('title')} AS tt FROM titled),
held AS (SELECT document_id, unnest(ts) AS term, tt FROM term_sets),
term_df AS (SELECT term, count(*) AS df FROM held GROUP BY term),
weighed AS (SELECT document_id, term, ln((SELECT count(*) + 1 FROM titled) / (df + 1)) + 1 AS weight,
    row_number() OVER (PARTITION BY document_id ORDER BY df, term) AS r, list_contains(tt, term) AS in_title
    FROM held JOIN term_df USING (term)),
shared AS (SELECT f.document_id, o.document_id AS neighbor, round(sum(f.weight), 9) AS score FROM weighed f JOIN held o
    ON f.term = o.term AND f.document_id <> o.document_id WHERE f.r <= 120 OR f.in_title GROUP BY ALL),
related AS (SELECT document_id, neighbor, score, count(*) OVER (PARTITION BY document_id) AS n_related,
    row_number() OVER (PARTITION BY document_id ORDER BY score DESC, neighbor) AS rank FROM shared)"""


ORACLE = {
    "tokenize_ascii": f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first_token,
    sha256(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all({fold('text')}, '[a-z0-9]+') AS t FROM documents)""",
    "tokenize_unicode": f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first_token,
    sha256(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""",
    "normalize_text": f"""
SELECT doc_id, sha256({fold(squeeze('text'))}) AS folded, sha256(lower({squeeze('text')})) AS lowered,
    sha256({key('text')}) AS words FROM documents""",
    "sentence_split": r"""
SELECT doc_id, unnest(range(0, len(s))) AS pos, length(unnest(s)) AS n_chars FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)) AS s
    FROM documents)""",
    "rare_terms": f"SELECT doc_id, unnest({term_list('text')}) AS term FROM documents",
    "url_category": r"""
SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'),
    lambda p: p <> '')[2], 'other') AS category FROM pages""",
    "sitemap_urls": """
SELECT page_id, trim(url) AS url, printf('2024-01-%02d', page_id % 28 + 1) AS last_modified FROM pages""",
    "json_salvage": """
SELECT conv_id, turn, turn % 4 <> 3 AS ok, CASE WHEN turn % 4 <> 3 THEN conv_id ELSE -1 END AS parsed_conv,
    CASE WHEN turn % 4 <> 3 THEN role ELSE 'none' END AS parsed_who FROM conversations""",
    "page_titles": rf"""
WITH named AS (SELECT page_id, html, array_to_string(list_transform(regexp_extract_all(s, '\p{{L}}+|[^\p{{L}}]+'),
    lambda r: upper(r[1]) || lower(r[2:])), '') AS from_url
FROM (SELECT page_id, coalesce(html, '') AS html,
    replace(string_split(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/')[-1], '-', ' ') AS s FROM pages)),
marked AS (SELECT *, regexp_matches(html, '(?is)<title[^>]*>.*?</title>') AS has, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS raw FROM named),
plain AS (SELECT *, replace(replace(replace(replace(replace(raw, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&') AS t FROM marked)
SELECT page_id, from_url, CASE WHEN has THEN {squeeze('t')} ELSE from_url END AS title FROM plain""",
    "body_hash_dedup": f"WITH {AUDIT} SELECT doc_id, status FROM deduped",
    "token_range_status": f"""
WITH {AUDIT} SELECT st AS status, count(*) AS n, min(token_count) AS min_tokens, max(token_count) AS max_tokens,
    round(avg(token_count), 2) AS mean_tokens FROM marked GROUP BY st""",
    "priority_selection": f"""
WITH {AUDIT}, chosen AS (SELECT doc_id FROM deduped WHERE status = 'eligible' ORDER BY
    CASE category WHEN 'de' THEN 0 WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 999 END, abs(token_count - 250), url LIMIT 340),
named AS (SELECT doc_id, printf('doc_%04d', row_number() OVER (ORDER BY doc_id)) AS document_id FROM chosen)
SELECT doc_id, CASE WHEN status = 'eligible' AND document_id IS NULL THEN 'eligible_not_selected_target_cap'
    ELSE status END AS status, document_id FROM deduped LEFT JOIN named USING (doc_id)""",
    "corpus_statistics": f"""
WITH {AUDIT} SELECT count(*) AS document_count, min(token_count) AS minimum_document_tokens,
    max(token_count) AS maximum_document_tokens, round(avg(token_count), 2) AS mean_document_tokens
FROM deduped WHERE status = 'eligible'""",
    "sliding_windows": f"""
WITH {CHUNKS} SELECT chunk_id, document_id, token_start, token_end, n_tokens, sha256(content) AS digest FROM chunks""",
    "sentence_windows": rf"""
WITH RECURSIVE {DOCS},
parts AS (SELECT document_id, unnest(range(len(ps))) AS par, unnest(ps) AS body
    FROM (SELECT document_id, string_split_regex(coalesce(text, ''), '\n\s*\n') AS ps FROM docs)),
spoken AS (SELECT document_id, par, unnest(range(len(ss))) AS k, unnest(ss) AS sentence
    FROM (SELECT document_id, par, {said(squeeze('body'))} AS ss FROM parts)),
cut AS (SELECT document_id, par, k, w, unnest(range(0, len(w), 256)) AS o
    FROM (SELECT document_id, par, k, string_split(sentence, ' ') AS w FROM spoken)),
units AS (SELECT document_id, par, array_to_string(w[o + 1:o + 256], ' ') AS t, least(256, len(w) - o) AS cost,
    row_number() OVER (PARTITION BY document_id ORDER BY par, k, o) - 1 AS i FROM cut),
edges AS (SELECT document_id, i, (sum(cost) OVER (PARTITION BY document_id ORDER BY i) - cost)::BIGINT AS a FROM units
    UNION ALL SELECT document_id, count(*), sum(cost)::BIGINT FROM units GROUP BY document_id),
reach AS (SELECT document_id, i,
    max(i) OVER (PARTITION BY document_id ORDER BY a RANGE BETWEEN CURRENT ROW AND 256 FOLLOWING) AS e,
    max(i) OVER (PARTITION BY document_id ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND 32 PRECEDING) AS back,
    max(i) OVER (PARTITION BY document_id) AS n FROM edges),
steps AS (SELECT s.document_id, s.i, s.e, s.n, CASE WHEN z.back > s.i THEN z.back ELSE s.e END AS follow
    FROM reach s JOIN reach z ON z.document_id = s.document_id AND z.i = s.e WHERE s.i < s.n),
walk AS (SELECT document_id, 0::BIGINT AS position, i, e, n, follow FROM steps WHERE i = 0
    UNION ALL SELECT s.document_id, position + 1, s.i, s.e, s.n, s.follow
    FROM walk w JOIN steps s ON s.document_id = w.document_id AND s.i = w.follow WHERE w.e < w.n),
filled AS (SELECT w.document_id, position, w.e = w.n AS is_last, sum(cost)::BIGINT AS n_tokens,
    list({{'p': par, 't': t}} ORDER BY u.i) AS own, string_agg(t, ' ' ORDER BY u.i) AS content
    FROM walk w JOIN units u ON u.document_id = w.document_id AND u.i >= w.i AND u.i < w.e GROUP BY ALL),
told AS (SELECT *, lag(own) OVER (PARTITION BY document_id ORDER BY position) AS before FROM filled)
SELECT printf('%s::l%d', document_id, position) AS chunk_id, document_id, position AS chunk_position, n_tokens,
    sha256(content) AS digest FROM told WHERE NOT is_last OR before IS NULL OR own <> before""",
    "integrity_report": f"""
WITH {TITLED}, d AS (SELECT *, sha256(body) AS sha, len({words('body')}) AS token_count FROM titled),
{windows('d', 'body', 'c', 256, 32)},
per AS (SELECT d.document_id, count(c.chunk_id) AS n FROM d LEFT JOIN c USING (document_id) GROUP BY ALL)
SELECT 'duplicate_document_id' AS rule, count(*) - count(DISTINCT document_id) AS n_violations FROM d
UNION ALL SELECT 'duplicate_url', count(*) - count(DISTINCT url) FROM d
UNION ALL SELECT 'duplicate_body', count(*) - count(DISTINCT sha) FROM d
UNION ALL SELECT 'length_out_of_range', count(*) FILTER (token_count NOT BETWEEN 100 AND 800) FROM d
UNION ALL SELECT 'empty_body', count(*) FILTER (trim(body) = '') FROM d
UNION ALL SELECT 'duplicate_chunk_id', count(*) - count(DISTINCT chunk_id) FROM c
UNION ALL SELECT 'invalid_chunk_size', count(*) FILTER (n_tokens NOT BETWEEN 1 AND 1024) FROM c
UNION ALL SELECT 'orphan_chunk', count(*) FROM c WHERE document_id NOT IN (SELECT document_id FROM d)
UNION ALL SELECT 'fewer_than_two_chunks', count(*) FILTER (n < 2) FROM per""",
    "posting_lists": f"""
WITH {CHUNKS}, t AS (SELECT chunk_id, unnest({tokens('content')}) AS term FROM chunks),
p AS (SELECT term, chunk_id, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS n_chunks, sum(tf)::BIGINT AS n_occurrences, max(tf) AS max_tf FROM p GROUP BY term""",
    "bm25_idf": f"""
WITH {CHUNKS}, {BENCH}, {bm25('chunks', 'queries')} SELECT term, df, round(idf, 6) AS idf FROM idf""",
    "bm25_top10": f"""
WITH {CHUNKS}, {BENCH}, {bm25('chunks', 'queries')}
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank,
    round(score, 6) AS score FROM bm QUALIFY rank <= 10""",
    "unit_vectors": """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS len FROM e)
SELECT vec_id, round(v[1] / len, 6) AS first, round(v[-1] / len, 6) AS last,
    round(sqrt(list_dot_product(v, v)), 6) AS length, round(1.0::DOUBLE, 6) AS self_cosine FROM n""",
    "dense_top10": f"""
WITH e AS (SELECT printf('v%07d', vec_id) AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.id AS query_id, c.id AS chunk_id, round({cos('q.v', 'c.v')}, 9) AS s FROM e q CROSS JOIN e c)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank,
    round(s, 6) AS score FROM s QUALIFY rank <= 10""",
    "owner_max": f"""
WITH e AS (SELECT printf('v%07d', vec_id) AS id, embedding::DOUBLE[] AS v, label::VARCHAR AS owner FROM embeddings)
SELECT q.id AS query_id, c.owner, round(round(max({cos('q.v', 'c.v')}), 9), 6) AS best FROM e q CROSS JOIN e c
GROUP BY q.id, c.owner""",
    "fusion_rules": f"""
WITH e AS (SELECT printf('v%07d', vec_id) AS id, embedding::DOUBLE[] AS v, label AS owner FROM embeddings),
m AS (SELECT q.id AS query_id, q.owner AS own, c.owner, round(max({cos('q.v', 'c.v')}), 9) AS best
    FROM e q CROSS JOIN e c GROUP BY ALL),
sig AS (SELECT query_id, max(best) FILTER (owner = 0) AS c, max(best) FILTER (owner = 1 AND own <> 1) AS b,
    max(best) FILTER (owner = 2 AND own <> 2) AS db, b AS u, db AS du FROM m GROUP BY query_id)
SELECT query_id, condition, round(score, 6) AS score FROM ("""
    + " UNION ALL ".join(
        f"SELECT query_id, '{n}' AS condition, {r} AS score FROM sig"
        for n, r in {**RULES, "union: " + DBND: UNION_RULES[DBND]}.items()
    )
    + ")",
    "strict_fusion": f"""
WITH e AS (SELECT printf('v%07d', vec_id) AS id, embedding::DOUBLE[] AS v, label AS owner FROM embeddings),
m AS (SELECT q.id AS query_id, c.owner, round(max({cos('q.v', 'c.v')}), 9) AS best FROM e q CROSS JOIN e c GROUP BY ALL),
s AS (SELECT query_id, max(best) FILTER (owner = 0) AS c, max(best) FILTER (owner = 1) AS b, max(best) FILTER (owner = 2) AS d
    FROM m GROUP BY query_id HAVING c IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL)
SELECT query_id, 'Strict chunk questions 5-20' AS condition, round((c + b) / 2, 6) AS score FROM s
UNION ALL SELECT query_id, 'Strict {DBND[0].lower() + DBND[1:]}', round((c + b + d) / 3, 6) FROM s
UNION ALL SELECT query_id, '{DUNB}', round((c + b + d) / 3, 6) FROM s""",
    "rrf_top10": f"""
WITH {CHUNKS}, {BENCH}, {bm25('chunks', 'queries')}, {BASE_SIGNALS}, {ranked({BASE: 'c'})}
SELECT query_id, condition, rank, chunk_id, round(score, 9) AS score FROM top""",
    "conditions_top10": f"""
WITH {CHUNKS}, {BENCH}, {POOLS}, {QUESTIONS}, {bm25('chunks', 'queries')}, {signals('queries')}, {ranked(RULES)}
SELECT query_id, condition, rank, chunk_id, round(score, 9) AS score FROM top""",
    "corpus_queries": f"""
WITH {DOCS}, {TWO_HOP} SELECT query_id, question_type || '_query' AS question_type FROM raw
WHERE lang = 'en' AND next_lang = 'en'""",
    "evaluation_queries": f"""
WITH {CHUNKS}, {TWO_HOP}, {EVAL},
u AS (SELECT query_id, unit, list_sort(list(DISTINCT chunk_id)) AS c FROM units GROUP BY ALL),
g AS (SELECT query_id, list(c ORDER BY unit) AS us FROM u GROUP BY query_id)
SELECT query_id, q.question_type, least(d0, d1) || ',' || greatest(d0, d1) AS documents, 2::BIGINT AS n_documents,
    2::BIGINT AS n_facts, array_to_string(list_transform(us, lambda x: array_to_string(x, '|')), ',') AS units,
    array_to_string(list_sort(list_distinct(flatten(us))), ',') AS gold
FROM queries q JOIN g USING (query_id) JOIN raw USING (query_id)""",
    "evidence_metrics": f"""
WITH {CHUNKS}, {TWO_HOP}, {EVAL}, {POOLS}, {QUESTIONS}, {bm25('chunks', 'queries')}, {signals('queries')},
{ranked(RULES)}, {METRICS} SELECT condition, query_id, {VALUES} FROM qm""",
    "condition_means": f"""
WITH {CHUNKS}, {TWO_HOP}, {EVAL}, {POOLS}, {QUESTIONS}, {bm25('chunks', 'queries')}, {signals('queries')},
{ranked(RULES)}, {METRICS} SELECT condition, {MEANS} FROM qm GROUP BY condition""",
    "baseline_deltas": f"""
WITH {CHUNKS}, {TWO_HOP}, {EVAL}, {POOLS}, {QUESTIONS}, {bm25('chunks', 'queries')}, {signals('queries')},
{ranked(RULES)}, {METRICS},
m AS (SELECT condition, {AVERAGES} FROM qm GROUP BY condition),
l AS (UNPIVOT m ON {', '.join(_NAMES.values())} INTO NAME metric VALUE value),
b AS (SELECT metric, value AS baseline FROM l WHERE condition = '{BASE}')
SELECT condition, list_position({list(RULES)}, condition)::BIGINT AS position, metric, round(value, 6) AS value,
    round(baseline, 6) AS baseline, round(value - baseline, 6) AS delta,
    CASE WHEN baseline <> 0 THEN round((value - baseline) / baseline * 100, 3) END AS relative_percent
FROM l JOIN b USING (metric)""",
    "merged_means": f"""{UNION_STUDY}, j AS (SELECT qm.*, q.dataset FROM qm JOIN queries q USING (query_id))
SELECT condition, coalesce(dataset, 'all') AS dataset, {MEANS} FROM j
GROUP BY GROUPING SETS ((condition), (condition, dataset))""",
    "wrong_corpus_rate": f"""
WITH {MERGED}, {POOLS}, {QUESTIONS}, {bm25('chunks', 'queries')}, {signals('queries')},
{ranked(UNION_RULES)}
SELECT condition, dataset, round(avg(CASE WHEN starts_with(chunk_id, dataset || '::') THEN 0 ELSE 1 END), 6) AS wrong_corpus_top1
FROM top JOIN queries USING (query_id) WHERE rank = 1 GROUP BY ALL""",
    "interference": f"""
WITH {MERGED}, {POOLS}, {QUESTIONS}, {bm25('chunks', 'queries')}, {signals('queries')},
{ranked(UNION_RULES).replace('top AS (', 'joint AS (')}, {_alone('main')}, {_alone('other')},
top AS (SELECT query_id, 'merged' || condition AS condition, chunk_id, rank FROM joint
    UNION ALL SELECT query_id, 'alone' || condition, chunk_id, rank FROM main_top
    UNION ALL SELECT query_id, 'alone' || condition, chunk_id, rank FROM other_top), {METRICS},
m AS (SELECT condition, q.dataset, {AVERAGES} FROM qm JOIN queries q USING (query_id) GROUP BY ALL),
l AS (UNPIVOT m ON {', '.join(_NAMES.values())} INTO NAME metric VALUE value),
w AS (SELECT a.dataset, a.metric, substr(a.condition, 6) AS condition, a.value AS alone, b.value AS merged,
    b.value - a.value AS d FROM l a JOIN l b ON a.dataset = b.dataset AND a.metric = b.metric
    AND starts_with(a.condition, 'alone') AND b.condition = 'merged' || substr(a.condition, 6))
SELECT dataset, condition, list_position({list(UNION_RULES)}, condition)::BIGINT AS position, metric, round(alone, 6) AS alone,
    round(merged, 6) AS merged, round(d, 6) AS delta,
    CASE WHEN d > 0.0005 THEN 'up' WHEN d < -0.0005 THEN 'down' ELSE 'flat' END AS direction FROM w""",
    "question_budget": f"WITH {CHUNKS}, {POOLS} SELECT chunk_id, n_facts, bounded, unbounded FROM budgets",
    "document_fact_union": f"""
WITH {CHUNKS}, {POOLS} SELECT document_id, i AS ordinal, n AS n_facts, sha256(fact) AS digest FROM dfacts""",
    "chunk_question_pools": f"""
WITH {CHUNKS}, {POOLS}, {QUESTIONS} SELECT pool, owner AS chunk_id, number, sha256(text) AS digest FROM questions
WHERE pool IN ('bounded', 'unbounded')""",
    "enrichment_quality": f"""
WITH {CHUNKS}, {POOLS}, l AS (SELECT 'bounded' AS pool, bounded AS n FROM budgets
    UNION ALL SELECT 'unbounded', unbounded FROM budgets)
SELECT pool, sum(n)::BIGINT AS generated_questions, min(n) AS questions_min, round(avg(n), 6) AS questions_mean,
    max(n) AS questions_max, count(*) FILTER (n > 0) AS owners_with_questions,
    count(*) FILTER (n = 0) AS owners_without_questions FROM l GROUP BY pool""",
    "generate_offline": f"""
WITH {CHUNKS}, {POOLS}, {asked("facts", "chunk_id", "b", BOUNDED)}, {asked("facts", "chunk_id", "u", UNBOUNDED)}
SELECT g.chunk_id, CASE WHEN n_facts > 0 THEN n_facts END AS n_distinct_facts, CASE WHEN n_facts > 0 THEN bounded END AS bounded_budget,
    CASE WHEN n_facts > 0 THEN unbounded END AS unbounded_budget, b.n_asked AS n_bounded,
    CASE WHEN n_facts > 0 THEN coalesce(u.n_asked, 0) END AS n_unbounded, b.digest AS bounded_digest,
    CASE WHEN n_facts > 0 THEN coalesce(u.digest, sha256('')) END AS unbounded_digest,
    CASE WHEN n_facts = 0 THEN 'no facts for ' || g.chunk_id END AS error
FROM budgets g LEFT JOIN b ON b.chunk_id = g.chunk_id LEFT JOIN u ON u.chunk_id = g.chunk_id""",
    **{
        name: f"""
WITH {CHUNKS}, {POOLS}, {asked("dfacts", "document_id", "q", budget)},
owned AS (SELECT document_id, count(*)::INT AS n_chunks FROM chunks GROUP BY document_id),
sized AS (SELECT document_id, n, {budget} AS budget FROM dfacts WHERE i = 0)
SELECT o.document_id, n_chunks, s.n AS n_facts, s.budget AS question_budget,
    CASE WHEN s.n IS NOT NULL THEN coalesce(n_asked, 0) END AS n_questions,
    CASE WHEN s.n IS NOT NULL THEN coalesce(digest, sha256('')) END AS digest, s.n IS NULL AS failed
FROM owned o LEFT JOIN sized s USING (document_id) LEFT JOIN q USING (document_id)"""
        for name, budget in (("generate_documents", BOUNDED), ("generate_documents_unbounded", UNBOUNDED))
    },
    "question_dedup": f"""
SELECT printf('%06d-%03d', conv_id, turn) AS query_id,
    row_number() OVER (PARTITION BY lower({squeeze('text')}) ORDER BY printf('%06d-%03d', conv_id, turn)) = 1 AS is_first
FROM conversations WHERE role = 'user'""",
    "resume_todo": f"""
WITH {CHUNKS} SELECT chunk_id, document_id, lang AS document_title FROM chunks
WHERE document_id NOT IN (SELECT printf('d%07d', doc_id) FROM labels)""",
    "default_generations": f"""
WITH {CHUNKS}, {POOLS}, known AS (SELECT printf('d%07d', doc_id) AS document_id FROM labels)
SELECT chunk_id, CASE WHEN k THEN n_facts ELSE 0 END AS n_distinct_facts, CASE WHEN k THEN n_facts ELSE 0 END AS n_listed,
    NOT k AS generation_skipped
FROM (SELECT b.*, c.document_id IN (SELECT document_id FROM known) AS k FROM budgets b JOIN chunks c USING (chunk_id))""",
    "cache_reuse": f"""
WITH {CHUNKS}, {POOLS} SELECT chunk_id AS owner, count(*) AS n_questions, chunk_id AS supports FROM facts
WHERE document_id IN (SELECT printf('d%07d', doc_id) FROM labels WHERE quality = 1) GROUP BY chunk_id""",
    "embed_offline": f"""
WITH {CHUNKS}, {hashed('chunks', 'chunk_id', 'content', 'e')}
SELECT chunk_id, dim, value FROM (SELECT chunk_id, unnest(range(0, 64)) AS dim, unnest(v) AS value FROM e) WHERE value <> 0""",
    "embed_resume": f"""
WITH {hashed("(SELECT * FROM conversations WHERE role = 'user')", 'conv_id, turn', 'text', 'e')}
SELECT conv_id, turn, list_dot_product(v, v) AS squared_length FROM e""",
    "neighbors": f"""
WITH {TITLED}, {RELATED}
SELECT document_id, neighbor, rank, round(score, 6) AS score, n_related FROM related WHERE rank <= 10""",
    "question_specs": f"""
WITH {TITLED}, {RELATED},
anchors AS (SELECT document_id, row_number() OVER (ORDER BY md5('20260817:' || document_id), document_id) - 1 AS anchor
    FROM titled),
types AS (SELECT * FROM (VALUES ('inference_query', 816), ('comparison_query', 856), ('temporal_query', 583)) v(label, t)),
hops AS (SELECT * FROM (VALUES (2, 1169), (3, 774), (4, 312)) v(label, t)),
type_at AS (SELECT label AS question_type, row_number() OVER (ORDER BY (t - j) / t DESC, label DESC) - 1 AS position
    FROM (SELECT label, t, unnest(range(0, t)) AS j FROM types)),
hop_at AS (SELECT label AS h, row_number() OVER (ORDER BY (t - j) / t DESC, label DESC) - 1 AS position
    FROM (SELECT label, t, unnest(range(0, t)) AS j FROM hops)),
n AS (SELECT count(*) AS n FROM titled), totals AS (SELECT document_id, max(n_related) AS m FROM related GROUP BY ALL),
slots AS (SELECT position, question_type, h, a.document_id, m, (position // (SELECT n FROM n)) % greatest(coalesce(m, 1), 1) AS turn
    FROM type_at JOIN hop_at USING (position) JOIN anchors a ON a.anchor = position % (SELECT n FROM n)
    LEFT JOIN totals USING (document_id)),
offers AS (SELECT position, document_id, 0 AS p FROM slots
    UNION ALL SELECT position, neighbor, 1 + (rank - 1 - turn + m) % m FROM slots JOIN related USING (document_id)
    UNION ALL SELECT position, anchors.document_id, 1000000000 + anchors.anchor FROM slots CROSS JOIN anchors WHERE anchors.anchor < 4),
best AS (SELECT position, document_id, min(p) AS p FROM offers GROUP BY ALL),
placed AS (SELECT position, document_id, row_number() OVER (PARTITION BY position ORDER BY p) - 1 AS place FROM best)
SELECT printf('yq%05d', position) AS query_id, question_type, place, p.document_id FROM placed p JOIN slots USING (position)
WHERE place < h
UNION ALL SELECT printf('yq%05d', 2255 + i), 'null_query', 0, document_id
FROM range(0, 301) r(i) JOIN anchors ON anchor = (i * 7) % (SELECT n FROM n)""",
    "best_excerpt": f"""
WITH {TITLED}, {windows('titled', 'body', 'c', 128, 16)},
n AS (SELECT document_id, {term_list('title')} AS tt, substr(document_id, 2)::BIGINT AS n FROM titled),
b AS (SELECT printf('q%05d', a.n) AS query_id, [a.document_id, z.document_id] AS ds,
    list_distinct(list_concat(a.tt, z.tt)) AS focus FROM n a JOIN n z ON z.n = a.n + 1),
m AS (SELECT query_id, focus, unnest(ds) AS document_id FROM b),
s AS (SELECT m.query_id, m.document_id, c.chunk_id, c.n_tokens,
    len(list_intersect({term_list('c.content')}, m.focus)) AS shared FROM m JOIN c USING (document_id))
SELECT query_id, document_id, chunk_id, shared FROM s
QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY shared DESC, n_tokens DESC, chunk_id DESC) = 1""",
    "balanced_sequence": """
WITH t AS (SELECT lang AS label, count(*) AS target FROM documents GROUP BY lang),
j AS (SELECT label, target, unnest(range(0, target)) AS j FROM t)
SELECT row_number() OVER (ORDER BY (target - j) / target DESC, label DESC) - 1 AS position, label FROM j""",
    "canonical_questions": f"""
WITH {TITLED.replace('titled AS (', 'titled_all AS (')}, titled AS (SELECT * FROM titled_all WHERE length(body) > 0),
{windows('titled', 'body', 'c', keep='title')},
f AS (SELECT *, substr(document_id, 2)::BIGINT AS n, count(*) OVER (PARTITION BY document_id) AS m FROM c),
p AS (SELECT a.n, a.chunk_position AS p, a.n + a.chunk_position AS k, a.title AS title_a, a.chunk_id AS ac, z.title AS title_b,
    z.chunk_id AS bc FROM f a JOIN f z ON z.n = a.n + 1 AND z.chunk_position = a.chunk_position % z.m),
v AS (SELECT *, k % 7 NOT IN (4, 5) AND (k % 10 = 9 OR k % 7 NOT IN (1, 2, 3)) AS once FROM p)
SELECT printf('yq%05d', n) || '-' || p AS query_id,
    sha256(CASE WHEN once THEN {squeeze("title_a || '  ?'")} ELSE {squeeze("title_a || ' again ?'")} END) AS query_digest,
    CASE WHEN k % 10 = 9 THEN 'null_query' ELSE 'comparison_query' END AS question_type,
    CASE WHEN k % 10 = 9 THEN '' ELSE ac || ',' || bc END AS gold FROM v
WHERE {squeeze('title_b')} <> '' AND (once OR k % 3 = 0)""",
    "namespaced_chunks": f"""
WITH {CHUNKS} SELECT d || '::' || chunk_id AS chunk_id, d || '::' || document_id AS document_id, d AS dataset
FROM (SELECT *, CASE WHEN lang = 'en' THEN 'main' ELSE 'other' END AS d FROM chunks)""",
    "namespaced_queries": f"""
WITH {MERGED},
u AS (SELECT query_id, unit, list_sort(list(DISTINCT chunk_id)) AS c FROM units GROUP BY ALL),
g AS (SELECT query_id, list(c ORDER BY unit) AS us FROM u GROUP BY query_id),
a AS (SELECT *, dataset || '::' || query_id AS id, dataset || '::' || d0 AS e0, dataset || '::' || d1 AS e1 FROM allowed)
SELECT q.query_id, q.dataset, question_type, least(e0, e1) || ',' || greatest(e0, e1) AS documents,
    array_to_string(list_transform(us, lambda x: array_to_string(x, '|')), ',') AS units,
    array_to_string(list_sort(list_distinct(flatten(us))), ',') AS gold
FROM queries q JOIN g USING (query_id) JOIN a ON a.id = q.query_id""",
    "question_integrity": f"""
WITH {CHUNKS}, {TWO_HOP}, {BROKEN},
asked AS (SELECT * FROM b WHERE question_type <> 'null_query'),
gd AS (SELECT query_id, unnest(ds) AS document_id FROM asked), gc AS (SELECT query_id, unnest(cs) AS chunk_id FROM asked)
SELECT 'missing_fields' AS rule, count(*) AS n_violations FROM b WHERE answer IS NULL
UNION ALL SELECT 'bad_type', count(*) FROM b WHERE question_type = 'other_query'
UNION ALL SELECT 'null_with_evidence', count(*) FROM b WHERE question_type = 'null_query'
UNION ALL SELECT 'not_two_to_four_documents', count(*) FROM asked WHERE len(list_distinct(ds)) NOT BETWEEN 2 AND 4
UNION ALL SELECT 'unknown_document', count(DISTINCT query_id) FROM gd ANTI JOIN docs USING (document_id)
UNION ALL SELECT 'unknown_chunk', count(DISTINCT query_id) FROM gc ANTI JOIN chunks USING (chunk_id)""",
    "question_histogram": f"""
WITH {DOCS}, {TWO_HOP}, {BROKEN}
SELECT 'type' AS axis, question_type AS value, count(*) AS n_questions FROM b GROUP BY ALL
UNION ALL SELECT 'documents', len(list_distinct(ds))::VARCHAR, count(*) FROM b GROUP BY ALL""",
    "sequence_check": f"SELECT doc_id AS position FROM documents WHERE text <> {squeeze('text')}",
}

# Evidence location, three facts per document (see the catalog).
_LOCATE = f"""
spoken AS (SELECT doc_id, document_id, {said(squeeze('text'))} AS s FROM docs),
base AS (SELECT doc_id, document_id, s[len(s) // 2 + 1] AS middle, s[1] || ' xq' AS changed FROM spoken WHERE len(s) > 0),
wide AS (SELECT printf('q%05d', a.doc_id) AS query_id, a.document_id, a.middle, a.changed, b.middle AS strange
    FROM base a JOIN base b ON b.doc_id = a.doc_id + 1),
needs AS (SELECT query_id, 0::BIGINT AS unit, document_id, middle AS fact FROM wide
    UNION ALL SELECT query_id, 1, document_id, changed FROM wide
    UNION ALL SELECT query_id, 2, document_id, strange FROM wide)"""
_FOUND = f"WITH {CHUNKS}, {_LOCATE}, {hits('needs', 'chunks', 'found')}"
ORACLE |= {
    "locate_fact_exact": f"{_FOUND} SELECT query_id, unit, chunk_id FROM found",
    "alignment_methods": f"""{_FOUND}, f AS (SELECT DISTINCT query_id, unit FROM found)
SELECT CASE WHEN f.query_id IS NULL THEN 'unresolved' ELSE 'exact' END AS method, count(*) AS n_facts
FROM needs LEFT JOIN f USING (query_id, unit) GROUP BY ALL""",
    "unresolved_facts": f"""{_FOUND} SELECT query_id, unit, document_id, sha256(fact) AS digest
FROM needs n ANTI JOIN found USING (query_id, unit)""",
}
