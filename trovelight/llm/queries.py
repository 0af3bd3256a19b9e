"""One query per operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight.llm import bpe, conversations, decontaminate, html, jaccard, licenses, packing, pii, quality, resample, shards, tokens, warc
from trovelight.llm.common import shared_folder, table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
SHARD_BYTES = 1 << 20


def rank_file(name: str = RANKS) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), rank_file(), public_tokenizers.PATTERN)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "archives")
    manifest = warc.write(table(spark, folder, "pages"), archives)
    found = warc.read_records(manifest, archives, payloads=False)
    return found.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def _written(spans: Column) -> Column:
    place = F.array(*map(F.lit, pii.KINDS))
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(place, s["kind"]).alias("k"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("t")))
    return F.array_join(F.transform(F.sort_array(order), lambda x: x["t"]), ",")


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "added")).alias("spans"))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(table(spark, folder, "documents"), SHARD_BYTES)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after a load, the same load again, the removal of exact copies, and new counts without repeated lines."""
    docs = table(spark, folder, "documents")
    ledger = tokens.Ledger(spark, shared_folder(spark, "ledger"))
    load = tokens.counts(docs, "words-1").unionByName(tokens.counts(docs, "alnum-2"))
    ledger.commit("1-load", load)
    ledger.commit("1-load", load)
    lines = F.split("text", "\n")
    repeated = docs.filter(F.size(lines) > F.size(F.array_distinct(lines))).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    ledger.commit("2-revise", tokens.counts(repeated, "words-1").unionByName(tokens.counts(repeated, "alnum-2")))
    digest = F.sha2("text", 256)
    first = docs.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = docs.select("doc_id", "source", "lang", digest.alias("digest")).join(first, "digest").filter("doc_id > first")
    gone = copies.select("doc_id", F.explode(F.array(*map(F.lit, tokens.VERSIONS))).alias("version"), "source", "lang", F.lit("delete").alias("op"), F.lit(None).cast("long").alias("tokens"), F.lit(0).alias("seq"))
    ledger.commit("3-delete-copies", gone)
    return ledger.totals()


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), rank_file(WORD_VOCABULARY))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")), copies="copies")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_byte_bpe, op3_decontamination, op4_jaccard_join, op5_warc, op6_pii, op7_licenses, op8_html, op9_sharding, op10_token_counts,
        op11_resampling, op12_packing, op13_conversation_repair, pipeline,
    )
}


def _crc32(source: str) -> str:
    """Common table expressions up to crc(word, crc): the checksums of the strings `word` of the table named, a byte a round."""
    return f"""
crc_table AS (SELECT i::BIGINT AS k, list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(0, 256) r(i)),
crc_step AS (
  SELECT word, hex(encode(word)) AS h, 0 AS i, 4294967295::BIGINT AS c FROM {source}
  UNION ALL SELECT word, h, i + 1, xor(c >> 8, v) FROM crc_step JOIN crc_table ON k = xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) WHERE 2 * i < length(h)
), crc AS (SELECT word, xor(c, 4294967295) AS crc FROM crc_step WHERE 2 * i = length(h))"""


def _edits() -> str:
    """Rows (state, initial that is kept or null, edits, cost, next state, turns inserted, role written or null) of what a row may meet."""
    c, rows = conversations, []
    for x in range(4):
        y, inserted = x, []
        for k in range(3):
            turns = "[" + ", ".join(f"'{r}:'" for r in inserted) + "]::VARCHAR[]"
            rows.append(f"({x}, NULL, '{'I' * k}D', {c.INSERT * k + c.DELETE}, {y}, {turns}, NULL)")
            rows += [f"({x}, '{a}', '{'I' * k}K', {c.INSERT * k + c.KEEP}, {z}, {turns}, NULL)" for a, z in c.NEXT[y].items()]
            rows.append(f"({x}, NULL, '{'I' * k}R', {c.INSERT * k + c.REROLE}, {c.WANTED[y]}, {turns}, '{c.ROLE[c.WANTED[y]]}')")
            y = c.WANTED[y]
            inserted.append(c.ROLE[y])
    return ", ".join(rows)


UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM places),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(l) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < {quality.LEAST_WORDS} AS short, 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS repetitive,
         100 * n_symbols > {quality.MOST_SYMBOLS} * n_words AS symbols, 100 * n_dup_lines > {quality.MOST_DUP_LINES} * n_lines AS dup_lines FROM m
), h AS (
  SELECT source, count(*) AS n, unnest([
    {{'rule': 'short', 'k': count(*) FILTER (short)}}, {{'rule': 'repetitive', 'k': count(*) FILTER (repetitive)}},
    {{'rule': 'symbols', 'k': count(*) FILTER (symbols)}}, {{'rule': 'dup_lines', 'k': count(*) FILTER (dup_lines)}}], recursive := true)
  FROM f WHERE source IS NOT NULL GROUP BY source
), prior AS (SELECT rule, avg(k / n) AS mean, var_pop(k / n) AS var FROM h GROUP BY rule),
weighed AS (SELECT rule, mean, CASE WHEN var > 1e-12 THEN greatest(mean * (1 - mean) / var - 1, {quality.LEAST_WEIGHT}) ELSE {quality.LEAST_WEIGHT} END AS weight FROM prior),
bad AS (SELECT source FROM h JOIN weighed USING (rule) GROUP BY source HAVING max((k + mean * weight) / (n + weight)) > {quality.HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, b.source IS NOT NULL AS host_bad,
       NOT (short OR repetitive) AND b.source IS NULL AS kept
FROM f LEFT JOIN bad b ON f.source = b.source""",
    "op3_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_places AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM item_places),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, places.n, item_id FROM places JOIN win ON places.n = win.n AND array_to_string(w[i:i + places.n - 1], ' ') = g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', hex[i])]), '') AS bits FROM p),
named AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * bits[5 * k + 1]::INT + 8 * bits[5 * k + 2]::INT + 4 * bits[5 * k + 3]::INT + 2 * bits[5 * k + 4]::INT + bits[5 * k + 5]::INT, 1)), '') AS payload_digest FROM bits),
held AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS chosen FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> chosen THEN chosen END AS refers_to FROM held""",
    # What the model must find on pages of this template: the blocks of the article.
    "op8_html": r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:h1|p)>') AS parts FROM pages),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS parts FROM b),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t""",
    "op9_sharding": f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
             ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, 15))::BIGINT AS code FROM documents),
level AS (SELECT doc_id, n_bytes, depth::INT AS depth, code, code >> (60 - depth) AS bucket FROM d, range(0, 33) r(depth)),
sums AS (SELECT doc_id, n_bytes, depth, bucket, sum(n_bytes) OVER p AS total, min(code) OVER p AS low, max(code) OVER p AS high FROM level WINDOW p AS (PARTITION BY depth, bucket)),
first AS (SELECT * FROM sums WHERE total <= {SHARD_BYTES} OR low = high QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth, '0') END AS shard, total::BIGINT AS shard_bytes, total > {SHARD_BYTES} AS oversized FROM first""",
    "op10_token_counts": rf"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents),
lines AS (SELECT doc_id, source, lang, array_to_string(list_distinct(str_split(coalesce(text, ''), chr(10))), chr(10)) AS t FROM d WHERE k = 1),
n AS (SELECT source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS a, len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS b FROM lines)
SELECT source, lang, 'words-1' AS version, count(*) AS n_docs, sum(a)::BIGINT AS n_tokens FROM n GROUP BY ALL
UNION ALL SELECT source, lang, 'alnum-2', count(*), sum(b)::BIGINT FROM n GROUP BY ALL""",
    "op11_resampling": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
words AS (SELECT doc_id, unnest(w) AS word FROM d), target AS (SELECT unnest(w) AS word FROM b),
every AS (SELECT word FROM words UNION SELECT word FROM target),{_crc32("every")},
bucket AS (SELECT word, crc % {resample.BUCKETS} AS k FROM crc),
s AS (SELECT k, count(*) AS n FROM words JOIN bucket USING (word) GROUP BY k), t AS (SELECT k, count(*) AS n FROM target JOIN bucket USING (word) GROUP BY k),
gain AS (SELECT r.k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM words) + {resample.BUCKETS})
  / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM target) + {resample.BUCKETS}))))::BIGINT AS gain FROM range(0, {resample.BUCKETS}) r(k) LEFT JOIN s ON s.k = r.k LEFT JOIN t ON t.k = r.k),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM words JOIN bucket USING (word) JOIN gain USING (k) GROUP BY doc_id),
h AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM d LEFT JOIN weights USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {resample.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT doc_id, rank FROM able WHERE rank <= {resample.PERCENT} * n // 100) USING (doc_id)""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS word FROM conversations),
every AS (SELECT DISTINCT word FROM named),{_crc32("every")},
hurt AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM named JOIN crc USING (word)
), placed AS (
  SELECT *, row_number() OVER c AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER c AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final
  FROM hurt WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), r AS (SELECT *, final = '' AS blank, final <> '' AND again AS duplicate, final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS truncated FROM placed),
figures AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
), edit(x, initial, edits, cost, z, inserted, role) AS (VALUES {_edits()}),
path AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS written FROM figures
  UNION ALL
  SELECT conv_id, i, z, cost, audit, written FROM (
  SELECT p.conv_id, r.i, e.z, p.cost + e.cost + CASE WHEN r.truncated AND right(e.edits, 1) <> 'D' THEN {conversations.TRUNCATED} ELSE 0 END AS cost, p.audit || e.edits AS audit,
         p.written || e.inserted || CASE WHEN right(e.edits, 1) = 'D' THEN [] ELSE [coalesce(e.role, r.role) || ':' || r.text] END AS written
  FROM path p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
  JOIN edit e ON e.x = p.state AND (right(e.edits, 1) = 'D' OR (NOT r.blank AND NOT r.duplicate AND (e.initial IS NULL OR e.initial = r.initial)))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) = 1
), ended AS (
  SELECT conv_id, cost, audit, written FROM (SELECT conv_id, p.cost + {conversations.INSERT} * len(tail) AS cost, audit || repeat('I', len(tail)) AS audit, written || tail AS written
  FROM path p JOIN figures f USING (conv_id) JOIN (VALUES (0, []::VARCHAR[]), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, [])) t(state, tail) ON t.state = p.state
  WHERE p.i = f.n) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(written, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures USING (conv_id) LEFT JOIN ended USING (conv_id)""",
}
