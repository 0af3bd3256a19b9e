"""Queries over the test tables, one or more per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelight import schemas
from trovelight.functions import markup as H
from trovelight.functions import similarity as S
from trovelight.functions import text as T
from trovelight.functions import vectors as X
from trovelight.functions.embedding import HashingEmbedder, attach_vectors, embed, embed_missing
from trovelight.operators import benchmark as Q
from trovelight.operators import corpora as C
from trovelight.operators import enrichment as E
from trovelight.operators import evidence as V
from trovelight.operators import generation as G
from trovelight.operators import grid
from trovelight.operators import integrity as I
from trovelight.operators import lexical as L
from trovelight.operators import metrics as M
from trovelight.operators import selection as P
from trovelight.operators.chunking import sentence_chunks, sliding_chunks
from trovelight.operators.fusion import (
    BASELINE,
    BOTH_BOUNDED,
    BOTH_UNBOUNDED,
    CHUNK_BOUNDED,
    CHUNK_UNBOUNDED,
    LENIENT_UNBOUNDED,
    MERGED,
    STRICT_BOTH,
    STRICT_BOUNDED,
    Condition,
    dense_fusion,
)
from trovelight.plans import study
from trovelight.plans.retrieval import build_index, prepare_queries, retrieve
from trovelight.session import cut_lineage, spread
from trovelight.sources.readers import sitemap_entries

FIVE = (BASELINE, CHUNK_BOUNDED, CHUNK_UNBOUNDED, BOTH_BOUNDED, LENIENT_UNBOUNDED)
VECTORS_ONLY = Condition("Vectors")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


# --- inputs shaped from the tables ------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.format_string("d%07d", "doc_id").alias("document_id"), "text", "lang", "source"
    )


def titled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """First sentence as title, the rest as body."""
    flat = T.collapse_space(F.col("text"))
    parts = documents(spark, folder).withColumn("s", T.sentences(flat))
    rest = F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0)))
    return parts.select(
        "document_id",
        F.element_at("s", 1).alias("title"),
        F.array_join(rest, " ").alias("body"),
        F.concat(
            F.lit("https://site.example/"), "source", F.lit("/"), "lang", F.lit("/"), "document_id"
        ).alias("url"),
        "source",
        F.col("lang").alias("category"),
        F.lit(None).cast("string").alias("date"),
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return sliding_chunks(documents(spark, folder), T.word_tokens(F.col("text")), keep=("lang",))


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.format_string("q%05d", "item_id").alias("query_id"), F.col("text").alias("query")
    )


def _written(docs: DataFrame) -> DataFrame:
    """Documents with any sentence; tested on the raw text, before it is split."""
    return docs.filter(F.col("text").rlike(r"[^\s\p{Z}]"))


def two_hop_queries(spark: SparkSession, folder: str) -> DataFrame:
    """A good document and the one after it: a middle sentence of each is evidence,
    both together are the question."""
    said = F.filter(T.sentences(T.collapse_space(F.col("text"))), lambda s: s != "")
    middle = _written(documents(spark, folder)).withColumn("s", said).select(
        "doc_id",
        "document_id",
        "lang",
        F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("fact"),
    )
    good = table(spark, folder, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    first = middle.join(good, "doc_id", "left_semi")
    second = middle.select(
        (F.col("doc_id") - 1).alias("doc_id"),
        F.col("document_id").alias("next_id"),
        F.col("lang").alias("next_lang"),
        F.col("fact").alias("next_fact"),
    )

    def evidence(url: str, fact: str):
        return F.struct(F.col(url).alias("url"), F.col(fact).alias("fact"))

    return first.join(second, "doc_id").select(
        T.query_ordinal_id(F.col("doc_id")).alias("query_id"),
        F.concat_ws(" ", "fact", "next_fact").alias("query"),
        F.when(F.col("lang") == F.col("next_lang"), "comparison_query")
        .otherwise("inference_query")
        .alias("question_type"),
        F.array(evidence("document_id", "fact"), evidence("next_id", "next_fact")).alias(
            "evidence_list"
        ),
        "lang",
        "next_lang",
    )


def aligned(spark: SparkSession, folder: str):
    """Evaluation queries, their evidence units and the chunks."""
    pieces = cut_lineage(chunks(spark, folder))
    queries, units = study.evaluation_set(cut_lineage(two_hop_queries(spark, folder)), pieces, fuzzy=False)
    return queries, units, pieces


def by_language(spark: SparkSession, folder: str, raw: DataFrame | None = None):
    """Two datasets for the merged study: English, and every other language. `raw`: the two-hop queries, if stored already."""
    pieces = cut_lineage(chunks(spark, folder))
    raw = cut_lineage(two_hop_queries(spark, folder)) if raw is None else raw
    english = F.col("lang") == "en"
    same = (F.col("lang") == "en") == (F.col("next_lang") == "en")
    parts = {}
    for name, keep in (("main", english), ("other", ~english)):
        own = pieces.filter(keep)
        queries, units = study.evaluation_set(raw.filter(keep & same), own, fuzzy=False)
        parts[name] = (queries, units, own)
    return parts


def facts_to_locate(spark: SparkSession, folder: str) -> DataFrame:
    """Three facts per document: its middle sentence, its first sentence with the
    last word changed, and the middle sentence of the following document."""
    said = F.filter(T.sentences(T.collapse_space(F.col("text"))), lambda s: s != "")
    base = _written(documents(spark, folder)).withColumn("s", said).select(
        "doc_id",
        "document_id",
        F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("middle"),
        F.concat(F.element_at("s", 1), F.lit(" xq")).alias("changed"),
    )
    after = base.select((F.col("doc_id") - 1).alias("doc_id"), F.col("middle").alias("foreign"))
    listed = F.array("middle", "changed", "foreign")
    return (
        base.join(after, "doc_id")
        .select(
            T.query_ordinal_id(F.col("doc_id")).alias("query_id"),
            "document_id",
            F.posexplode(listed).alias("unit", "fact"),
        )
    )


def question_rows(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as generated questions of a conversation."""
    return table(spark, folder, "conversations").filter("role = 'user'")


# --- text -------------------------------------------------------------------------------------


def _token_summary(spark, folder, tokenize) -> DataFrame:
    rows = documents(spark, folder).select("doc_id", tokenize(F.col("text")).alias("t"))
    return rows.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        F.try_element_at("t", F.lit(1)).alias("first_token"),
        F.sha2(F.array_join("t", " "), 256).alias("digest"),
    )


def tokenize_ascii(spark, folder):
    return _token_summary(spark, folder, T.tokenize_ascii)


def tokenize_unicode(spark, folder):
    return _token_summary(spark, folder, T.tokenize_unicode)


def normalize_text(spark, folder):
    text = F.col("text")
    return documents(spark, folder).select(
        "doc_id",
        F.sha2(T.norm(text), 256).alias("folded"),
        F.sha2(T.norm_lower(text), 256).alias("lowered"),
        F.sha2(T.normalize(text), 256).alias("words"),
    )


def sentence_split(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")
    ).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("s").cast("long").alias("n_chars"))


def rare_terms(spark, folder):
    return documents(spark, folder).select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))


def url_category(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.category_for(F.col("url")).alias("category"))


def sitemap_urls(spark, folder):
    """Each page as an entry of a one-page sitemap, read back from the markup."""
    payload = F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '),
        "url",
        F.lit(" </loc><lastmod>2024-01-"),
        F.format_string("%02d", F.col("page_id") % 28 + 1),
        F.lit("</lastmod></url><url><loc> </loc></url></urlset>"),
    )
    return table(spark, folder, "pages").select(
        "page_id", F.inline(sitemap_entries(payload))
    )


def json_salvage(spark, folder):
    """Replies around each turn's record: bare, fenced after reasoning, in chatter, cut off."""
    record = F.to_json(F.struct("conv_id", "turn", F.col("role").alias("who")))
    kind = F.col("turn") % 4
    reply = (
        F.when(kind == 0, record)
        .when(kind == 1, F.concat(F.lit("<think>{no}</think>```json\n"), record, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here: "), record, F.lit(" done")))
        .otherwise(F.substr(record, F.lit(1), F.length(record) - 1))
    )
    parsed = T.salvage_json(reply, "conv_id long, turn long, who string")
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        parsed.isNotNull().alias("ok"),
        F.coalesce(parsed["conv_id"], F.lit(-1)).alias("parsed_conv"),
        F.coalesce(parsed["who"], F.lit("none")).alias("parsed_who"),
    )


def html_articles(spark, folder):
    """Title and clean body of every page; these pages have no <main>."""
    pages = table(spark, folder, "pages").withColumn("a", H.extract_article(None)("html"))
    title = F.when(F.col("a.title") != "", F.col("a.title")).otherwise(
        H.fallback_title(F.col("html"), F.col("url"))
    )
    cleaned = pages.withColumn("title", title).withColumn("body", H.clean_text(F.col("a.raw")))
    body = T.drop_leading_title(F.col("title"), F.col("body"))
    return cleaned.select("page_id", "title", F.length(body).alias("n_chars"), T.body_digest(body).alias("digest"))


def page_titles(spark, folder):
    """Fallback title of every page from its markup, and the one that its address alone gives."""
    plain = H.fallback_title(F.lit(""), F.col("url"))
    marked = H.fallback_title(F.coalesce("html", F.lit("")), F.col("url"))
    return table(spark, folder, "pages").select("page_id", plain.alias("from_url"), marked.alias("title"))


# --- corpus -----------------------------------------------------------------------------------


def _audited(spark, folder) -> DataFrame:
    body = T.collapse_space(F.col("text"))
    pages = documents(spark, folder).select(
        F.col("doc_id").alias("ordinal"),
        F.concat(
            F.lit("https://site.example/"), "source", F.lit("/"), "lang", F.lit("/"), "document_id"
        ).alias("url"),
        body.alias("body"),
        F.size(T.word_tokens(F.col("text"))).alias("token_count"),
    )
    return pages.select(
        "*",
        T.category_for(F.col("url")).alias("category"),
        T.body_digest(F.col("body")).alias("digest"),
        P.length_status(F.col("token_count"), 50, 800).alias("status"),
    )


def body_hash_dedup(spark, folder):
    return P.mark_duplicates(_audited(spark, folder)).select(
        F.col("ordinal").alias("doc_id"), "status"
    )


def token_range_status(spark, folder):
    return (
        _audited(spark, folder)
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("token_count").cast("long").alias("min_tokens"),
            F.max("token_count").cast("long").alias("max_tokens"),
            F.round(F.avg("token_count"), 2).alias("mean_tokens"),
        )
    )


def priority_selection(spark, folder):
    """Every document's final status and, if selected, its id in inventory order."""
    pages = cut_lineage(P.mark_duplicates(_audited(spark, folder)))
    chosen = cut_lineage(P.select_by_priority(pages, ("de", "fr", "en"), preferred=250))
    named = P.restore_order(chosen, pages.select("url", "ordinal"))
    return (
        P.mark_unselected(pages, chosen)
        .join(named.select("url", "document_id"), "url", "left")
        .select(F.col("ordinal").alias("doc_id"), "status", "document_id")
    )


def corpus_statistics(spark, folder):
    kept = P.mark_duplicates(_audited(spark, folder)).filter(F.col("status") == P.ELIGIBLE)
    s = P.corpus_summary(kept)
    return s.select([F.col(c).cast("double" if "mean" in c else "long").alias(c) for c in s.columns])


def sliding_windows(spark, folder):
    return chunks(spark, folder).select(
        "chunk_id",
        "document_id",
        F.col("token_start").cast("long").alias("token_start"),
        F.col("token_end").cast("long").alias("token_end"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.sha2("content", 256).alias("digest"),
    )


def sentence_windows(spark, folder):
    packed = sentence_chunks(documents(spark, folder), body="text", size=256, overlap=32)
    numbers = [F.col(c).cast("long").alias(c) for c in ("chunk_position", "n_tokens")]
    return packed.select("chunk_id", "document_id", *numbers, F.sha2("content", 256).alias("digest"))


def integrity_report(spark, folder):
    """Rules over the unfiltered documents, so that several are broken."""
    docs = titled_documents(spark, folder).select(
        "document_id",
        "url",
        "body",
        F.sha2("body", 256).alias("body_sha256"),
        F.size(T.word_tokens(F.col("body"))).alias("token_count"),
    )
    pieces = sliding_chunks(docs, T.word_tokens(F.col("body")), size=256, overlap=32)
    pieces = pieces.select("chunk_id", "document_id", F.col("n_tokens").alias("token_count"))
    return I.corpus_violations(cut_lineage(docs), cut_lineage(pieces), 100, 800)


def benchmark_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with gold ids, some of them broken in one way or several."""
    n = F.substr("query_id", F.lit(2)).cast("long")
    first, second = F.col("evidence_list")[0], F.col("evidence_list")[1]
    one, two = first["url"], second["url"]
    last = F.when(n % 4 == 3, "::c99999").otherwise("::c00")
    return two_hop_queries(spark, folder).select(
        "query_id",
        "query",
        F.when(n % 5 == 1, "other_query").when(n % 7 == 2, "null_query").otherwise(F.col("question_type")).alias("question_type"),
        F.when(n % 11 != 3, second["fact"]).alias("answer"),
        F.when(n % 13 == 4, F.array(one, one)).when(n % 3 == 1, F.array(one, F.concat(two, F.lit("x")))).otherwise(F.array(one, two)).alias("gold_document_ids"),
        F.col("evidence_list.fact").alias("gold_evidence"),
        F.array(F.concat(one, F.lit("::c00")), F.concat(two, last)).alias("gold_chunk_ids"),
        "evidence_list",
    )


def question_integrity(spark, folder):
    questions = cut_lineage(benchmark_questions(spark, folder))
    return I.question_violations(questions, documents(spark, folder), chunks(spark, folder))


def question_histogram(spark, folder):
    return I.question_histogram(benchmark_questions(spark, folder))


# --- ranking ----------------------------------------------------------------------------------


def _tokenised(spark, folder) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", T.tokenize_unicode(F.col("content")).alias("tokens"))


def posting_lists(spark, folder):
    found = L.postings(_tokenised(spark, folder))
    return found.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("tf").alias("n_occurrences"), F.max("tf").alias("max_tf")
    )


def bm25_idf(spark, folder):
    tokens = cut_lineage(_tokenised(spark, folder))
    idf = L.okapi_idf(L.document_frequency(tokens), L.corpus_stats(tokens))
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_top10(spark, folder):
    index = build_index(chunks(spark, folder), ())
    queries = prepare_queries(benchmark_queries(spark, folder), index)
    return grid.top_by_list(queries, index.items, (), embedder=index.embedder).select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")
    )


def _embeddings(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.format_string("v%07d", "vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("string").alias("owner"),
    )


def unit_vectors(spark, folder):
    found = table(spark, folder, "embeddings").select("vec_id", X.unit(F.col("embedding")).alias("u"), "embedding")
    return found.select(
        "vec_id",
        F.round(F.element_at("u", 1), 6).alias("first"),
        F.round(F.element_at("u", -1), 6).alias("last"),
        F.round(X.length(F.col("embedding")), 6).alias("length"),
        F.round(X.cosine(F.col("u"), F.col("embedding")), 6).alias("self_cosine"),
    )


def dense_top10(spark, folder):
    base = _embeddings(spark, folder)
    no_terms = F.array().cast("array<struct<term:string,weight:double>>")
    queries = base.select(F.col("id").alias("query_id"), "vector", no_terms.alias("weights"))
    items = base.select(
        F.lit("chunk").alias("pool"),
        F.col("id").alias("unit"),
        F.col("id").alias("chunk_id"),
        F.col("id").alias("document_id"),
        "vector",
        F.array().cast("array<string>").alias("tokens"),
        F.lit(1.0).alias("norm"),
    )
    found = grid.top_by_list(queries, items, (VECTORS_ONLY,))
    return found.filter(F.col("list") == VECTORS_ONLY.name).select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")
    )


def _best_per_owner(spark, folder) -> DataFrame:
    base = _embeddings(spark, folder)
    return grid.owner_max(
        base.withColumnRenamed("id", "query_id"), base.withColumnRenamed("id", "item_id")
    )


def owner_max(spark, folder):
    return _best_per_owner(spark, folder).select("query_id", "owner", F.round("best", 6).alias("best"))


def fusion_rules(spark, folder):
    """Every condition's fused score from three signals, two of them missing at times:
    the best similarity to owners 0, 1 and 2, absent for the vector's own owner."""
    best = _best_per_owner(spark, folder).join(
        _embeddings(spark, folder).select(F.col("id").alias("query_id"), F.col("owner").alias("own")),
        "query_id",
    )

    def signal(owner: str, always: bool = False):
        present = (F.col("owner") == owner) & (F.lit(always) | (F.col("own") != owner))
        return F.max(F.when(present, F.col("best")))

    rows = best.groupBy("query_id").agg(
        signal("0", True).alias("c"), signal("1").alias("q"), signal("2").alias("a")
    )
    rules = [("union: " + MERGED[-1].name, MERGED[-1]), *[(c.name, c) for c in FIVE]]
    scores = [
        F.struct(F.lit(n).alias("condition"), F.round(dense_fusion(c, F.col("c"), F.col("q"), F.col("a")), 6).alias("score"))
        for n, c in rules
    ]
    return rows.select("query_id", F.inline(F.array(*scores)))


def strict_fusion(spark, folder):
    """Scores of the rules that take a missing signal for an error, where all signals are present."""
    best = _best_per_owner(spark, folder).groupBy("query_id").pivot("owner", ["0", "1", "2"]).agg(F.max("best"))
    full = best.toDF("query_id", "c", "q", "a").filter(F.col("c").isNotNull() & F.col("q").isNotNull() & F.col("a").isNotNull())
    scores = [
        F.struct(F.lit(c.name).alias("condition"), F.round(dense_fusion(c, F.col("c"), F.col("q"), F.col("a")), 6).alias("score"))
        for c in (STRICT_BOUNDED, STRICT_BOTH, BOTH_UNBOUNDED)
    ]
    return full.select("query_id", F.inline(F.array(*scores)))


def _shown(rankings: DataFrame) -> DataFrame:
    return rankings.select(
        "query_id",
        "condition",
        F.col("rank").cast("long").alias("rank"),
        "chunk_id",
        F.round("score", 9).alias("score"),
    )


def rrf_top10(spark, folder):
    return _shown(retrieve(benchmark_queries(spark, folder), chunks(spark, folder), (BASELINE,)))


def conditions_top10(spark, folder):
    return _shown(retrieve(benchmark_queries(spark, folder), chunks(spark, folder), FIVE))


# --- evidence and metrics ---------------------------------------------------------------------


def locate_fact_exact(spark, folder):
    found = V.exact_hits(facts_to_locate(spark, folder), chunks(spark, folder))
    return found.select("query_id", F.col("unit").cast("long").alias("unit"), "chunk_id")


def alignment_methods(spark, folder):
    """Fact counts with exact matching only, as SQL can follow that far."""
    located = V.locate_facts(facts_to_locate(spark, folder), chunks(spark, folder), fuzzy=False)
    return V.method_counts(located)


def locate_fact_fuzzy(spark, folder):
    located = V.locate_facts(facts_to_locate(spark, folder), chunks(spark, folder))
    return located.filter(F.col("method") != "exact").select("query_id", F.col("unit").cast("long").alias("unit"), "chunk_id", "method")


def unresolved_facts(spark, folder):
    facts = facts_to_locate(spark, folder)
    located = V.locate_facts(facts, chunks(spark, folder), fuzzy=False)
    return V.unresolved_facts(facts, located).select(
        "query_id", F.col("unit").cast("long").alias("unit"), "document_id", F.sha2("fact", 256).alias("digest")
    )


def evaluation_queries(spark, folder):
    """The nested query table of the news study."""
    raw = two_hop_queries(spark, folder)
    queries, units, _ = aligned(spark, folder)
    records = V.query_records(queries, V.evidence_facts(raw), units)
    return records.select(
        "query_id",
        "question_type",
        F.array_join("required_article_ids", ",").alias("documents"),
        F.col("n_required_documents").cast("long").alias("n_documents"),
        F.col("n_required_evidence_facts").cast("long").alias("n_facts"),
        F.array_join(F.transform("evidence_units", lambda u: F.array_join(u, "|")), ",").alias("units"),
        F.array_join("gold_chunk_ids", ",").alias("gold"),
    )


def corpus_queries(spark, folder):
    """Queries whose evidence lies in the English part of the corpus."""
    english = documents(spark, folder).filter("lang = 'en'").select(F.col("document_id").alias("url"))
    return V.within_corpus(two_hop_queries(spark, folder), english).select("query_id", "question_type")


def _rounded(rows: DataFrame, names=M.METRICS) -> DataFrame:
    """Metrics at six decimals, under names without symbols."""
    keys = [c for c in rows.columns if c not in names]
    plain = {m: m.replace("@", "_at_") for m in names}
    return rows.select(*keys, *[F.round(F.col(f"`{m}`"), 6).alias(p) for m, p in plain.items()])


def evidence_metrics(spark, folder):
    queries, units, pieces = aligned(spark, folder)
    _, metrics = study.run_conditions(queries, units, pieces, FIVE)
    return _rounded(metrics)


def condition_means(spark, folder):
    queries, units, pieces = aligned(spark, folder)
    _, metrics = study.run_conditions(queries, units, pieces, FIVE)
    return _rounded(M.means(metrics, "condition"))


def baseline_deltas(spark, folder):
    queries, units, pieces = aligned(spark, folder)
    _, metrics = study.run_conditions(queries, units, pieces, FIVE)
    return study.baseline_deltas(metrics, FIVE).select(
        "condition",
        "position",
        F.replace("metric", F.lit("@"), F.lit("_at_")).alias("metric"),
        *[F.round(c, 6).alias(c) for c in ("value", "baseline", "delta")],
        F.round("relative_percent", 3).alias("relative_percent"),
    )


def merged_means(spark, folder):
    means, _ = study.merged_study(by_language(spark, folder))
    return _rounded(means)


def wrong_corpus_rate(spark, folder):
    _, wrong = study.merged_study(by_language(spark, folder))
    return wrong.select("condition", "dataset", F.round("wrong_corpus_top1", 6).alias("wrong_corpus_top1"))


def interference(spark, folder):
    found = study.interference_study(by_language(spark, folder))
    return found.select(
        "dataset",
        "condition",
        "position",
        F.replace("metric", F.lit("@"), F.lit("_at_")).alias("metric"),
        *[F.round(c, 6).alias(c) for c in ("alone", "merged", "delta")],
        "direction",
    )


# --- enrichment -------------------------------------------------------------------------------


def _facts(spark, folder) -> DataFrame:
    unit = E.placement_unit(F.col("document_id"), F.col("chunk_position"))
    return E.sentence_facts(chunks(spark, folder).withColumn("unit", unit))


def question_budget(spark, folder):
    n = F.size("facts")
    return _facts(spark, folder).select(
        "chunk_id",
        n.cast("long").alias("n_facts"),
        E.bounded_budget(n).cast("long").alias("bounded"),
        E.unbounded_budget(n).cast("long").alias("unbounded"),
    )


def document_fact_union(spark, folder):
    found = E.document_facts(cut_lineage(_facts(spark, folder)))
    return found.select(
        "document_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("n_ordinal").cast("long").alias("n_facts"),
        F.sha2("fact", 256).alias("digest"),
    )


def chunk_question_pools(spark, folder):
    facts = cut_lineage(_facts(spark, folder))
    n = F.size("facts")
    bounded = E.chunk_questions(facts, E.bounded_budget(n), "bounded")
    free = E.chunk_questions(facts, E.unbounded_budget(n), "unbounded")
    return bounded.unionByName(free).select(
        "pool", "chunk_id", F.col("number").cast("long").alias("number"), F.sha2("text", 256).alias("digest")
    )


def enrichment_quality(spark, folder):
    budgets = cut_lineage(question_budget(spark, folder))
    long = budgets.unpivot("chunk_id", ["bounded", "unbounded"], "pool", "n_questions")
    q = E.pool_quality(long, "pool")
    return q.select("pool", *[F.round(c, 6).alias(c) if "mean" in c else F.col(c) for c in q.columns if c != "pool"])


def question_dedup(spark, folder):
    turns = question_rows(spark, folder).select(
        F.format_string("%06d-%03d", "conv_id", "turn").alias("query_id"), F.col("text").alias("query")
    )
    return Q.deduplicate_questions(turns).select("query_id", "is_first")


def near_duplicate_facts(spark, folder):
    """Positions of each document's sentences that survive the near-duplicate pass."""
    said = F.filter(T.sentences(T.collapse_space(F.col("text"))), lambda s: s != "")
    keys = documents(spark, folder).select("doc_id", F.transform(said, T.normalize).alias("keys"))
    kept = S.keep_fresh(S.FACT_DUPLICATE)("keys")
    return keys.select("doc_id", F.size("keys").alias("n_sentences"), kept.alias("kept")).select(
        "doc_id", "n_sentences", F.size("kept").alias("n_kept"), F.array_join("kept", ",").alias("kept")
    )


def near_duplicate_questions(spark, folder):
    """The same within each chunk, at the first-attempt question limit."""
    keys = _facts(spark, folder).select("chunk_id", F.col("facts.key").alias("keys"))
    kept = S.keep_fresh(S.QUESTION_DUPLICATE)("keys")
    return keys.select("chunk_id", F.size("keys").alias("n_questions"), F.array_join(kept, ",").alias("kept"))


def resume_todo(spark, folder):
    """Chunks of documents without a label stand for work left by a checkpoint."""
    labelled = table(spark, folder, "labels").select(F.format_string("d%07d", "doc_id").alias("document_id"))
    pieces = chunks(spark, folder).withColumn("document_title", F.col("lang"))
    done = pieces.join(labelled, "document_id", "left_semi").select("chunk_id")
    return E.skip_manifest(pieces, done)


def default_generations(spark, folder):
    """All chunks, those of unlabelled documents with an empty generation."""
    labelled = table(spark, folder, "labels").select(F.format_string("d%07d", "doc_id").alias("document_id"))
    facts = cut_lineage(_facts(spark, folder))
    made = facts.join(labelled, "document_id", "left_semi").select(
        "chunk_id", F.size("facts").alias("n_distinct_facts"), "facts"
    )
    full = E.with_default_generation(facts.select("chunk_id", "document_id"), made)
    return full.select(
        "chunk_id",
        F.col("n_distinct_facts").cast("long").alias("n_distinct_facts"),
        F.size("facts").cast("long").alias("n_listed"),
        "generation_skipped",
    )


def cache_reuse(spark, folder):
    """Generations of a corpus of good documents, carried over to the whole corpus by
    place and content; the old corpus numbers its chunks differently."""
    facts = cut_lineage(_facts(spark, folder))
    good = table(spark, folder, "labels").filter("quality = 1").select(
        F.format_string("d%07d", "doc_id").alias("document_id")
    )
    old = facts.join(good, "document_id", "left_semi").withColumn("old", F.concat(F.lit("old-"), "chunk_id"))
    questions = F.transform(
        "facts",
        lambda f: F.struct(
            f["fact"].alias("question"),
            F.array(F.lit(0)).alias("source_fact_ids"),
            F.array(F.col("old")).alias("supporting_chunk_ids"),
        ),
    )
    made = old.select(
        F.col("old").alias("chunk_id"), questions.alias("bounded_questions"), questions.alias("unbounded_questions")
    )
    listed = old.select(
        F.col("old").alias("chunk_id"), "document_id", "chunk_position", "content", F.lit(1).alias("row_number")
    )
    carried = E.reuse_generations(facts, listed, made)
    flat = E.flatten_questions(carried, "bounded_questions")
    owners = carried.select("chunk_id", F.explode("bounded_questions.supporting_chunk_ids").alias("s"))
    return flat.groupBy("owner").agg(F.count(F.lit(1)).alias("n_questions")).join(
        owners.groupBy(F.col("chunk_id").alias("owner")).agg(F.max(F.element_at("s", 1)).alias("supports")), "owner"
    )


def embed_offline(spark, folder):
    """Hashed vectors of all chunks, one row per non-zero dimension."""
    rows = chunks(spark, folder).select(
        "chunk_id", F.posexplode(embed("content", HashingEmbedder())).alias("dim", "value")
    )
    return rows.filter("value <> 0").select("chunk_id", F.col("dim").cast("long").alias("dim"), "value")


def embed_resume(spark, folder):
    """Vectors for user turns: those of labelled conversations are cached already."""
    turns = question_rows(spark, folder).select("conv_id", "turn", "text")
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("conv_id"))
    known = turns.join(labelled, "conv_id", "left_semi").select("text").distinct()
    cache = cut_lineage(known.select("text", embed("text", HashingEmbedder()).alias("vector")))
    fresh = cut_lineage(embed_missing(turns, cache, HashingEmbedder()))
    full = attach_vectors(turns, cache.unionByName(fresh))
    return full.select(
        "conv_id", "turn", F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x).alias("squared_length")
    )


def _digest(questions: str):
    return F.sha2(F.array_join(F.transform(questions, lambda q: q["question"]), "\n"), 256)


def generate_offline(spark, folder):
    """Generation records of all chunks through the staged retry protocol, repeats told by their keys."""
    made = G.generate_chunks(chunks(spark, folder), G.SentenceGenerator(), near=False)
    return made.select(
        "chunk_id",
        "n_distinct_facts",
        "bounded_budget",
        "unbounded_budget",
        F.size("bounded_questions").alias("n_bounded"),
        F.size("unbounded_questions").alias("n_unbounded"),
        _digest("bounded_questions").alias("bounded_digest"),
        _digest("unbounded_questions").alias("unbounded_digest"),
        "error",
    )


def _generated_documents(spark, folder, bounded):
    """Generation records of all documents, from the union of their chunks' facts."""
    pieces = chunks(spark, folder)
    # Keys are made again from the stored sentences, and a fact quotes itself once it has met its document.
    said = cut_lineage(E.sentence_facts(pieces).select("document_id", "chunk_position", F.col("facts.fact").alias("said")), codec="zstd")
    keyed = F.transform("said", lambda s: F.struct(s.alias("fact"), T.normalize(s).alias("key")))
    facts = E.document_facts(said.select("document_id", "chunk_position", keyed.alias("facts")))
    facts = cut_lineage(facts.select("document_id", "ordinal", "fact"), codec="zstd")  # drops its shuffles before the next ones
    listed = facts.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "fact"))).alias("listed"))
    one = F.lit(1)
    stated = F.transform("listed", lambda x: F.struct(x["fact"].alias("fact"), x["fact"].alias("evidence"), one.alias("importance"), one.alias("distinctiveness")))
    owned = pieces.groupBy("document_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    texts = documents(spark, folder).select("document_id", F.col("lang").alias("title"), F.col("text").alias("content"))
    todo = texts.join(owned, "document_id").join(listed, "document_id", "left").withColumn("facts", stated).drop("listed").withColumnRenamed("document_id", "article_id")
    made = G.generate_articles(todo, G.SentenceGenerator(), bounded, near=False)
    return made.select(
        F.col("article_id").alias("document_id"),
        F.size("chunk_ids").alias("n_chunks"),
        F.col("n_distinct_article_facts").alias("n_facts"),
        "question_budget",
        F.size("questions").alias("n_questions"),
        _digest("questions").alias("digest"),
        F.col("error").isNotNull().alias("failed"),
    )


def generate_documents(spark, folder):
    return _generated_documents(spark, folder, True)


def generate_documents_unbounded(spark, folder):
    return _generated_documents(spark, folder, False)


# --- benchmark construction -------------------------------------------------------------------


def neighbors(spark, folder):
    found = Q.neighbors(cut_lineage(titled_documents(spark, folder)), 10)
    return found.select(
        "document_id",
        "neighbor",
        F.col("rank").cast("long").alias("rank"),
        F.round("score", 6).alias("score"),
        "n_related",
    )


def best_excerpt(spark, folder):
    """Per document, bundled with the following one, the chunk closest to both titles."""
    docs = cut_lineage(titled_documents(spark, folder))
    pieces = sliding_chunks(docs, T.word_tokens(F.col("body")), size=128, overlap=16)
    number = F.substr("document_id", F.lit(2)).cast("long")
    numbered = docs.select("document_id", number.alias("n"))
    after = numbered.select((F.col("n") - 1).alias("n"), F.col("document_id").alias("next_id"))
    bundles = numbered.join(after, "n").select(
        T.query_ordinal_id(F.col("n")).alias("query_id"),
        F.posexplode(F.array("document_id", "next_id")).alias("place", "document_id"),
    )
    found = Q.best_excerpts(bundles, docs, pieces)
    return found.select(
        "query_id", "document_id", "chunk_id", F.col("shared").cast("long").alias("shared")
    )


def balanced_sequence(spark, folder):
    """Languages interleaved in proportion to their document counts."""
    targets = documents(spark, folder).groupBy(F.col("lang").alias("label")).agg(
        F.count(F.lit(1)).alias("target")
    )
    return Q.balanced_sequence(cut_lineage(targets))


def question_specs(spark, folder):
    specs = Q.question_specs(cut_lineage(titled_documents(spark, folder)))
    return specs.withColumn("place", F.col("place").cast("long"))


def canonical_questions(spark, folder):
    """Answers built from bundles of two chunks, some of them broken in one way each and some asked twice.

    Every chunk is bundled with one of the following document's, whose chunks are
    taken in turn; the chunks' middle sentences are the evidence.
    """
    docs = cut_lineage(titled_documents(spark, folder).filter(F.length("body") > 0))
    pieces = sliding_chunks(docs, T.word_tokens(F.col("body")), keep=("title", "url", "source", "category", "date"))
    entry = F.struct(
        "document_id", "chunk_id", "title", "url", "source", "category", "date", F.col("content").alias("text")
    )
    listed = cut_lineage(pieces.select(F.substr("document_id", F.lit(2)).cast("long").alias("n"), F.col("chunk_position").alias("p"), entry.alias("e")))
    n_chunks = listed.groupBy((F.col("n") - 1).alias("n")).agg(F.count(F.lit(1)).alias("m"))
    one = listed.join(n_chunks, "n").select("n", "p", (F.col("p") % F.col("m")).alias("turn"), F.col("e").alias("a"))
    two = listed.select((F.col("n") - 1).alias("n"), F.col("p").alias("turn"), F.col("e").alias("b"))
    pairs = cut_lineage(one.join(two, ["n", "turn"]).withColumn("k", F.col("n") + F.col("p")))
    query_id = F.concat_ws("-", T.query_ordinal_id(F.col("n"), "yq"), "p")
    kind = F.when(F.col("k") % 10 == 9, "null_query").otherwise("comparison_query")
    specs = pairs.select(query_id.alias("query_id"), kind.alias("question_type"), F.array("a", "b").alias("documents"))

    def quote(side: str):
        spoken = F.filter(T.sentences(F.col(side)["text"]), lambda x: x != "")
        return F.struct(
            F.col(side)["document_id"].alias("document_id"),
            F.col(side)["chunk_id"].alias("chunk_id"),
            F.element_at(spoken, (F.floor(F.size(spoken) / 2) + 1).cast("int")).alias("fact"),
        )

    wrong = F.struct(
        F.col("b.document_id").alias("document_id"),
        F.col("b.chunk_id").alias("chunk_id"),
        F.lit("never stated anywhere").alias("fact"),
    )
    fault = F.col("k") % 7
    sound = F.array(quote("a"), quote("b")).cast(schemas.EVIDENCE)
    evidence = (
        F.when(fault == 1, F.array(quote("a")))
        .when(fault == 2, F.array(quote("a"), quote("a")))
        .when(fault == 3, F.array(quote("a"), wrong))
        .otherwise(F.array(quote("a"), quote("b")))
        .cast(schemas.EVIDENCE)
    )
    first = pairs.select(
        query_id.alias("query_id"),
        F.when(fault == 4, "temporal_query").otherwise(kind).alias("question_type"),
        F.when(fault == 5, "  ").otherwise(F.concat(F.col("a.title"), F.lit("  ?"))).alias("query"),
        F.col("b.title").alias("answer"),
        F.lit(1).alias("attempt"),
        evidence.alias("evidence"),
    )
    second = pairs.filter("k % 3 = 0").select(
        query_id.alias("query_id"),
        kind.alias("question_type"),
        F.concat(F.col("a.title"), F.lit(" again ?")).alias("query"),
        F.col("b.title").alias("answer"),
        F.lit(2).alias("attempt"),
        sound.alias("evidence"),
    )
    kept = Q.canonical_questions(first.unionByName(second), specs)
    return kept.select(
        "query_id",
        F.sha2("query", 256).alias("query_digest"),
        "question_type",
        F.array_join("gold_chunk_ids", ",").alias("gold"),
    )


# --- merging ----------------------------------------------------------------------------------


def namespaced_chunks(spark, folder):
    pieces = chunks(spark, folder)
    english = F.col("lang") == "en"
    merged = C.union_corpora({"main": pieces.filter(english), "other": pieces.filter(~english)}, C.namespace_chunks)
    return merged.select("chunk_id", "document_id", "dataset")


def namespaced_queries(spark, folder):
    """The nested query tables of two corpora under one namespace."""
    raw = cut_lineage(two_hop_queries(spark, folder))
    facts = V.evidence_facts(raw)
    parts = {name: V.query_records(queries, facts, units) for name, (queries, units, _) in by_language(spark, folder, raw).items()}
    merged = C.union_corpora(parts, C.namespace_queries)
    return merged.select(
        "query_id",
        "dataset",
        "question_type",
        F.array_join("required_article_ids", ",").alias("documents"),
        F.array_join(F.transform("evidence_units", lambda u: F.array_join(u, "|")), ",").alias("units"),
        F.array_join("gold_chunk_ids", ",").alias("gold"),
    )


def sequence_check(spark, folder):
    """Positions at which the raw and the cleaned document sequence differ."""
    docs = documents(spark, folder)
    expected = docs.select(F.col("doc_id").alias("position"), "text")
    actual = docs.select(F.col("doc_id").alias("position"), T.collapse_space(F.col("text")).alias("text"))
    return C.order_mismatches(expected, actual).select("position")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_ascii, tokenize_unicode, normalize_text, sentence_split, rare_terms, url_category,
        sitemap_urls, json_salvage, html_articles, page_titles, body_hash_dedup, token_range_status,
        priority_selection, corpus_statistics, sliding_windows, sentence_windows, integrity_report,
        question_integrity, question_histogram, strict_fusion, namespaced_queries,
        posting_lists, bm25_idf, bm25_top10, unit_vectors, dense_top10, owner_max, fusion_rules,
        rrf_top10, conditions_top10, locate_fact_exact, alignment_methods, locate_fact_fuzzy,
        unresolved_facts, evaluation_queries, corpus_queries, evidence_metrics, condition_means,
        baseline_deltas, merged_means, wrong_corpus_rate, interference, question_budget,
        document_fact_union, chunk_question_pools, enrichment_quality, question_dedup,
        near_duplicate_facts, near_duplicate_questions, resume_todo, default_generations, cache_reuse,
        embed_offline, embed_resume, generate_offline, generate_documents, generate_documents_unbounded, neighbors, best_excerpt, balanced_sequence,
        question_specs, canonical_questions, namespaced_chunks, sequence_check,
    )
}
