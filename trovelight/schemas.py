"""Declared schemas of every dataset; readers never infer."""

from __future__ import annotations

ARTICLES = "url string, title string, body string"
RAW_QUERIES = (
    "query string, question_type string, evidence_list array<struct<url:string,fact:string>>"
)
CHUNKS = (
    "chunk_id string, document_id string, document_title string, chunk_position int, "
    "n_tokens int, content string"
)
QUERIES = (
    "query_id string, query string, question_type string, required_article_ids array<string>, "
    "n_required_documents int, n_required_evidence_facts int, "
    "evidence_units array<array<string>>, gold_chunk_ids array<string>"
)
UNRESOLVED = "query_id string, evidence_index int, document_id string, fact string"
_FACTS = "array<struct<fact:string,evidence:string,importance:int,distinctiveness:int>>"
_QUESTIONS = (
    "array<struct<question:string,source_fact_ids:array<int>,supporting_chunk_ids:array<string>>>"
)
CHUNK_GENERATIONS = (
    "chunk_id string, n_distinct_facts int, unbounded_budget int, bounded_budget int, "
    f"facts {_FACTS}, bounded_questions {_QUESTIONS}, unbounded_questions {_QUESTIONS}, "
    "generation_skipped boolean"
)
ARTICLE_GENERATIONS = (
    "article_id string, title string, chunk_ids array<string>, n_distinct_article_facts int, "
    f"question_budget int, questions {_QUESTIONS}"
)
VECTOR_FILE = "texts array<string>, vectors array<array<double>>"
VECTORS = "text string, vector array<double>"
CORPUS_DOCUMENTS = (
    "document_id string, title string, author string, source string, published_at string, "
    "date string, date_type string, category string, url string, language string, "
    "tokenizer string, token_count int, body_sha256 string, body string"
)
CORPUS_CHUNKS = (
    "chunk_id string, document_id string, title string, url string, date string, "
    "category string, token_start int, token_end int, token_count int, text string"
)
CRAWL_AUDIT = (
    "url string, title string, category string, last_modified string, token_count int, "
    "character_count int, status string, error string"
)
BENCHMARK_QUESTIONS = (
    "query_id string, query string, answer string, question_type string, "
    "gold_document_ids array<string>, gold_evidence array<string>, gold_chunk_ids array<string>, "
    "evidence_list array<struct<document_id:string,chunk_id:string,title:string,author:string,"
    "url:string,source:string,category:string,published_at:string,date:string,fact:string>>, "
    "generation_split string, generation_seed int"
)
_METRICS = (
    "struct<`evidence_recall@1`:double,`evidence_recall@5`:double,`evidence_recall@10`:double,"
    "`all_evidence_hit@5`:double,`mrr@10`:double>"
)
RANKINGS = f"query_id string, ranked_chunk_ids array<string>, metrics {_METRICS}"
METRICS_FILE = (
    "protocol map<string,string>, conditions array<struct<condition:string,question_rule:string,"
    f"generated_questions:int,stored_vectors:int,metrics:{_METRICS}>>"
)
EVIDENCE = "array<struct<document_id:string,chunk_id:string,fact:string>>"
