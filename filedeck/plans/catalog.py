"""The registered queries over the reference's own operators. Each goes over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filedeck.functions import tables as tb
from filedeck.functions import text as tx
from filedeck.operators import chunking, context, entities, evaluate, search
from filedeck.plans import corpus
from filedeck.session import cut, table
from filedeck.sources import markup
from filedeck.streaming import loading

WEIGHTS = [0.5, 0.6, 0.7, 0.8, 0.9]


# Entities and filings


def current_filings(spark: SparkSession, d: str) -> DataFrame:
    return corpus.filings(spark, d)


def find_companies(spark: SparkSession, d: str) -> DataFrame:
    return entities.find_by_name(corpus.companies(spark, d), "물산|화학").select("corp_code", "corp_name", "stock_code")


def find_companies_literal(spark: SparkSession, d: str) -> DataFrame:
    return entities.find_by_name(corpus.companies(spark, d), "전자", listed_only=False, literal=True).select("corp_code", "corp_name", "stock_code")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "golden").groupBy("corp_name").agg(F.min("golden_id").alias("position"))
    return entities.resolve(names, corpus.companies(spark, d))


def resolved_companies(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).filter("corp_code is not null")


def unmatched_companies(spark: SparkSession, d: str) -> DataFrame:
    """Names as delivered, blanks and all, so that some find no company."""
    names = table(spark, d, "companies").select("corp_name").distinct()
    return entities.unmatched(entities.resolve(names, corpus.companies(spark, d))).select("corp_name")


def modified_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select("corp_code", F.try_to_date("modify_date", "yyyyMMdd").cast("string").alias("modified_on"))


def annual_reports(spark: SparkSession, d: str) -> DataFrame:
    return entities.annual_reports(corpus.filings(spark, d)).select("rcept_no", "corp_code", "report_nm", "rcept_dt")


def latest_annual_report(spark: SparkSession, d: str) -> DataFrame:
    found = entities.latest_by(entities.annual_reports(corpus.filings(spark, d)), "corp_code", "rcept_dt", "rcept_no")
    return found.select("corp_code", "rcept_no", "report_nm", "rcept_dt")


def last_values(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("rcept_dt"), F.col("rcept_no")]
    return entities.last_values(corpus.filings(spark, d).filter("rcept_dt is not null"), "corp_code", order, ["report_nm", "rcept_dt", "loaded_at"])


def companies_without_annual(spark: SparkSession, d: str) -> DataFrame:
    return entities.missing(corpus.companies(spark, d), entities.annual_reports(corpus.filings(spark, d)), "corp_code")


def filings_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    return entities.missing(table(spark, d, "filings"), table(spark, d, "chunks"), "rcept_no")


def chunks_by_company(spark: SparkSession, d: str) -> DataFrame:
    """Three-way join, counted."""
    rows = corpus.chunks(spark, d, "text")
    return rows.groupBy("corp_name").agg(F.count("*").alias("n_chunks"), F.countDistinct("rcept_no").alias("n_filings"), F.sum(F.length("text")).alias("n_chars"))


def loaded_once(spark: SparkSession, d: str) -> DataFrame:
    """The chunks an idempotent load keeps."""
    return entities.first_loaded(table(spark, d, "chunks")).select("id", "rcept_no", "chunk_index")


def new_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A second load, of the chunks in the upper half of the ids: those whose place in their filing the first load has not filled."""
    rows = table(spark, d, "chunks").select("id", "rcept_no", "section_path", "chunk_index")
    half = rows.agg(F.expr("(min(id) + max(id)) div 2").alias("half"))  # one row
    loads = rows.crossJoin(F.broadcast(half))
    keys = ["rcept_no", "section_path", "chunk_index"]
    return entities.new_rows(loads.filter("id > half"), loads.filter("id <= half"), keys).select("id", "rcept_no", "chunk_index")


def first_filings(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty filings by receipt number."""
    return entities.first_filings(corpus.filings(spark, d), 20).select("rcept_no", "corp_code", "report_nm")


def companies_with_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The companies a question can be asked about."""
    return corpus.chunks(spark, d).select("corp_name").distinct()


def expected_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Membership fetch: the chunks that golden items expect."""
    wanted = table(spark, d, "golden").select(F.col("expected_chunk_id").alias("id"))
    return table(spark, d, "chunks").select("id", "rcept_no", "chunk_type").join(wanted, "id", "left_semi")


def first_companies_golden(spark: SparkSession, d: str) -> DataFrame:
    """Golden items of two metrics of the first ten companies by name."""
    names = table(spark, d, "golden").select("corp_name").distinct().orderBy("corp_name").limit(10)
    rows = table(spark, d, "golden").filter(F.col("metric").isin("매출액", "영업이익"))
    return rows.join(names, "corp_name", "left_semi").select("golden_id", "corp_name", "metric")


# Text


def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(spark, d, "text")
    return rows.select("id", tx.embedding_input(F.col("corp_name"), F.col("section_path"), F.col("text")).alias("input"))


def lexical_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(spark, d, "text")
    return rows.select("id", F.md5(tx.lexical_input(F.col("corp_name"), F.col("section_path"), F.col("text"))).alias("input_md5"), F.length(tx.rerank_input(F.col("corp_name"), F.col("section_path"), F.col("text"))).alias("rerank_chars"))


def chunk_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", F.array_join(tx.terms(F.coalesce("text", F.lit(""))), " ").alias("terms"))


def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    texts = search.split_texts(table(spark, d, "chunks").select("id", "text"))
    vocabulary = search.document_frequency(texts).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return search.corpus_size(texts).select("n_docs", F.round("avg_len", 6).alias("avg_len")).crossJoin(F.broadcast(vocabulary))  # one row each


def frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    """Top 50 by document frequency."""
    return search.document_frequency(search.split_texts(table(spark, d, "chunks").select("id", "text"))).orderBy(F.desc("df"), F.asc("token")).limit(50)


def row_labels(spark: SparkSession, d: str) -> DataFrame:
    """How often each normalised row label stands in tables."""
    rows = table(spark, d, "chunks").select(F.explode(tx.rows(F.col("text"))).alias("row"))
    return evaluate.counts(rows, tx.label(F.get(tx.cells(F.col("row")), F.lit(0))), "label")


def metric_values(spark: SparkSession, d: str) -> DataFrame:
    """The value of each metric in each chunk that has it."""
    named = F.array(*(F.struct(F.lit(m).alias("metric"), tx.value_of(F.col("text"), m, negative).alias("value")) for m, negative in tx.METRICS.items()))
    rows = table(spark, d, "chunks").select("id", F.explode(named).alias("m"))
    return rows.select("id", "m.metric", "m.value").filter("value is not null")


def statement_bases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select(F.coalesce(tx.statement_basis(F.col("section_path")), F.lit("-")).alias("basis"), "rcept_no")
    return rows.groupBy("basis").agg(F.count("*").alias("n_chunks"), F.countDistinct("rcept_no").alias("n_filings"))


def sanitized_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that markup clean-up changes."""
    rows = table(spark, d, "documents").select("doc_id", "text", tx.sanitize_markup(F.col("text")).alias("clean"))
    return rows.filter("clean <> text").select("doc_id", F.length("clean").alias("n_chars"), F.md5("clean").alias("clean_md5"))


def highlighted_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "baseline_items").select("item_id", tx.highlight_numbers(F.col("answer")).alias("html"), tx.preview(F.col("answer"), 20).alias("preview"))


def error_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Error parsing over service bodies made from the filings."""
    body = F.when(F.length("report_nm") % 2 == 0, F.concat(F.lit("<result><status>014</status><message>"), "report_nm", F.lit("</message></result>"))).otherwise(F.concat(F.lit("<html>"), "report_nm"))
    return corpus.filings(spark, d).select("rcept_no", tx.error_fields(body).alias("e")).select("rcept_no", "e.status", "e.message")


# Chunks and tables


def _documents(spark: SparkSession, d: str) -> DataFrame:
    section = F.array(F.coalesce("source", F.lit("")))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", chunking.text_blocks(F.col("text"), section).alias("blocks"))


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(_documents(spark, d), "doc_id")


def packed_chunks_by_target(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and characters for several sizes, the blocks made once."""
    made = _documents(spark, d)
    several = F.array(*(F.struct(F.lit(t).alias("target"), chunking.pack(F.col("blocks"), target=t).alias("c")) for t in (600, 900, 1200)))
    rows = made.select(F.explode(several).alias("s")).select("s.target", F.explode("s.c").alias("c"))
    return rows.groupBy("target").agg(F.count("*").alias("n_chunks"), F.sum(F.length("c.text")).alias("n_chars"), F.max(F.length("c.text")).alias("longest"))


def split_tables(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the tables above the limit, the header in each."""
    rows = table(spark, d, "chunks").filter((F.lower(F.trim("chunk_type")) == "table") & (F.length("text") > tb.TABLE_CHARS))
    return rows.select("id", F.posexplode(tb.split_table(F.col("text"))).alias("part", "text"))


def reformatted_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").filter(F.lower(F.trim("chunk_type")) == "table")
    return rows.select("id", tb.reformat_table(F.col("text")).alias("text"))


def parsed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Markup made from chunks, cleaned up and parsed back."""
    kind = F.lower(F.trim("chunk_type"))
    rows = table(spark, d, "chunks").filter(kind.isin("table", "paragraph"))
    path = F.coalesce("section_path", F.array().cast("array<string>"))
    return markup.parsed(rows, F.col("id"), markup.as_markup(path, kind, F.coalesce("text", F.lit("")))).select(F.col("doc").cast("bigint").alias("id"), "ordinal", "section_path", "type", "text")


def nested_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Markup of two sections, the second inside the first, with a table in a cell, made from each chunk and parsed back."""
    rows = table(spark, d, "chunks").filter("text is not null")
    return markup.parsed(rows, F.col("id"), markup.nested_markup(F.col("rcept_no"), F.col("text"))).select(F.col("doc").cast("bigint").alias("id"), "ordinal", "section_path", "type", "text")


# Search


def _corpus_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", "embedding")


def _dense(spark: SparkSession, d: str, k: int = search.CANDIDATES) -> DataFrame:
    return search.dense(corpus.vector_queries(spark, d), _corpus_vectors(spark, d), k)


def _sparse(spark: SparkSession, d: str, k: int = search.CANDIDATES) -> DataFrame:
    return search.sparse(corpus.vector_queries(spark, d).select("query_id", "sparse"), table(spark, d, "chunks").select("id", "sparse"), k)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 10)


def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """Dense search alone, with the texts of the best five."""
    return search.fetch(_dense(spark, d, 5), table(spark, d, "chunks").select("id", "rcept_no", "section_path", "chunk_type", "text"))


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.dense_filtered(corpus.vector_queries(spark, d), table(spark, d, "chunks"), "rcept_no", 10)


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d, 10)


def sparse_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.sparse(corpus.vector_queries(spark, d).select("query_id", "rcept_no", "sparse"), table(spark, d, "chunks").select("id", "rcept_no", "sparse"), 10, "rcept_no")


def _mixed(key: str, value: str) -> Column:
    """A filter value as users give it: of every three queries one null, one empty, one set."""
    return F.when(F.col(key) % 3 == 0, F.lit(None)).when(F.col(key) % 3 == 1, F.lit("")).otherwise(F.col(value)).alias(value)


def dense_topk_mixed_filters(spark: SparkSession, d: str) -> DataFrame:
    queries = corpus.vector_queries(spark, d).select("query_id", _mixed("query_id", "rcept_no"), "embedding")
    return search.dense_filtered(queries, table(spark, d, "chunks").select("id", "rcept_no", "embedding"), "rcept_no", 10)


def sparse_topk_mixed_filters(spark: SparkSession, d: str) -> DataFrame:
    queries = corpus.vector_queries(spark, d).select("query_id", _mixed("query_id", "rcept_no"), "sparse")
    return search.sparse(queries, table(spark, d, "chunks").select("id", "rcept_no", "sparse"), 10, "rcept_no")


def bm25_topk_mixed_filters(spark: SparkSession, d: str) -> DataFrame:
    queries = corpus.golden(spark, d).select("query_id", "text", _mixed("query_id", "corp_name"))
    return search.bm25(queries, _texts(spark, d), 5, "corp_name")


def sparse_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "chunks")).groupBy("token").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def _texts(spark: SparkSession, d: str, breadcrumb: bool = False) -> DataFrame:
    rows = corpus.chunks(spark, d, "text")
    text = tx.lexical_input(F.col("corp_name"), F.col("section_path"), F.coalesce("text", F.lit(""))) if breadcrumb else F.col("text")
    return rows.select("id", "corp_name", text.alias("text"))


def _bm25(spark: SparkSession, d: str, k: int = search.CANDIDATES, breadcrumb: bool = False, by: str | None = None) -> DataFrame:
    return search.bm25(corpus.golden(spark, d).select("query_id", "text", "corp_name"), _texts(spark, d, breadcrumb), k, by)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 5)


def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 5, by="corp_name")


def bm25_topk_breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, 5, breadcrumb=True)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.rrf([_dense(spark, d), _sparse(spark, d)], 10)


def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(_dense(spark, d), _sparse(spark, d), 10)


def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    return search.sweep(_dense(spark, d), _sparse(spark, d), WEIGHTS, 5)


def dense_sparse_overlap(spark: SparkSession, d: str) -> DataFrame:
    return search.overlap(_dense(spark, d), _sparse(spark, d), 10)


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: fused candidates with the texts of the best five."""
    hits = search.hybrid(_dense(spark, d), _sparse(spark, d))
    rows = table(spark, d, "chunks").select("id", "rcept_no", "section_path", "chunk_type", "text")
    return search.fetch(hits, rows)


def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    """A pool of 20 re-ordered by the share of the query chunk's words, cut to five."""
    pool = search.fetch(search.hybrid(_dense(spark, d), _sparse(spark, d), search.POOL), table(spark, d, "chunks").select("id", "text"))
    asked = corpus.vector_queries(spark, d).select("query_id", F.col("text").alias("question"))
    score = search.overlap_score(F.coalesce("question", F.lit("")), F.coalesce("text", F.lit("")))
    return search.rerank(pool.join(asked, "query_id"), score).select("query_id", "id", "score", "rerank_score", "rank")


def whole_filing_search(spark: SparkSession, d: str) -> DataFrame:
    """Fusion over the query chunk's whole filing, rows without a common token included."""
    return search.hybrid_within(corpus.vector_queries(spark, d).select("query_id", "rcept_no", "embedding", "sparse"), table(spark, d, "chunks").select("id", "rcept_no", "embedding", "sparse"), "rcept_no", 10)


def embedded_search(spark: SparkSession, d: str) -> DataFrame:
    """Golden questions against chunks by the stand-in embedding."""
    questions = search.embedded(corpus.golden(spark, d).select("query_id", "text"), "text", search.HashingEmbedder)
    rows = search.embedded(table(spark, d, "chunks").select("id", "text"), "text", search.HashingEmbedder)
    return search.dense(questions.select("query_id", "embedding"), rows.select("id", "embedding"), 5)


# Contexts, turns, answers


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Context texts of the golden questions from word search within the company."""
    hits = _bm25(spark, d, 3, by="corp_name").select("query_id", "id", "rank")
    rows = corpus.chunks(spark, d, "chunk_type", "text").select("id", "corp_name", "section_path", "chunk_type", "text")
    return context.assembled(search.fetch(hits, rows), reformat=False)


def contexts_reformatted(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25(spark, d, 3, by="corp_name").select("query_id", "id", "rank")
    rows = corpus.chunks(spark, d, "chunk_type", "text").select("id", "corp_name", "section_path", "chunk_type", "text")
    return context.assembled(search.fetch(hits, rows))


def extracted_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the extractive stand-in to the golden questions, checked against their contexts."""
    asked = corpus.golden(spark, d).select("query_id", "question", "metric", "expected_value")
    rows = contexts(spark, d).join(asked, "query_id")
    answered = rows.withColumn("answer", context.extracted_answer(F.col("context"), F.col("metric")))
    final = context.verified(answered, lambda again: again)
    return final.select("query_id", "answer", evaluate.answer_correct(F.col("answer"), F.col("expected_value")).alias("correct"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of eight records each; a record names its company only in a rewritten query."""
    rows = table(spark, d, "baseline_items")
    corp = F.when(F.col("search_query").isNull(), None).otherwise(F.regexp_extract("search_query", r"^(\S+?)(?:의|이|가) ", 1))
    return rows.select(F.expr("item_id div 8").alias("conversation"), F.col("item_id").alias("turn"), "question", corp.alias("corp"))


def carried_companies(spark: SparkSession, d: str) -> DataFrame:
    rows = _turns(spark, d)
    return rows.select("conversation", "turn", context.carried(rows, "conversation", "turn", "corp").alias("corp"))


def carried_questions(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conversation", "turn", context.with_last_questions("conversation", "turn", "question").alias("query"))


def valid_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "baseline_items")
    return rows.select("item_id", context.valid_request(F.col("answer"), F.col("item_id") % 25).alias("valid"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    asked = corpus.golden(spark, d).select("question", "metric", "expected_value", "expected_chunk_id")
    return table(spark, d, "baseline_items").join(asked, "question")


def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).join(table(spark, d, "chunks").select(F.col("id").alias("expected_chunk_id"), "text"), "expected_chunk_id")
    return rows.select("item_id", tx.grounded(F.col("answer"), F.col("text")).alias("grounded"))


def answer_accuracy(spark: SparkSession, d: str) -> DataFrame:
    right = evaluate.answer_correct(F.col("answer"), F.col("expected_value")).cast("int")
    out = _answers(spark, d).select("metric", right.alias("right")).rollup("metric").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"))
    return out.withColumn("metric", F.coalesce("metric", F.lit("all")))


# Evaluation and statistics


def _conditions(spark: SparkSession, d: str) -> DataFrame:
    plain, crumbs = cut(_bm25(spark, d)), cut(_bm25(spark, d, breadcrumb=True))
    lists = {"bm25": plain, "bm25_breadcrumb": crumbs, "rrf": search.rrf([plain, crumbs], 10), "weighted": search.weighted([plain, crumbs], [0.7, 0.3], 10)}
    return _judged(spark, d, lists)


def _judged(spark: SparkSession, d: str, lists: dict[str, DataFrame]) -> DataFrame:
    golden, texts, out = corpus.golden(spark, d).select("query_id", "expected_chunk_id", "expected_value", "metric"), table(spark, d, "chunks"), None
    for name, hits in lists.items():
        part = evaluate.judged(hits.filter("rank <= 10"), golden, texts).withColumn("condition", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def retrieval_quality_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Dense, sparse and mixed conditions within the company, by the stand-in embedding; its figures say nothing of a real model's."""
    questions = cut(search.embedded(corpus.golden(spark, d).select("query_id", "corp_name", "text"), "text", search.HashingEmbedder))
    rows = cut(search.embedded(_texts(spark, d, breadcrumb=True), "text", search.HashingEmbedder).drop("text"))
    dense = cut(search.dense_filtered(questions, rows, "corp_name"))
    sparse = cut(search.sparse(questions, rows, by="corp_name"))
    words = cut(_bm25(spark, d, by="corp_name", breadcrumb=True))
    lists = {"dense": dense, "sparse": sparse, "dense_sparse_rrf": search.rrf([dense, sparse], 10), "dense_bm25_rrf": search.rrf([dense, words], 10)}
    lists |= {"dense_sparse_weighted": search.hybrid(dense, sparse, 10), "dense_bm25_weighted": search.hybrid(dense, words, 10)}
    return evaluate.means(_judged(spark, d, lists), "condition", "metric")


def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank, by id and by value, of each condition by metric and in all."""
    return evaluate.means(_conditions(spark, d), "condition", "metric")


def golden_items(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.golden_items(corpus.chunks(spark, d, "chunk_type", "text"))


def golden_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: thirty items, the same on every run."""
    return evaluate.sample(table(spark, d, "golden"), "golden_id", 30).select("golden_id", "corp_name", "metric")


def section_counts(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent top sections."""
    return evaluate.counts(table(spark, d, "chunks"), F.coalesce(F.get("section_path", F.lit(0)), F.lit("(없음)")), "section", 20)


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.counts(table(spark, d, "chunks"), F.coalesce(F.lower(F.trim("chunk_type")), F.lit("(없음)")), "chunk_type")


def filing_totals(spark: SparkSession, d: str) -> DataFrame:
    is_table = (F.lower(F.trim("chunk_type")) == "table").cast("int")
    return table(spark, d, "chunks").groupBy("rcept_no").agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(is_table), F.lit(0)).alias("n_tables"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("section_path").alias("n_sections"))


def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select(F.coalesce(F.lower(F.trim("chunk_type")), F.lit("(없음)")).alias("chunk_type"), F.length("text").alias("n_chars"))
    return evaluate.percentiles(rows, "n_chars", "chunk_type")


def chunks_per_filing_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.percentiles(table(spark, d, "chunks").groupBy("rcept_no").agg(F.count("*").alias("n_chunks")), "n_chunks")


# Streams, run over the table as a batch; streaming/loading.py runs the same on files as they land


def current_versions(spark: SparkSession, d: str) -> DataFrame:
    return loading.current_versions(table(spark, d, "filings").select("rcept_no", "corp_code", "loaded_at"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return loading.windowed_counts(table(spark, d, "events"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name != "queries"}
