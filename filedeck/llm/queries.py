"""The pN_ queries and their SQL; each call goes over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filedeck.llm import languages, leakage, near_duplicates, nearest, packing, pairs, repeated_lines, splitting, sql
from filedeck.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks with similarity of at least 0.6 over word pairs."""
    pairs, members = near_duplicates.similar_pairs(table(spark, d, "chunks").select("id", "text"), threshold=0.6, least=50, size=2)
    return near_duplicates.expand(pairs, members)


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk that takes part, its class of copies and its number of links at five words and 0.8."""
    return near_duplicates.links(*near_duplicates.similar_pairs(table(spark, d, "chunks").select("id", "text")))


def _by_filing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", F.col("rcept_no").alias("source"), "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every place of the lines repeated excessively in a filing."""
    return repeated_lines.places(_by_filing(spark, d)).select("id", "line_no")


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line in two or more chunks of a filing: its ratio, the test's decision and whether it reaches the level."""
    texts = _by_filing(spark, d)
    tests = repeated_lines.assessed(texts, cut(repeated_lines.lines(texts)))
    return tests.select(F.col("source").alias("rcept_no"), "key", "n_ids", "n", F.round("llr", 4).alias("llr"), "excess", repeated_lines.at_level(5, 0.05).alias("at_level"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk text without those lines."""
    texts = _by_filing(spark, d)
    return repeated_lines.cleaned(texts, repeated_lines.places(texts)).withColumnRenamed("source", "rcept_no")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks with a cosine of at least 0.85, one among the ten nearest of the other."""
    return nearest.curve_pairs(table(spark, d, "chunks").select("id", "embedding"), 0.85).select("id_a", "id_b")


def p3_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten near chunks of every usable chunk with their cosine."""
    near = nearest.curve_ids(table(spark, d, "chunks").select("id", "embedding"))
    return near.select("id", "near_id", F.round("cosine", 5).alias("cosine"), "rank")


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """What p3_topk finds of the exact ten nearest of the chunks whose id is divisible by 100."""
    return nearest.recall(table(spark, d, "chunks").select("id", "embedding"), F.col("id") % 100 == 0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut."""
    return p4_pieces(spark, d).filter("piece_no = 1").select("id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every chunk above its limit."""
    return splitting.pieces(table(spark, d, "chunks").select("id", "section_path", "chunk_type", "text"))


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the pieces give when put together again, and whether limit and stated overlap were kept."""
    found = p4_pieces(spark, d)
    kind = found.filter("piece_no = 1").select("id", "chunk_type")
    at = lambda values: F.when(F.col("chunk_type") == "table", values["table"]).otherwise(values["paragraph"])
    low, high = at(splitting.OVERLAPS) - at(splitting.TOLERANCES), at(splitting.OVERLAPS) + at(splitting.TOLERANCES)
    kept = (F.col("least_shared") >= low) & (F.col("most_shared") <= high)
    return splitting.rebuilt(found).join(kind, "id").select("id", F.md5("text").alias("text_md5"), (F.col("most") <= at(splitting.LIMITS)).alias("within"), kept.alias("overlap_kept"))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "baseline_items").select(F.col("item_id").alias("id"), "question", "answer"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective question and answer records with the kind of defect."""
    return _defects(spark, d).select(F.col("id").alias("item_id"), "defect")


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its defect, if any, and what the record's own flag says."""
    items = table(spark, d, "baseline_items").select("item_id", "correct")
    found = _defects(spark, d).select(F.col("id").alias("item_id"), "defect", F.round("copied", 4).alias("copied"))
    return items.join(found, "item_id", "left")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of a longer one, with its container of 2,048 tokens."""
    return packing.packed(table(spark, d, "documents").select("doc_id", "n_tokens", "text"))


def p6_program(spark: SparkSession, d: str) -> DataFrame:
    """Value and lower bound of the configuration program, and how many containers its rounding gave."""
    return packing.program_figures(table(spark, d, "documents").select("doc_id", "n_tokens", "text"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The containers with their items and unused tokens."""
    return packing.containers(p6_pack(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "passage")
    return leakage.leaks(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), items)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items they hold at least 60 letters or digits of."""
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest match of each leaked item in each document, with its places."""
    return _leaks(spark, d)


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold nothing of the evaluation items."""
    return leakage.without_leaks(table(spark, d, "documents"), _leaks(spark, d)).select("doc_id", "lang", "source")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each language of the documents in several languages or with a label that is not their one language."""
    documents = _documents(spark, d)
    rows = languages.wrong_labels(documents, languages.train(documents))
    return rows.select(F.col("id").alias("doc_id"), "lang")


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of every document with their share of its letters and a confidence."""
    documents = _documents(spark, d)
    rows = languages.document_languages(documents, languages.train(documents))
    return rows.select(F.col("id").alias("doc_id"), "label", "lang", F.round("share", 4).alias("share"), F.round("confidence", 4).alias("confidence"))


def p8_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are, for at least a fifth of their letters, in a language of which there are no labelled texts."""
    documents = _documents(spark, d)
    rows = languages.unknown_texts(documents, languages.train(documents))
    return rows.select(F.col("id").alias("doc_id"), "label", F.round("share", 4).alias("share"), F.round("confidence", 4).alias("confidence"))


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch in one language of every document."""
    documents = _documents(spark, d)
    rows = languages.stretches(documents, languages.train(documents))
    return rows.withColumnRenamed("id", "doc_id").withColumn("confidence", F.round("confidence", 4))


NAMES = (p1_found, p1_links, p2_found, p2_lines, p2_clean, p3_found, p3_topk, p3_recall, p4_found, p4_pieces, p4_rebuilt, p5_found, p5_defects, p6_pack, p6_program, p6_containers, p7_found, p7_matches, p7_clean, p8_found, p8_languages, p8_unknown, p8_stretches)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
