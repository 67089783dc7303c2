"""Context texts for a reader model, and questions of several turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filedeck.functions.tables import reformat_table
from filedeck.functions.text import METRICS, grounded, path_text, statement_basis, value_of

TURNS = 2
# Bounds of a request, and the sentence for "not found".
QUESTION_CHARS, TOP_MOST, HISTORY_MOST, ANSWER_CHARS = 500, 20, 20, 4000
NOT_FOUND = "자료에서 찾을 수 없습니다"


def passage(rank: Column, corp: Column, path: Column, kind: Column, text: Column, reformat: bool = True) -> Column:
    """"[1] (corp [basis기준] / a > b)\\ntext", without " / " where the path is empty; tables reformatted."""
    basis = statement_basis(path)
    head = F.concat(corp, F.when(basis.isNotNull(), F.concat(F.lit(" ["), basis, F.lit("기준]"))).otherwise(""), F.when(F.size(path) > 0, F.concat(F.lit(" / "), path_text(path))).otherwise(""))
    body = F.when(F.lower(F.trim(kind)) == "table", reformat_table(text)).otherwise(text) if reformat else text
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] ("), head, F.lit(")\n"), F.coalesce(body, F.lit("")))


def assembled(hits: DataFrame, reformat: bool = True) -> DataFrame:
    """hits (query_id, rank, corp_name, section_path, chunk_type, text) -> (query_id, context), passages in
    the order of their ranks with a blank line between. A query's hits are at most its top k."""
    part = passage(F.col("rank"), F.coalesce("corp_name", F.lit("")), F.coalesce("section_path", F.array().cast("array<string>")), F.col("chunk_type"), F.col("text"), reformat)
    rows = hits.select("query_id", F.struct("rank", part.alias("p")).alias("s"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]), "\n\n").alias("context"))


def carried(turns: DataFrame, conversation: str, turn: str, corp: str) -> Column:
    """The turn's own value unless null, else the last non-empty one of an earlier turn."""
    earlier = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.col(corp), F.last(F.nullif(F.col(corp), F.lit("")), ignorenulls=True).over(earlier))


def with_last_questions(conversation: str, turn: str, question: str, n: int = TURNS) -> Column:
    """The n questions before and the turn's own, joined by blanks."""
    return F.array_join(F.collect_list(question).over(Window.partitionBy(conversation).orderBy(turn).rowsBetween(-n, 0)), " ")


def valid_request(question: Column, top_k: Column) -> Column:
    """A question of 1 to 500 characters that is not blank, and a top_k from 1 to 20."""
    return F.coalesce(F.length(question).between(1, QUESTION_CHARS) & question.rlike(r"(?U)\S") & top_k.between(1, TOP_MOST), F.lit(False))


def extracted_answer(context: Column, metric: Column) -> Column:
    """A stand-in for a reader model: the first value of the metric in the context's tables, else the sentence for "not found"."""
    found = F.lit(None).cast("string")
    for m, negative in METRICS.items():
        found = F.when(metric == m, value_of(context, m, negative)).otherwise(found)
    return F.coalesce(found, F.lit(NOT_FOUND))


def verified(answers: DataFrame, again) -> DataFrame:
    """answers (query_id, question, context, answer): those whose numbers the context lacks are made once more by
    again(DataFrame) -> DataFrame of the same columns; an answer that still is not grounded becomes "not found"."""
    sure = grounded(F.col("answer"), F.col("context"))
    retried = again(answers.filter(~sure))
    kept = retried.withColumn("answer", F.when(sure, F.col("answer")).otherwise(NOT_FOUND))
    return answers.filter(sure).unionByName(kept)


def rewritten(queries: DataFrame, model, question: str = "question") -> DataFrame:
    """queries with `search_query`, the question in words better for a search, from model() -> callable(questions), made
    once in each task; a null or blank answer of the model leaves the question as it is."""

    def run(frames):
        m = model()
        for f in frames:
            made = [str(x or "").strip() for x in m([q or "" for q in f[question]])]
            f["search_query"] = [x or q for x, q in zip(made, f[question])]
            yield f

    schema = ", ".join(f"`{n}` {t}" for n, t in queries.dtypes)
    return queries.mapInPandas(run, f"{schema}, search_query string")


def messages(system: str, context: Column, question: Column) -> Column:
    """A prompt as an array of role and content."""
    user = F.concat(F.lit("자료:\n"), context, F.lit("\n\n질문: "), question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
