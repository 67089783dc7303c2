"""Operators against fixtures and Python models, with nulls, ties and empty tables."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from filedeck.operators import chunking, context, entities, evaluate, search


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# Chunks


def pack_model(blocks, target, table_max, small):
    from test_functions import split_model

    out, open_, section, n = [], [], None, 0

    def flush():
        nonlocal open_, n
        if open_:
            out.append((section, "paragraph", "\n".join(open_)))
        open_, n = [], 0

    for s, kind, text in blocks:
        if kind == "table" and len(text) >= small:
            flush()
            out.extend((s, "table", t) for t in split_model(text, table_max))
            continue
        if open_ and (s != section or n + len(text) > target):
            flush()
        open_.append(text)
        section, n = s, n + len(text)
    flush()
    return out


def test_pack(spark):
    r = random.Random(3)
    docs = []
    for i in range(60):
        docs.append((i, [(["ab"[r.randrange(2)]], r.choice(["table", "paragraph"]), "\n".join("x" * r.randrange(1, 9) for _ in range(r.randrange(1, 5)))) for _ in range(r.randrange(0, 12))]))
    df = spark.createDataFrame(docs, f"doc int, blocks {chunking.CHUNK}")
    found = chunking.chunks(df, "doc", target=12, table_max=15, small_table=6).orderBy("doc", "ordinal").collect()
    for i, blocks in docs:
        expected = pack_model(blocks, 12, 15, 6)
        mine = [x for x in found if x["doc"] == i]
        assert [(x["section"], x["type"], x["text"]) for x in mine] == [(list(s), k, t) for s, k, t in expected]
        seen: dict = {}
        for x in mine:
            key = tuple(x["section"])
            assert x["chunk_index"] == seen.get(key, 0)
            seen[key] = x["chunk_index"] + 1


def test_pack_limits(spark):
    df = spark.createDataFrame([(1, [(["s"], "paragraph", "a" * 450), (["s"], "paragraph", "b" * 450), (["s"], "paragraph", "c")]), (2, [(["s"], "paragraph", "d" * 5000)]), (3, []), (4, None)], f"doc int, blocks {chunking.CHUNK}")
    assert [(x["doc"], len(x["text"])) for x in chunking.chunks(df, "doc").orderBy("doc", "ordinal").collect()] == [(1, 901), (1, 1), (2, 5000)]


def test_text_blocks(spark):
    df = spark.createDataFrame([("a\n\nx | y\n \nb",), ("",)], "t string").select(chunking.text_blocks(F.col("t"), F.array(F.lit("s"))).alias("b"))
    first, second = (r["b"] for r in df.collect())
    assert [(b["section"], b["type"], b["text"]) for b in first] == [(["s", "0"], "paragraph", "a"), (["s", "1"], "table", "x | y"), (["s", "2"], "paragraph", "b")]
    assert second == []


# Entities


def test_resolve(spark):
    companies = spark.createDataFrame([("1", "가", "", "20250101"), ("2", "가", "005930", "20200101"), ("3", "나", "", None), ("4", "나", "", "20190101"), ("5", None, "1", "2")], "corp_code string, corp_name string, stock_code string, modify_date string")
    seeds = spark.createDataFrame([("가", 1), ("나", 2), ("다", 3), (None, 4)], "corp_name string, rank int")
    found = entities.resolve(seeds, companies)
    assert {(r["corp_name"], r["corp_code"]) for r in found.collect()} == {("가", "2"), ("나", "4"), ("다", None), (None, None)}
    assert entities.unmatched(found).count() == 2
    assert entities.resolve(seeds.limit(0), companies).count() == 0


def test_find(spark):
    df = spark.createDataFrame([("1", "(주)가", "1"), ("2", "주가", ""), ("3", None, "3")], "corp_code string, corp_name string, stock_code string")
    assert rows(entities.find_by_name(df, "(주)"), "corp_code") == [("1",)]
    assert rows(entities.find_by_name(df, "(주)", listed_only=False), "corp_code") == [("1",), ("2",)]
    assert rows(entities.find_by_name(df, "(주)", listed_only=False, literal=True), "corp_code") == [("1",)]


def test_latest_and_last(spark):
    df = spark.createDataFrame([("a", "1", "사업보고서 (2023)", "2024-01-01"), ("a", "2", None, "2025-01-01"), ("a", "3", "[기재정정]사업보고서(2024)", "2025-01-01"), ("b", "4", "사업보고서 제출기한 연장 신고", None), ("b", "5", "반기보고서", "2020-01-01")], "k string, no string, nm string, dt string")
    df = df.withColumn("dt", F.to_date("dt"))
    assert rows(entities.latest_by(df, "k", "dt", "no"), "k", "no") == [("a", "3"), ("b", "5")]
    assert rows(entities.last_values(df.filter("dt < '2025-06-01' and no <> '3'"), "k", [F.col("dt")], ["no", "nm"]), "k", "no", "nm") == [("a", "2", "사업보고서 (2023)"), ("b", "5", "반기보고서")]
    assert rows(entities.annual_reports(df.withColumnRenamed("nm", "report_nm")), "no") == [("1",), ("3",)]
    assert rows(entities.missing(df, df.filter("k = 'a'"), "k"), "k") == [("b",)]
    assert entities.new_rows(df, df.filter("k = 'a'"), ["k", "no"]).count() == 2


def test_loaded_once(spark):
    df = spark.createDataFrame([(2, "r", ["a"], 0, "x"), (1, "r", ["a"], 0, "y"), (3, "r", [], 0, "z"), (4, "r", None, 0, "w"), (5, "r", None, 0, "v")], "id bigint, rcept_no string, section_path array<string>, chunk_index int, text string")
    assert rows(entities.first_loaded(df), "id") == [(1,), (3,), (4,)]


# Search


def lists(spark, values):
    return spark.createDataFrame([(q, i, float(s), n) for q, items in values.items() for n, (i, s) in enumerate(items, 1)], "query_id bigint, id bigint, score double, rank int")


def test_fusion(spark):
    a, b = lists(spark, {1: [(1, 0.9), (2, 0.1)], 2: [(7, 3.0), (8, 3.0)]}), lists(spark, {1: [(2, 50), (1, 1)], 3: [(9, 1.0)]})
    assert rows(search.weighted([a, b], [0.7, 0.3], 10), "query_id", "rank", "id", "score") == [(1, 1, 1, 0.7), (1, 2, 2, 0.3), (2, 1, 7, 0.0), (2, 2, 8, 0.0), (3, 1, 9, 0.0)]
    fused = rows(search.rrf([a, b], 10), "query_id", "rank", "id")
    assert fused == [(1, 1, 1), (1, 2, 2), (2, 1, 7), (2, 2, 8), (3, 1, 9)]
    assert rows(search.overlap(a, b, 1), "query_id", "n_common") == [(1, 0), (2, 0), (3, 0)]
    assert {(r["weight"], r["id"]) for r in search.sweep(a, b, [0.2, 0.9], 1).filter("query_id = 1").collect()} == {(0.2, 2), (0.9, 1)}
    assert search.rrf([a.limit(0), b.limit(0)], 5).count() == 0


def test_dense(spark):
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [(50, None), (51, [0.0] * 8), (52, [1.0] + [0.0] * 7), (53, [2.0] + [0.0] * 7)]
    df = spark.createDataFrame(vectors, "id bigint, embedding array<float>")
    found = rows(search.dense(df.filter("id in (0, 50, 52)").withColumnRenamed("id", "query_id"), df, 3), "query_id", "rank", "id", "score")
    assert [x[2:] for x in found if x[0] == 52][:2] == [(52, 1.0), (53, 1.0)] and {x[0] for x in found} == {0, 52}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    exact = sorted(((round(cos(vectors[0][1], v), 5), -i) for i, v in vectors if v and any(v)), reverse=True)[:3]
    assert [(round(s, 5), -i) for q, _, i, s in found if q == 0] == exact


def test_vectors_travel_as_delivered(spark, monkeypatch):
    """Floats of four bytes stay so in the blocks, and blocks of any size give the same lists."""
    import pyarrow as pa

    for kind, size in ((pa.float32(), 4), (pa.float64(), 8)):
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([[3.0, 4.0], [1.0, 0.0], [0.0, 2.0]], pa.list_(kind))], ["id", "v"])
        made = [b.to_pylist()[0] for b in search._blocks(2)[1]([batch])]
        assert [len(b["v"]) for b in made] == [2 * 2 * size, 2 * size]
        assert search._unit(made[0]).tolist() == [[0.6, 0.8], [1.0, 0.0]]
    r = random.Random(5)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(400)], "id bigint, embedding array<double>").repartition(3)
    asked = df.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    whole = rows(search.dense(asked, df, 9), "query_id", "rank", "id", "score")
    for name, n in (("ROWS", 37), ("QUERIES", 50), ("DENSE_AT_ONCE", 16)):
        monkeypatch.setattr(search, name, n)
    assert rows(search.dense(asked, df, 9), "query_id", "rank", "id", "score") == whole and len(whole) == 134 * 9


def test_sparse(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1.0, "y": 0.2}), (2, "b", {"x": 0.5, "y": 1.0}), (3, "b", {"z": 1.0}), (4, "b", None)], "id bigint, c string, sparse map<string,double>")
    q = spark.createDataFrame([(9, "b", {"x": 1.0, "y": 1.0})], "query_id bigint, c string, sparse map<string,double>")
    assert rows(search.sparse(q, df, 5), "rank", "id", "score") == [(1, 2, 1.5), (2, 1, 1.2)]
    assert rows(search.sparse(q, df, 5, "c"), "id") == [(2,)]


def test_sparse_sums_in_one_order(spark):
    """Sums that end in a half in the seventh place: a filter and the way rows are dealt out change no score."""
    rnd, data = random.Random(7), []
    for i in range(3000):
        a, b = rnd.randrange(1, 5000), rnd.randrange(1, 5000)
        tokens = [(f"t{j}", w / 10_000) for j, w in enumerate((a, b, 10_005 - (a + b) % 10))]
        rnd.shuffle(tokens)
        data.append((i, "a", *zip(*tokens)))
    made = spark.createDataFrame(data, "id bigint, c string, tokens array<string>, weights array<double>")
    corpus = made.select("id", "c", F.map_from_arrays("tokens", "weights").alias("sparse"))
    q = spark.createDataFrame([(9, "a", {"t0": 0.001, "t1": 0.001, "t2": 0.001})], "query_id bigint, c string, sparse map<string,double>")
    expected = {}
    for i, _, _, weights in data:
        total = 0.0
        for w in weights:
            total += 0.001 * w
        expected[i] = float(search.rounded(np.array([total]))[0])
    for by, parts in (("c", 1), ("c", 5), (None, 5)):
        found = search.sparse(q, corpus.repartition(parts), 3000, by)
        assert {(i, s) for i, s in rows(found, "id", "score")} == set(expected.items())


def test_sparse_over_blocks(spark, monkeypatch):
    """Blocks of any size give the lists of plain Python, and products are not handed on: a task gives k rows a query."""
    from decimal import ROUND_HALF_UP, Decimal

    r = random.Random(3)
    names = ["all", *"abcdefgh"]
    made = lambda: {t: r.choice([0.25, 0.5, 1.0]) for t in names if t == "all" or r.random() < 0.3}
    data = [(i, made()) for i in range(700)] + [(700, {"all": 0.0}), (701, {"all": -1.0}), (702, {"all": None}), (703, {}), (704, None), (705, {"z": 1.0}), (706, {"half": 0.0000125})]
    asked = [(i, made()) for i in range(300)] + [(300, {"all": 1.0}), (301, {"z": 2.0}), (302, {"none": 1.0}), (303, None), (304, {"half": 0.2})]
    k = 900
    expected = set()
    for q, mine in asked:
        found = []
        for i, row in data:
            if common := set(mine or ()) & set(row or ()):
                worth = [mine[t] * row[t] for t in common if row[t] is not None]
                found.append((float(Decimal(repr(sum(worth))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if worth else None, i))
        found.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        expected |= {(q, i, score, n) for n, (score, i) in enumerate(found, 1)}
    corpus = spark.createDataFrame(data, "id bigint, sparse map<string,double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id bigint, sparse map<string,double>")
    assert {tuple(x) for x in search.sparse(queries, corpus, k).select("query_id", "id", "score", "rank").collect()} == expected
    monkeypatch.setattr(search, "SPARSE_ROWS", 64)
    monkeypatch.setattr(search, "SPARSE_QUERIES", 100)
    few = {x for x in expected if x[3] <= 7}
    assert {tuple(x) for x in search.sparse(queries, corpus, 7).select("query_id", "id", "score", "rank").collect()} == few
    ready = [x.select(c, F.map_keys("sparse").alias("tokens"), F.map_values("sparse").alias("weights")).withColumnRenamed("query_id", "id").filter("tokens is not null") for x, c in ((queries, "query_id"), (corpus, "id"))]
    assert search._meet(*ready, search._posting_blocks, 64, 100, search._multiply(7)).count() <= 3 * 7 * len(asked)


def test_overlap_makes_each_list_once(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], {"x": 1.0}), (2, [0.0, 1.0], {"x": 2.0}), (3, [1.0, 1.0], {"y": 1.0})], "id bigint, embedding array<float>, sparse map<string,double>")
    q = df.withColumnRenamed("id", "query_id")
    found = search.overlap(search.dense(q, df, 2), search.sparse(q, df, 2), 2)
    assert rows(found, "query_id", "n_common") == [(1, 1), (2, 1), (3, 1)] and dict(found.dtypes)["n_common"] == "bigint"
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 6  # blocks of either side and their meeting, for two lists


def exchanged(df):
    """Rows that the exchanges of a query are given."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith(("AdaptiveSparkPlan", "ResultQueryStage", "ShuffleQueryStage")):
            return walk(node.executedPlan() if name.startswith("Adaptive") else node.plan())
        below = node.children()
        own = node.metrics().get("shuffleRecordsWritten").get().value() if name.startswith("Exchange") else 0
        return own + sum(walk(below.apply(n)) for n in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def common_token(spark, tmp_path_factory):
    """20,000 chunks that all hold one token, so that each of 200 queries meets every one of them."""
    d = str(tmp_path_factory.mktemp("common"))
    near = F.array(*(F.sin(F.col("id") * (n + 1)).cast("float") for n in range(4)))
    own = F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))
    rows_ = spark.range(20_000).select("id", F.expr("cast(id div 20 as string)").alias("rcept_no"), F.array(F.lit("s")).alias("section_path"), F.lit("paragraph").alias("chunk_type"), F.concat(F.lit("매출 "), own).alias("text"), near.alias("embedding"), F.create_map(F.lit("all"), F.lit(1.0), own, F.lit(0.5)).alias("sparse"))
    rows_.write.parquet(f"{d}/chunks.parquet")
    return d


@pytest.mark.parametrize("name", ["reranked_search", "sparse_topk_mixed_filters", "dense_sparse_overlap", "rrf_fusion", "weight_sweep", "hybrid_search", "weighted_fusion"])
def test_pairs_are_not_exchanged(spark, common_token, name):
    """Of 4,000,000 pairs with a common token only the best rows of each task leave it."""
    from filedeck.plans import catalog

    assert 0 < exchanged(catalog.queries()[name](spark, common_token)) < 1_000_000


def test_bm25(spark):
    import math

    docs = {1: "매출액은 매출액 이익", 2: "이익 비용", 3: "비용 비용 비용", 4: "", 5: None, 6: "기타 항목"}
    stems = {1: ["매출액", "매출액", "이익"], 2: ["이익", "비용"], 3: ["비용"] * 3, 4: [], 5: [], 6: ["기타", "항목"]}
    n, avg = 6, statistics.mean(len(s) for s in stems.values())
    df_ = {t: sum(t in s for s in stems.values()) for t in {t for s in stems.values() for t in s}}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df_.items()}
    idf = {t: v if v >= 0 else 0.25 * statistics.mean(raw.values()) for t, v in raw.items()}

    def score(q, s):
        return sum(idf[t] * s.count(t) * 2.5 / (s.count(t) + 1.5 * (0.25 + 0.75 * len(s) / avg)) for t in q if t in idf)

    q = ["매출액", "이익", "이익"]
    expected = sorted(((-round(score(q, s), 6), i) for i, s in stems.items()))[:5]
    texts = spark.createDataFrame(list(docs.items()), "id bigint, text string")
    asked = spark.createDataFrame([(1, "매출액 이익 이익"), (2, "없는말")], "query_id bigint, text string")
    found = search.bm25(asked, texts, 5)
    assert [(-s, i) for _, i, s in rows(found.filter("query_id = 1"), "rank", "id", "score")] == expected
    assert rows(found.filter("query_id = 2"), "id", "score") == [(i, 0.0) for i in range(1, 6)]


def test_rerank_and_models(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, "매출액 얼마", "이익"), (1, 2, 0.1, "매출액 얼마", "매출액은 얼마")], "query_id bigint, id bigint, score double, question string, text string")
    out = search.rerank(hits, search.overlap_score(F.col("question"), F.col("text")), 5)
    assert rows(out, "rank", "id", "score", "rerank_score") == [(1, 2, 0.1, 1.0), (2, 1, 0.9, 0.0)]

    def scorer():
        return lambda questions, texts: [len(t) for t in texts]

    assert rows(search.scored_by(hits, scorer), "id", "model_score") == [(1, 2.0), (2, 7.0)]
    made = search.embedded(hits.select("id", "text"), "text", search.HashingEmbedder).collect()
    assert all(len(r["embedding"]) == 64 and abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in made)
    assert made[1]["sparse"] == {"매출액": 0.5, "얼마": 0.5}


# Contexts and turns


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, "회사", ["Ⅲ", "연결 재무제표"], "table", "a | b\nx | 1"), (1, 1, "회사", ["개요"], "paragraph", "a | b")], "query_id bigint, rank int, corp_name string, section_path array<string>, chunk_type string, text string")
    assert context.assembled(hits).first()["context"] == "[1] (회사 / 개요)\na | b\n\n[2] (회사 [연결기준] / Ⅲ > 연결 재무제표)\nx: b=1"
    bare = hits.filter("rank = 1").withColumn("section_path", F.array().cast("array<string>"))
    assert context.assembled(bare).first()["context"] == "[1] (회사)\na | b"


def test_rewritten(spark):
    df = spark.createDataFrame([(1, "매출은?"), (2, None), (3, "빈 답")], "query_id bigint, question string")

    def model():
        return lambda questions: [f" {q} 얼마 " if q == "매출은?" else "  " for q in questions]

    assert rows(context.rewritten(df, model), "query_id", "search_query") == [(1, "매출은? 얼마"), (2, None), (3, "빈 답")]


def test_no_filter_value_means_no_filter(spark):
    """Null and '' let a query meet the whole corpus, in every search that takes a filter."""
    data = [(1, "a", [1.0, 0.0], {"x": 1.0}, "매출 하나"), (2, "b", [1.0, 1.0], {"x": 0.5}, "매출 둘"), (3, None, [0.9, 0.1], {"x": 0.2}, "매출 셋"), (4, "", [0.0, 1.0], {"x": 0.1}, "비용")]
    df = spark.createDataFrame(data, "id bigint, c string, embedding array<float>, sparse map<string,double>, text string")
    asked = [(7, "a"), (8, None), (9, ""), (10, "none")]
    q = spark.createDataFrame([(i, c, [1.0, 0.0], {"x": 1.0}, "매출") for i, c in asked], "query_id bigint, c string, embedding array<float>, sparse map<string,double>, text string")
    for found in (search.dense_filtered(q, df, "c", 10), search.sparse(q, df, 10, "c"), search.bm25(q, df, 10, "c"), search.hybrid_within(q, df, "c", 10)):
        ids = {i: {x for n, x in rows(found, "query_id", "id") if n == i} for i, _ in asked}
        assert ids == {7: {1}, 8: {1, 2, 3, 4}, 9: {1, 2, 3, 4}, 10: set()}
    set_only = q.filter("query_id = 7")
    assert rows(search.sparse(set_only, df, 10, "c"), "id") == [(1,)]


def test_first_filings(spark):
    df = spark.createDataFrame([("3",), ("1",), (None,), ("2",)], "rcept_no string")
    assert rows(entities.first_filings(df, 2), "rcept_no") == [("1",), ("2",)] and entities.first_filings(df, 9).count() == 4


def test_turns(spark):
    df = spark.createDataFrame([(1, 1, "q1", "가"), (1, 2, "q2", None), (1, 3, "q3", ""), (1, 4, "q4", None), (2, 1, "q5", None)], "c int, t int, q string, corp string")
    out = df.select("c", "t", context.carried(df, "c", "t", "corp").alias("x"), context.with_last_questions("c", "t", "q").alias("y"))
    assert rows(out, "c", "t", "x", "y") == [(1, 1, "가", "q1"), (1, 2, "가", "q1 q2"), (1, 3, "", "q1 q2 q3"), (1, 4, "가", "q2 q3 q4"), (2, 1, None, "q5")]


def test_requests(spark):
    df = spark.createDataFrame([("질문", 5), (" ", 5), ("", 5), ("질문", 0), ("질문", 21), ("가" * 501, 5), (None, 5), ("질문", 20)], "q string, k int")
    assert [r[0] for r in df.select(context.valid_request(F.col("q"), F.col("k"))).collect()] == [True, False, False, False, False, False, False, True]


# Evaluation


def test_judged(spark):
    hits = lists(spark, {1: [(5, 3.0), (6, 2.0)], 2: [(7, 1.0)]})
    golden = spark.createDataFrame([(1, 6, "12,345", "m"), (2, 9, None, "m"), (3, 5, "x", "n")], "query_id bigint, expected_chunk_id bigint, expected_value string, metric string")
    texts = spark.createDataFrame([(5, "a 12,345"), (6, "b"), (7, None)], "id bigint, text string")
    found = evaluate.judged(hits, golden, texts)
    assert rows(found, "query_id", "recall_at_5", "rr", "value_recall_at_5", "value_rr") == [(1, 1, 0.5, 1, 1.0), (2, 0, 0.0, 0, 0.0), (3, 0, 0.0, 0, 0.0)]
    assert rows(evaluate.means(found.withColumn("c", F.lit("x")), "c", "metric"), "metric", "n", "rr") == [("all", 3, 0.166667), ("m", 2, 0.25), ("n", 1, 0.0)]


def test_percentiles(spark):
    r = random.Random(2)
    for values in ([7], [0, 10], [r.randrange(100) for _ in range(50)], [r.randrange(10_000) for _ in range(997)]):
        got = evaluate.percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "x int"), "x").first()
        q = statistics.quantiles(values, n=100) if len(values) > 1 else [values[0]] * 99
        assert (got["n"], got["min"], got["median"], got["p90"], got["p95"], got["p99"], got["max"]) == (len(values), min(values), int(q[49]), int(q[89]), int(q[94]), int(q[98]), max(values))
    assert evaluate.percentiles(spark.createDataFrame([], "x int"), "x").count() == 0


def test_golden(spark):
    table = "구분 | 당기\n매출액 | 1,000\n영업이익 | (2,000)\n당기순이익 | -"
    df = spark.createDataFrame([(2, "가", "table", table), (1, "가", "paragraph", table), (3, "가", "table", table), (4, "나", " Table ", table.replace("-", "3,000")), (5, None, "table", table)], "id bigint, corp_name string, chunk_type string, text string")
    assert rows(evaluate.golden_items(df), "corp_name", "metric", "expected_chunk_id", "expected_value") == [("가", "매출액", 2, "1,000"), ("가", "영업이익", 2, "(2,000)"), ("나", "당기순이익", 4, "3,000"), ("나", "매출액", 4, "1,000"), ("나", "영업이익", 4, "(2,000)")]
    assert evaluate.golden_items(df).first()["question"].endswith("은 얼마인가요?")


def test_sample_is_stable(spark):
    df = spark.range(1000)
    a = rows(evaluate.sample(df, "id", 30), "id")
    assert a == rows(evaluate.sample(df.repartition(7), "id", 30), "id") and len(a) == 30


def test_within_and_answers(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0], {"x": 1.0}), (2, "a", [1.0, 1.0], None), (3, "b", [1.0, 0.0], {"x": 9.0}), (4, "a", [0.0, 0.0], {"x": 9.0})], "id bigint, c string, embedding array<float>, sparse map<string,double>")
    q = spark.createDataFrame([(9, "a", [1.0, 0.0], {"x": 1.0})], "query_id bigint, c string, embedding array<float>, sparse map<string,double>")
    assert rows(search.hybrid_within(q, df, "c"), "rank", "id", "score") == [(1, 1, 1.0), (2, 2, 0.0)]
    answers = spark.createDataFrame([(1, "q", "매출액 | 1,234", "1,234"), (2, "q", "매출액 | 1,234", "9,999"), (3, "q", "없음", "모름")], "query_id bigint, question string, context string, answer string")
    assert rows(context.verified(answers, lambda again: again), "query_id", "answer") == [(1, "1,234"), (2, context.NOT_FOUND), (3, "모름")]
    made = answers.select("query_id", context.extracted_answer(F.col("context"), F.lit("매출액")).alias("a"))
    assert rows(made, "query_id", "a") == [(1, "1,234"), (2, "1,234"), (3, context.NOT_FOUND)]
