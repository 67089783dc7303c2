"""The operators for training data against brute force, round trips and held-out labels, with the awkward inputs."""

import collections
import itertools
import os
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filedeck.llm import languages, leakage, near_duplicates, nearest, packing, pairs, repeated_lines, splitting

SCHEMA = "id bigint, text string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# 1 near duplicates


def sets_model(texts, size):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\W_]+", re.sub(r"(?<=[0-9]),(?=[0-9])", "", (t or "").lower()))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return out


def pairs_model(texts, size, least, threshold):
    s = {i: x for i, x in sets_model(texts, size).items() if len(x) >= max(least, 1)}
    return sorted((a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold)


def family(r, n, words):
    base = [r.choice(words) + str(r.randrange(10**6)) for _ in range(n)]
    out = [base]
    for _ in range(4):
        v = list(base)
        for _ in range(r.randrange(0, n // 8)):
            v[r.randrange(n)] = str(r.randrange(10**6))
        k = r.randrange(n)
        out.append(v[k:] + v[:k] if r.random() < 0.3 else v)
    return [" ".join(v) for v in out]


@pytest.fixture(scope="module")
def copies():
    r = random.Random(4)
    texts = [t for _ in range(30) for t in family(r, 90, "가 나 다 라 마".split())]
    texts += [texts[0]] * 20 + ["같은 말 " * 60] * 3 + [None, "", " \n", "짧다", "쉼표 1,234 " * 50, "쉼표 1234 " * 50, "긴말" * 100_000]
    return list(enumerate(texts))


@pytest.mark.parametrize(("size", "least", "threshold"), [(2, 50, 0.6), (5, 1, 0.8)])
def test_near_duplicates(spark, copies, size, least, threshold):
    df = spark.createDataFrame(copies, SCHEMA).withColumn("class", F.lit("x")).withColumn("s", F.lit(1)).repartition(5)
    found, members = near_duplicates.similar_pairs(df, threshold, least, size)
    expected = pairs_model(copies, size, least, threshold)
    assert rows(near_duplicates.expand(found, members), "id_a", "id_b") == expected
    linked = {r["id"]: r["n_links"] for r in near_duplicates.links(found, members).collect()}
    degree = collections.Counter(x for p in expected for x in p)
    assert linked == {i: degree[i] for i, s in sets_model(copies, size).items() if len(s) >= max(least, 1)}


def test_near_duplicates_in_full_buckets(spark, copies):
    """Buckets of more than two texts go the way of hot buckets: nothing is lost."""
    found, members = near_duplicates.similar_pairs(spark.createDataFrame(copies, SCHEMA), 0.6, 50, 2, bucket=2)
    assert rows(near_duplicates.expand(found, members), "id_a", "id_b") == pairs_model(copies, 2, 50, 0.6)


def test_near_duplicates_in_a_template(spark):
    """A third of all texts share a template but too little else: all meet in a bucket, none is a pair, and the true pairs among them stay."""
    r = random.Random(6)
    frame = " ".join(f"틀{i}" for i in range(40))
    data = [(i, frame + " " + " ".join(str(r.randrange(10**8)) for _ in range(60))) for i in range(300)]
    data += [(1000 + i, t + " 끝") for i, t in data[::10]]
    for bucket in (16, 256):
        found, members = near_duplicates.similar_pairs(spark.createDataFrame(data, SCHEMA), 0.6, 50, 2, bucket=bucket)
        assert rows(near_duplicates.expand(found, members), "id_a", "id_b") == [(i, 1000 + i) for i in range(0, 300, 10)]


def test_near_duplicates_of_nothing(spark):
    found, members = near_duplicates.similar_pairs(spark.createDataFrame([], SCHEMA))
    assert found.count() == members.count() == near_duplicates.links(found, members).count() == 0


def test_masks_cover():
    """Any two differences among seven positions leave a mask untouched."""
    masks = [set(m.tolist()) for m in near_duplicates.MASKS]
    assert all(len(m) == 4 for m in masks) and len(masks) == 7
    assert all(any(not m & set(d) for m in masks) for d in itertools.combinations(range(7), 2))


# 2 repeated lines


def lines_model(data, min_ids=5, min_share=0.05):
    total, ids, places = collections.Counter(), collections.defaultdict(set), []
    for i, source, text in data:
        if source is None:
            continue
        total[source] += 1
        for n, line in enumerate((text or "").split("\n"), 1):
            key = "".join(c for c in unicodedata.normalize("NFKC", line).lower() if unicodedata.category(c)[0] == "L")
            if key and " | " not in line:
                ids[source, key].add(i)
                places.append((i, n, source, key))
    return sorted((i, n) for i, n, s, k in places if len(ids[s, k]) >= min_ids and len(ids[s, k]) >= min_share * total[s])


def test_repeated_lines(spark):
    r = random.Random(5)
    data = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        body = [f"{r.choice('가나다라')}{r.choice('abcd')}{chr(0xAC00 + r.randrange(3000))} 본문 {r.randrange(10**9)}" for _ in range(5)]
        if source == "hot" and r.random() < 0.7:
            body.insert(r.randrange(5), f"쪽 {i} / １０ 목차")
        if r.random() < 0.5:
            body += ["모두 공통 알림", "모두 공통 알림", "표 | 공통", "---", ""]
        data.append((i, source, "\n".join(body)))
    data += [(400, None, "모두 공통 알림"), (401, "s1", None), (402, "s1", ""), (403, "lone", "한 줄")]
    df = spark.createDataFrame(data, "id bigint, source string, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit(2))
    found = repeated_lines.repeated(df)
    expected = lines_model(data)
    assert expected and rows(found, "id", "line_no") == expected
    drop = set(expected)
    clean = {r["id"]: (r["text"], r["n_removed"]) for r in repeated_lines.cleaned(df, found).collect()}
    for i, _, text in data:
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if (i, n) not in drop)
        assert clean[i] == (kept, sum(1 for j, _ in drop if j == i))


def test_repeated_lines_in_one_source_alone(spark):
    data = [(i, "a", f"알림\n본문 {chr(0xAC00 + i)}{chr(0xB000 + i)}") for i in range(12)]
    assert rows(repeated_lines.repeated(spark.createDataFrame(data, "id bigint, source string, text string")), "id", "line_no") == [(i, 1) for i in range(12)]
    assert repeated_lines.repeated(spark.createDataFrame([], "id bigint, source string, text string")).count() == 0


def test_repeated_lines_at_mixed_rates(spark):
    """A notice at the level in one small source and nearly as frequent elsewhere is a case all the same."""
    data = [(100 * s + i, f"s{s}", f"본문 {chr(0xAC00 + 60 * s + i)}" + "\n알림" * (i < (5 if s == 0 else 4))) for s in range(40) for i in range(20)]
    found = rows(repeated_lines.repeated(spark.createDataFrame(data, "id bigint, source string, text string")), "id", "line_no")
    assert found == lines_model(data) == [(i, 2) for i in range(5)]


def test_places_without_tests(spark, monkeypatch):
    """Where the decision of the tests is not used they are not made; the lines at the level are the same."""
    data = [(100 * s + i, f"s{s}", f"본문 {chr(0xAC00 + 60 * s + i)}" + "\n알림" * (i < (5 if s == 0 else 4))) for s in range(40) for i in range(20)] + [(9000, None, "알림"), (9001, "s0", None)]
    df = spark.createDataFrame(data, "id bigint, source string, text string")
    all_places = rows(repeated_lines.repeated(df), "id", "line_no", "source", "n_ids")
    monkeypatch.setattr(repeated_lines, "assessed", None)
    assert rows(repeated_lines.places(df), "id", "line_no", "source", "n_ids") == all_places and len(all_places) == 5
    assert repeated_lines.places(df.limit(0)).count() == 0


def test_ordinary_words_are_no_excess():
    """The rate elsewhere counts: a share equal to it is not significant."""
    assert repeated_lines.cutoff({0: 100}, 0.05) == float("inf")
    assert repeated_lines.cutoff({0: 100, 400: 3}, 0.05) == 100.0


def test_lines_as_frequent_everywhere(spark):
    """Lines of one rate in all sources: of a thousand tests at most the stated share is called excess."""
    r = random.Random(12)
    words = [chr(0xAC00 + i) * 3 for i in range(60)]
    data = [(100 * s + i, f"s{s}", "\n".join(w for n, w in enumerate(words) if r.random() < 0.02 + 0.002 * n)) for s in range(30) for i in range(100)]
    df = spark.createDataFrame(data, "id bigint, source string, text string")
    tests = repeated_lines.assessed(df, repeated_lines.lines(df)).collect()
    assert len(tests) > 1000 and sum(t["excess"] for t in tests) <= 0.05 * len(tests)


def test_lines_in_excess(spark):
    """A line far more frequent in some sources is in excess there; the level and the rate of false discoveries decide apart."""
    r = random.Random(13)
    data = []
    for s in range(40):
        for i in range(50):
            rate = {"가": 0.5 if s < 20 else 0.0, "나": 0.1, "다": 0.16 if s == 3 else 0.08}
            body = [k * 4 for k, p in rate.items() if r.random() < p]
            data.append((50 * s + i, f"s{s}", "\n".join([*body, f"본문 {chr(0xAC00 + 50 * s + i)}"])))
    df = spark.createDataFrame(data, "id bigint, source string, text string")
    found = repeated_lines.lines(df)
    at = lambda fdr: {(t["source"], t["key"]) for t in repeated_lines.assessed(df, found, fdr).filter("excess").collect()}
    strict, usual, loose = at(1e-12), at(0.05), at(0.9)
    assert strict < loose and strict <= usual <= loose and len(usual) >= 20
    key = {t["key"]: t["n"] for t in found.filter("first").groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert sum(key[k] > 400 for _, k in usual) >= 20
    everything, excess = repeated_lines.repeated(df), repeated_lines.repeated(df, only_excess=True)
    assert rows(everything, "id", "line_no") == lines_model(data)
    assert rows(everything.filter("excess"), "id", "line_no") == rows(excess, "id", "line_no") != rows(everything, "id", "line_no")


# 3 nearest vectors


def vectors(n, seed, size=64):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 10, size))
    v = centres[r.integers(0, len(centres), n)] + 0.25 * r.normal(size=(n, size))
    return v * r.uniform(0.5, 3, (n, 1))


def brute(ids, v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
    return s, order


def test_nearest(spark):
    v = vectors(1500, 6).astype(np.float32)
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(9000, None), (9001, [0.0] * 64), (9002, [1.0, 2.0]), (9003, [float("nan")] * 64), (9004, [])]
    df = spark.createDataFrame(data + odd, "id bigint, embedding array<float>").withColumn("class", F.lit(1)).withColumn("rank", F.lit(2))
    s, order = brute(np.arange(1500), v.astype(np.float64), 10)
    exact = {(i, int(j)) for i in range(1500) for j in order[i]}
    found = set(rows(nearest.near_ids(df), "id", "near_id"))
    assert len(found) == 15_000 and len(found & exact) / 15_000 > 0.999  # one window holds them all
    narrow = set(rows(nearest.near_ids(df, window=300), "id", "near_id"))
    assert len(narrow & exact) / 15_000 > 0.9
    close = {(min(i, int(j)), max(i, int(j))) for i in range(1500) for j in order[i] if s[i, j] >= 0.85}
    assert close and set(rows(nearest.similar_pairs(df, 0.85), "id_a", "id_b")) == close


def test_nearest_of_copies(spark):
    """A third of all rows point the same way: the smallest ids are their nearest, and no window fills."""
    v = vectors(600, 7)
    v[::3] = v[0] * np.linspace(1, 2, 200)[:, None]
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    found = collections.defaultdict(list)
    for i, j, c in rows(nearest.near_ids(spark.createDataFrame(data, "id bigint, embedding array<double>"), window=100), "id", "near_id", "cosine"):
        found[i].append(j)
    smallest = list(range(0, 33, 3))
    for i in range(0, 600, 3):
        assert found[i] == [j for j in smallest if j != i][:10]


def test_nearest_in_a_tight_group(spark):
    """A third of all rows are near copies of one direction, many times a window: their lists are whole."""
    v = vectors(6000, 8)
    r = np.random.default_rng(9)
    v[::3] = v[0] / np.linalg.norm(v[0]) + 0.03 * r.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<double>")
    s, order = brute(np.arange(6000), v, 10)
    exact = {(i, int(j)) for i in range(6000) for j in order[i]}
    found = set(rows(nearest.near_ids(df, window=100), "id", "near_id"))
    assert len(found) == 60_000 and len(found & exact) / 60_000 > 0.999
    close = {(min(i, int(j)), max(i, int(j))) for i in range(6000) for j in order[i] if s[i, j] >= 0.85}
    pairs = set(rows(nearest.similar_pairs(df, 0.85, window=100), "id_a", "id_b"))
    assert len(pairs & close) / len(pairs | close) > 0.999


def test_nearest_of_random_vectors(spark):
    """Sixty windows of vectors without any group: no list is shortened by the number of windows."""
    v = np.random.default_rng(10).normal(size=(3000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<double>")
    exact = {(i, int(j)) for i, near in enumerate(brute(np.arange(3000), v, 10)[1]) for j in near}
    found = set(rows(nearest.near_ids(df, window=50), "id", "near_id"))
    assert len(found) == 30_000 and len(found & exact) / 30_000 > 0.999


def test_nearest_ties(spark):
    """Unit vectors along the axes: every other class is as near, so the smallest ids come."""
    v = np.eye(64)[np.random.default_rng(12).permutation(64)]
    found = collections.defaultdict(list)
    for i, j in rows(nearest.near_ids(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<double>"), window=7).orderBy("id", "rank"), "id", "near_id"):
        found[i].append(j)
    assert all(found[i] == [j for j in range(11) if j != i][:10] for i in range(64))


def test_nearest_of_nothing(spark):
    assert nearest.near_ids(spark.createDataFrame([], "id bigint, embedding array<float>")).count() == 0


CURVED = "id bigint, embedding array<double>"


def share_found(spark, v, **sizes):
    """Recall of whole lists of ten along curves."""
    n = len(v)
    exact = {(i, int(j)) for i, near in enumerate(brute(np.arange(n), v, 10)[1]) for j in near}
    found = rows(nearest.curve_ids(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], CURVED), **sizes), "id", "near_id")
    assert len(found) == len(set(found)) == 10 * n
    return len(set(found) & exact) / (10 * n)


def test_curves_in_groups(spark):
    """Ten windows a curve and more: nearly all of the lists of vectors that lie in groups; all where a window holds the table."""
    v = vectors(3000, 6)
    assert share_found(spark, v) == 1
    assert share_found(spark, v, window=300) > 0.97


def test_curves_of_random_vectors(spark):
    """Vectors without any group, the hardest case, sixteen windows a curve, as many as a table of 130,000 has by default."""
    v = np.random.default_rng(10).normal(size=(4000, 64))
    assert share_found(spark, v, window=250) > 0.9


def test_curves_in_a_tight_group(spark):
    """A third of all rows are near copies of one direction, many times a window."""
    v = vectors(6000, 8)
    v[::3] = v[0] / np.linalg.norm(v[0]) + 0.03 * np.random.default_rng(9).normal(size=(2000, 64))
    assert share_found(spark, v, window=400) > 0.9


def test_curves_with_odd_rows(spark):
    """Null, zero, short and non-finite vectors take no part, copies are each other's nearest, other columns do not matter."""
    v = vectors(600, 7)
    v[::3] = v[0] * np.linspace(1, 2, 200)[:, None]
    odd = [(9000, None), (9001, [0.0] * 64), (9002, [1.0, 2.0]), (9003, [float("nan")] * 64), (9004, [])]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, CURVED).withColumn("class", F.lit(1)).withColumn("key", F.lit(2))
    found = collections.defaultdict(list)
    for i, j in rows(nearest.curve_ids(df, window=100), "id", "near_id"):
        found[i].append(j)
    assert set(found) == set(range(600))
    smallest = list(range(0, 33, 3))
    assert all(found[i] == [j for j in smallest if j != i][:10] for i in range(0, 600, 3))
    assert rows(nearest.curve_pairs(df, 0.85), "id_a", "id_b") == rows(nearest.similar_pairs(df, 0.85), "id_a", "id_b")
    assert nearest.curve_ids(df.limit(0)).count() == nearest.curve_pairs(df.limit(0), 0.85).count() == 0
    assert nearest.recall(df, F.col("id") < 50).first()["recall"] == 1


def test_curves_of_small_groups_of_copies(spark):
    """Every class has one to three members and each list names ids of all members: as all with all; a row without an id takes no part."""
    v = vectors(400, 14)
    v = np.concatenate([v, 2 * v[:200], 3 * v[:100]])
    ids = np.random.default_rng(15).permutation(len(v)) * 7 - 900
    data = [(int(i), x.tolist()) for i, x in zip(ids, v)] + [(None, v[0].tolist())]
    df = spark.createDataFrame(data, CURVED).repartition(4)
    s, _ = brute(ids, v, 10)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s.round(9)), axis=1)[:, :10]  # copies are ties
    exact = {(int(i), int(ids[j])) for i, near in zip(ids, order) for j in near}
    found = rows(nearest.curve_ids(df), "id", "near_id")
    assert len(found) == len(set(found)) == 7000
    assert len(set(found) & exact) / 7000 > 0.999
    assert set(found) == set(rows(nearest.near_ids(df), "id", "near_id"))
    ranks = collections.defaultdict(list)
    for i, r, c in rows(nearest.curve_ids(df, window=100), "id", "rank", "cosine"):
        ranks[i].append((r, c))
    assert all([r for r, _ in sorted(x)] == list(range(1, 11)) and [c for _, c in sorted(x)] == sorted((c for _, c in x), reverse=True) for x in ranks.values())


def test_lists_packed():
    """Lists come back from bytes as they were, any id and empty places included."""
    r = np.random.default_rng(16)
    near = r.integers(-(2**63), 2**63 - 1, (50, 10))
    cosine = np.where(r.random((50, 10)) < 0.3, nearest.NONE, r.random((50, 10)).astype(np.float32))
    back = nearest._unpacked(nearest._packed(near, cosine), 10)
    assert (back[0] == near).all() and (back[1] == cosine).all()
    for n in (0, 7, 64, 1000):
        x = r.random((n, 8)) < 0.1
        assert (nearest._true(x) == np.flatnonzero(x)).all() and (nearest._true(x[:, :7]) == np.flatnonzero(x[:, :7])).all()


def test_hilbert_is_a_walk():
    """Each step of the curve goes to a neighbouring cell, and every cell is met once."""
    points = np.array(list(itertools.product(range(8), repeat=3)))
    h = nearest.hilbert(points, 3)
    walk = points[np.argsort(h)]
    assert sorted(h.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# 4 splitting


@settings(max_examples=60, deadline=None)
@given(st.text("가ab. \n|。", min_size=0, max_size=600), st.integers(5, 80), st.sampled_from(["table", "paragraph"]))
def test_cuts(text, limit, kind):
    if len(text) <= limit:
        return
    found = splitting.cuts(text, kind, limit, max(1, limit // 10))
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in found)
    assert all(a < c < b < e for (a, b), (c, e) in itertools.pairwise(found))
    back = text[found[0][0] : found[0][1]] + "".join(text[b:e] for (_, b), (_, e) in itertools.pairwise(found))
    assert back == text


@settings(max_examples=60, deadline=None)
@given(st.text("가ab. \n|。", min_size=300, max_size=900), st.integers(40, 120), st.integers(8, 20), st.integers(0, 5), st.sampled_from(["table", "paragraph"]))
def test_shared_characters(text, limit, overlap, tolerance, kind):
    """Exactly the stated overlap, or a line or sentence begins within the tolerance."""
    tolerance = min(tolerance, overlap // 4)
    starts = {m.end() for m in re.finditer("\n", text)} | {0}
    if kind == "paragraph":
        starts |= {m.end() for m in splitting.SENTENCE_END.finditer(text)}
    found = splitting.cuts(text, kind, limit, overlap, tolerance)
    for (_, end), (begin, _) in itertools.pairwise(found):
        near = [s for s in starts if abs(s - (end - overlap)) <= tolerance]
        assert begin in near if near else end - begin == overlap


def test_pieces_of_words_without_lines():
    """No line or sentence anywhere: every overlap is the stated one."""
    for stated in (90, 150, 300):
        found = splitting.cuts("낱말 " * 3000, "paragraph", 900, stated)
        assert {end - begin for (_, end), (begin, _) in itertools.pairwise(found)} == {stated}


def test_pieces(spark):
    row = "항목 | 1,234 | 5,678"
    table = "구분 | 당기 | 전기\n" + "\n".join(row for _ in range(300))
    prose = "첫 문장입니다. " * 300
    data = [(1, ["a"], " TABLE ", table), (2, [], "paragraph", prose), (3, ["b"], None, table), (4, None, None, prose), (5, ["c"], "table", "짧은 표"), (6, ["c"], "paragraph", None), (7, ["c"], "paragraph", "가" * 5000), (8, ["c"], "paragraph", "😀" * 900), (9, ["c"], "paragraph", "😀" * 901), (1, ["a"], " TABLE ", table)]
    df = spark.createDataFrame(data, "id bigint, section_path array<string>, chunk_type string, text string").withColumn("begin", F.lit(1))
    found = splitting.pieces(df).collect()
    assert {r["id"] for r in found} == {1, 2, 3, 4, 7, 9}
    kinds = {r["id"]: r["chunk_type"] for r in found}
    assert kinds == {1: "table", 2: "paragraph", 3: "table", 4: "paragraph", 7: "paragraph", 9: "paragraph"}
    texts = {i: t for i, _, _, t in data}
    for r in found:
        assert r["text"] == texts[r["id"]][r["begin"] : r["end"]] and len(r["text"]) <= splitting.LIMITS[r["chunk_type"]]
        if r["id"] in (1, 3):
            assert r["text"].startswith(("구분", "항목")) and (r["text"].endswith("\n") or r["end"] == len(table))
        if r["id"] == 2 and r["end"] < len(prose):
            assert r["text"].endswith(". ")
    assert splitting.pieces(df.limit(0)).count() == 0


# 5 broken pairs

CASES = [
    ("가회사의 매출액은 얼마인가요?", None, "empty"),
    ("가회사의 매출액은 얼마인가요?", " ​　", "empty"),
    ("가회사의 매출액은 얼마인가요?", "답변: N/A", "empty"),
    ("가회사의 매출액은 얼마인가요?", "답변: 가회사의 매출액은 얼마인가요", "copy"),
    ("가회사의 매출액은 얼마인가요?", "Q. 가회사의 매출액은 얼마인가요?\nA. 가회사의 매출액은 얼마인가요?", "copy"),
    ("가회사의 매출액은 얼마인가요?", "가회사의 매출액은", "truncated"),
    ("가회사의 매출액은 얼마인가요?", "매출액은 12,345백만원으로 확인됩니", "truncated"),
    ("가회사의 매출액은 얼마인가요?", "12,345원 (당기, 연결 기준", "truncated"),
    ("가회사의 매출액은 얼마인가요?", "- 당기: 12,345원\n- 전기:", "truncated"),
    ("가회사의 매출액은 얼마인가요?", "- 당기: 12,345원\n- 전기: 2,345원", None),
    ("가회사의 매출액은 얼마인가요?", "12,345", None),
    ("가회사의 매출액은 얼마인가요?", "**12,345원**", None),
    ("가회사의 매출액은 얼마인가요?", "정확한 비교는 어렵지만 매출액은 12,345원입니다.", None),
    ("가회사의 매출액은 얼마인가요?", "제공된 자료에서 확인할 수 없습니다", "refusal"),
    ("What was the revenue of 가회사?", "I cannot answer that question.", "refusal"),
    ("What was the revenue of 가회사?", "The revenue of 가회사 was", "truncated"),
    ("What was the revenue of 가회사?", "12,345 won", None),
    ("What was the revenue of 가회사?", "가회사의 매출액은 12,345원입니다.", "language"),
    ("가회사의 매출액은 얼마인가요?", "根据年度报告，金额为12,345韩元。", "language"),
    ("가회사의 매출액은 얼마인가요?", "K-IFRS(Consolidated) 기준 12,345원입니다.", None),
    (None, "12,345원입니다.", None),
    # phrases that no table was read for
    ("What was the revenue of 가회사?", "The filing is silent on this figure.", "refusal"),
    ("What was the revenue of 가회사?", "That number has not been publicly disclosed.", "refusal"),
    ("What was the revenue of 가회사?", "There is no mention of it in the filing.", "refusal"),
    ("What was the revenue of 가회사?", "Not disclosed is the cost, but revenue was 5 billion.", None),
    ("가회사의 매출액은 얼마인가요?", "해당 수치는 공개된 바 없습니다.", "refusal"),
    ("가회사의 매출액은 얼마인가요?", "그 값은 자료에 나타나 있지 않아 말씀드리기 곤란합니다.", "refusal"),
    ("가회사의 매출액은 얼마인가요?", "Данные недоступны.", "refusal"),
    ("What was the revenue of 가회사?", "Il fatturato della società è stato di cinque miliardi di euro.", "language"),
    ("What was the revenue of 가회사?", "Выручка составила пять миллиардов.", "language"),
    ("What was the revenue of 가회사?", "A receita da empresa foi de cinco bilhões no ano.", "language"),
    ("What was the revenue of 가회사?", "Le chiffre d'affaires de la société était de cinq milliards.", "language"),
    ("가회사의 매출액은 얼마인가요?", "รายได้คือห้าพันล้าน วอน ตามรายงาน.", "language"),
]


@pytest.mark.parametrize(("question", "answer", "kind"), CASES)
def test_defect(question, answer, kind):
    assert pairs.defect(question, answer)[0] == kind


def test_defects(spark):
    data = [(i, q, a) for i, (q, a, _) in enumerate(CASES)] + [(99, "질문?", "말" * 200_000 + "입니다.")]
    df = spark.createDataFrame(data, "id bigint, question string, answer string").withColumn("defect", F.lit(True))
    assert rows(pairs.defects(df), "id", "defect") == sorted((i, k) for i, (_, _, k) in enumerate(CASES) if k)
    assert pairs.defects(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text("ab가", max_size=30), st.text("ab가", max_size=40), st.integers(1, 5))
def test_suffix_automaton(text, other, least):
    covered = set()
    longest = 0
    for i, j in itertools.combinations(range(len(other) + 1), 2):
        if other[i:j] in text:
            longest = max(longest, j - i)
            if j - i >= least:
                covered |= set(range(i, j))
    assert pairs.SuffixAutomaton(text).walk(other, least) == (len(covered), longest)


# 6 packing


def test_packing(spark):
    r = random.Random(8)
    data = [(i, r.choice([0, 1, 5, 100, 300, r.randrange(1, 5000)]), "글") for i in range(3000)]
    data += [(3000 + i, 700, None) for i in range(1500)] + [(5000, 2048, ""), (5001, 2049, ""), (5002, 100_000, ""), (5003, 700, None), (5003, 700, None)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint, text string").withColumn("container", F.lit(-1))
    found = packing.packed(df).collect()
    total = collections.Counter()
    for x in found:
        total[x["container"]] += x["tokens"]
    whole = collections.Counter()
    for x in found:
        whole[x["doc_id"]] += x["tokens"]
    wanted = collections.Counter()
    for i, n, _ in data:
        wanted[i] += n
    assert {k: v for k, v in whole.items()} == {k: v for k, v in wanted.items()}
    assert max(total.values()) <= 2048 and sorted(total) == list(range(len(total)))
    assert all(x["piece_no"] == 1 for x in found if wanted[x["doc_id"]] <= 2048 and x["doc_id"] != 5003)
    bins: list[int] = []  # first fit decreasing
    for n in sorted((x["tokens"] for x in found), reverse=True):
        at = next((k for k, room in enumerate(bins) if room >= n), None)
        if at is None:
            bins.append(2048 - n)
        else:
            bins[at] -= n
    assert len(total) <= 1.02 * len(bins)


def test_packing_edges(spark, monkeypatch):
    schema = "doc_id bigint, n_tokens bigint, text string"
    assert packing.packed(spark.createDataFrame([], schema)).count() == 0
    assert rows(packing.packed(spark.createDataFrame([(1, 0, "")], schema)), "doc_id", "tokens", "container") == [(1, 0, 0)]
    if os.path.exists(packing.TOKENIZER):
        found = rows(packing.packed(spark.createDataFrame([(1, None, "hello world"), (2, None, None), (3, -5, "a")], schema)), "doc_id", "tokens")
        assert found == [(1, 2), (2, 0), (3, 1)]


@settings(max_examples=5, deadline=None)
@given(histogram=st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=10))
def test_fill(spark, histogram):
    sizes = np.array(sorted(histogram))
    counts = np.array([histogram[s] for s in sizes.tolist()])
    filled = packing.Fill(spark, sizes, counts, 60)
    used = np.zeros(len(sizes), int)
    for at, a, times in filled.taken:
        assert (sizes[at] * a).sum() <= 60
        used[at] += a * times
    assert (used == counts).all()
    program, covered = filled.programs[0], np.zeros(len(sizes))
    for (at, a), times in program.use:
        assert (sizes[at] * a).sum() <= 60
        covered[at] += a * times
    assert np.allclose(covered, counts) and program.bound <= program.value + 1e-6 and filled.n >= program.bound - 1e-6


def test_knapsacks_are_best():
    """Against a plain recursion over all sizes."""
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.unique(r.integers(1, 20, 5))
        values = r.random((2, len(sizes))).astype(np.float32)
        best, first = packing.knapsacks(sizes, values, 40)
        for row in range(2):
            plain = [0.0]
            for c in range(1, 41):
                plain.append(max([plain[c - 1]] + [plain[c - s] + float(v) for s, v in zip(sizes.tolist(), values[row]) if s <= c]))
            assert np.allclose(best[row], plain, atol=1e-5)
            held = packing.traced(first[row].tolist(), sizes, 40)
            assert sizes[held].sum() <= 40 and abs(values[row][held].sum() - plain[-1]) < 1e-4


def test_program(spark):
    """Close to its own lower bound, every length covered in full, most containers from rounding."""
    sizes = np.arange(30, 1500, 7)
    counts = np.random.default_rng(4).integers(1, 30, len(sizes))
    filled = packing.Fill(spark, sizes, counts)
    first = filled.programs[0]
    assert first.bound <= first.value <= 1.01 * first.bound
    assert filled.rounded >= 0.9 * filled.n and filled.n <= 1.01 * first.bound + 1


# 7 leakage


def leaks_model(docs, items, n):
    norm = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if unicodedata.category(c)[0] in "LN")
    out = []
    for d, t in docs:
        a = norm(t)
        for i, p in items:
            b = norm(p)
            best = max((k for k in range(n, len(b) + 1) if any(b[s : s + k] in a for s in range(len(b) - k + 1))), default=0)
            if best:
                out.append((d, i, best))
    return sorted(out)


def test_leaks(spark):
    r = random.Random(9)
    word = lambda: "".join(chr(0xAC00 + r.randrange(400)) for _ in range(3))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(50, None), (51, ""), (52, "짧다")]
    items.append((53, items[0][1]))
    docs = [(100, None), (101, ""), (102, "짧은 글")]
    for d in range(60):
        text = " ".join(word() for _ in range(r.randrange(1, 60)))
        if d % 2:
            p = items[r.randrange(12)][1]
            a = r.randrange(60)
            k = r.randrange(15, 60)
            text = text[:20] + p[a : a + k].upper() + text[20:]
        if d == 7:
            text = unicodedata.normalize("NFD", items[3][1])
        if d == 9:
            text = "\0".join([items[4][1][:50], items[4][1][50:]])
        docs.append((d, text))
    docs.append((200, items[1][1] * 2000 + items[2][1]))
    a = spark.createDataFrame(docs, SCHEMA).withColumn("doc_id", F.lit("x")).repartition(3)
    b = spark.createDataFrame(items, "id bigint, passage string").withColumn("text", F.lit(1))
    expected = leaks_model(docs[:-1], items, 20)
    for stride, block in ((1, 10**6), (16, 300)):
        found = rows(leakage.leaks(a, b, 20, stride, block), "doc_id", "item_id", "length")
        assert [x for x in found if x[0] != 200] == expected
        assert {x[1] for x in found if x[0] == 200} == {1, 2}
    kept = leakage.without_leaks(a, leakage.leaks(a, b, 20), "id")
    assert {r["id"] for r in kept.collect()} == {d for d, _ in docs} - {x[0] for x in expected} - {200}
    assert leakage.leaks(a, b.limit(0)).count() == leakage.leaks(a.limit(0), b).count() == 0


def test_leaks_of_a_common_run(spark):
    """A run of characters in every passage and document, far more hits than are followed at once."""
    run = "가나다라마바사아자차" * 6
    items = [(i, run + f"문항{i}" * 3) for i in range(40)]
    docs = [(i, f"머리{i} " + run + f"문항{i % 50}" * 3 + " 꼬리") for i in range(120)]
    shard = leakage.Shard([t for _, t in docs], 20 - 16 + 1, 16)
    block = leakage.Block(np.arange(40), [t for _, t in items], 20 - 16 + 1)
    for once in (1, 1000, 10**7):
        text, passage, length, _, _ = shard.matches(block, 20, once)
        assert sorted(zip(text.tolist(), passage.tolist(), length.tolist())) == leaks_model(docs, items, 20)


# 8 languages


def test_markup_of_any_length():
    """Long tags are markup; comparison signs far apart are not; an open tag costs no more than its length."""
    image = "<img src='data:image/png;base64," + "QUJD" * 2000 + "'/>"
    style = "<td nowrap style='" + "margin: 0; " * 300 + "'>"
    assert languages.MARKUP.sub("", f"앞{image}뒤<!-- {'note ' * 500}-->끝{style}칸") == "앞뒤끝칸"
    words = "a < b " + "plain words " * 100 + "c > d"
    assert languages.MARKUP.sub("", words) == words
    began = time.process_time()
    languages.MARKUP.sub("", "<a b=" + "c = " * 200_000 + "<a " * 100_000)
    assert time.process_time() - began < 5


SAID = {
    "en": "The company shipped {} units of filters to the home market during the year. The board approved a new budget for the line.",
    "de": "Das Unternehmen lieferte im Jahr {} Stück nach Nordeuropa. Der Aufsichtsrat genehmigte ein neues Budget für die Anlage.",
    "es": "La empresa entregó {} unidades en América Latina durante el año. El consejo aprobó un nuevo presupuesto para la línea.",
    "ko": "회사는 올해 {}대를 내수시장에 공급하였습니다. 이사회는 신설 예산을 승인하였습니다.",
    "ja": "当社は今年度に{}台を国内市場へ出荷しました。取締役会は新ラインの予算を承認した。",
    "zh": "本年度公司向国内市场交付了{}台设备。董事会批准了新产线的预算。",
}
WORDS = {"en": "stock growth loans sales goods", "de": "Anleihen Umsatz Bestand Werk Lager", "es": "ventas deuda acciones planta bienes", "ko": "매출 자산 부채 재고 설비", "ja": "売上 資産 負債 在庫 設備", "zh": "销售 资产 负债 库存 设备"}


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SAID) + ["ko"] * 6)
        body = "\n".join(f"{r.choice(WORDS[lang].split())}: {SAID[lang].format(r.randrange(10**6))}" for _ in range(r.randrange(2, 5)))
        label = r.choice(list(SAID)) if r.random() < 0.1 else {0: lang, 1: lang.upper(), 2: f" {lang}-XX ", 3: f"{lang}_xx"}[r.randrange(4)]
        out.append((i, body, label, lang))
    return out


def test_languages(spark):
    data = corpus(900, 10)
    train = spark.createDataFrame([x[:3] for x in data], "id bigint, text string, label string")
    models = languages.train(train)
    held = corpus(300, 11)
    mixed = [(1000, SAID["ko"].format(1) + "\n" + SAID["de"].format(2), "ko", None), (1001, "<b>" + SAID["ko"].format(1) + "</b>&nbsp;", "ko", None), (1002, None, "ko", None), (1003, " 123 ", "en", None), (1004, SAID["en"].format(3), None, None), (1005, SAID["en"].format(3), "??", None)]
    df = spark.createDataFrame([x[:3] for x in held + mixed], "id bigint, text string, label string").withColumn("lang", F.lit(1)).withColumn("share", F.lit(2))
    found = collections.defaultdict(list)
    for r in languages.document_languages(df, models).collect():
        found[r["id"]].append(r["lang"])
        assert 0 < r["confidence"] <= 1 + 1e-9
    assert sum(found[i] == [lang] for i, _, _, lang in held) / len(held) > 0.99
    wrong = {r["id"] for r in languages.wrong_labels(df, models).collect()}
    base = lambda x: re.split("[-_]", x.strip().lower())[0]
    assert {i for i in wrong if i < 1000} == {i for i, _, label, lang in held if base(label) != lang}
    assert {i for i in wrong if i >= 1000} == {1000, 1004, 1005} and sorted(found[1000]) == ["de", "ko"] and 1003 not in found
    pieces = languages.stretches(df.filter("id = 1000"), models).orderBy("stretch_no").collect()
    assert [r["lang"] for r in pieces] == ["ko", "de"] and pieces[0]["end"] <= pieces[1]["begin"]
    assert languages.document_languages(df.limit(0), models).count() == 0


def test_levels_come_from_all_labelled_documents(spark):
    """Every labelled sentence is scored by models that have not seen it, and counts; a language all of whose texts fall in one part has a model too."""
    data = [(f"{a} {b} {c} schönes Wetter über München. Grüße für {b}.", "de") for a in ("Das", "Ein", "Kein", "Dieses") for b in ("Haus", "Kind", "Buch", "Dorf") for c in ("hat", "sieht", "kennt")]
    data += [(f"그 {a}는 {b} 한국어로 쓴 문장이다. {b} 책을 읽는다.", "ko") for a in ("사람", "아이", "선생", "학생") for b in ("오늘", "내일", "어제", "아침")]
    thin = [(f"Это предложение номер {w} написано по-русски. Конец {w}.", "ru") for w in ("один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять", "десять", "много", "мало", "снова", "опять", "теперь", "потом", "здесь", "там", "вчера", "завтра", "утром", "днём", "вечером", "ночью")]
    df = spark.createDataFrame([(i, t, label) for i, (t, label) in enumerate([*data, *thin])], "id bigint, text string, label string")
    one = F.pmod(F.xxhash64(F.lit("held out"), "text"), F.lit(5)) == 0
    df = df.filter((F.col("label") != "ru") | one)
    assert df.filter("label = 'ru'").count() >= languages.LEAST
    models = languages.train(df)
    assert models.languages == ["de", "ko", "ru"]
    assert [models.seen[i, 0] for i in range(2)] == [2 * 48, 2 * 16]
    assert {r["lang"] for r in languages.document_languages(df.filter("label = 'ru'"), models).collect()} == {"ru"}


def test_all_labelled_documents_train(spark):
    """Which documents train does not depend on their ids, and a sequence of one document among many is counted."""
    df = spark.createDataFrame([x[:3] for x in corpus(3000, 10)] + [(5000, SAID["ko"].format(1) + "\n쀍뛟 매출", "ko")], "id bigint, text string, label string")
    one, other = languages.train(df), languages.train(df.withColumn("id", F.col("id") + 10**7))
    assert one.languages == other.languages == sorted(SAID) and all((one.tables[k].h == other.tables[k].h).all() for k in one.tables)
    assert (one.tables[2].find(np.array([ord("쀍") << 16 | ord("뛟")], np.uint64)) >= 0).all() and np.array_equal(one.limit, other.limit)


def test_unknown_languages(spark):
    """Texts of languages without labels are told as such, with the confidence of the rejection, whatever their label."""
    models = languages.train(spark.createDataFrame([x[:3] for x in corpus(900, 10)], "id bigint, text string, label string"))
    assert models.languages == sorted(SAID)
    odd = {1: "Выручка общества за отчётный год составила пять миллиардов рублей. Совет одобрил новый бюджет линии.", 2: "บริษัทส่งมอบสินค้าให้ตลาดในประเทศตลอดทั้งปี", 3: "Η εταιρεία παρέδωσε φίλτρα στην εγχώρια αγορά κατά τη διάρκεια του έτους."}
    df = spark.createDataFrame([(i, t, "ko") for i, t in odd.items()] + [(9, SAID["ko"].format(5), "ko")], "id bigint, text string, label string")
    found = languages.unknown_texts(df, models).collect()
    assert {r["id"] for r in found} == {1, 2, 3} and all(r["share"] > 0.99 and 0.9 < r["confidence"] < 1 for r in found)
    assert languages.wrong_labels(df, models).count() == 0


def test_a_seventh_language(spark):
    """Languages come from the labels; a label on texts of another language gets no model."""
    said = "La société a livré {} unités de filtres au marché intérieur pendant l'année. Le conseil a approuvé un nouveau budget pour la ligne."
    data = corpus(900, 10) + [(5000 + i, said.format(i * 37), "fr" if i % 10 else "FR-ca", "fr") for i in range(60)] + [(6000 + i, SAID["ko"].format(i), "xx", "ko") for i in range(12)]
    df = spark.createDataFrame([x[:3] for x in data], "id bigint, text string, label string")
    models = languages.train(df)
    assert models.languages == sorted([*SAID, "fr"])
    assert {r["id"] for r in languages.wrong_labels(df, models).filter("id >= 5000").collect()} == set(range(6000, 6012))


def test_places_in_the_text_as_delivered(spark):
    models = languages.train(spark.createDataFrame([x[:3] for x in corpus(900, 10)], "id bigint, text string, label string"))
    ko, de = unicodedata.normalize("NFD", SAID["ko"].format(1)), SAID["de"].format(2)
    text = f"<b>{ko}</b>\n&nbsp;{de}\n㈜ {SAID['ko'].format(3)}"
    found = languages.stretches(spark.createDataFrame([(1, text)], "id bigint, text string"), models).orderBy("stretch_no").collect()
    pieces = [(r["lang"], text[r["begin"] : r["end"]]) for r in found]
    assert [lang for lang, _ in pieces] == ["ko", "de", "ko"] and ko in pieces[0][1] and de in pieces[1][1] and pieces[2][1].startswith("㈜")
    for sample in (text, "plain", "ﾊﾞﾟ가각ﬁnal İ e\u0301", unicodedata.normalize("NFD", "각 é ご")):
        place, clean = languages.delivered(sample), unicodedata.normalize("NFKC", languages.MARKUP.sub(" ", sample)).lower()
        assert len(place) == len(clean) + 1 and (np.diff(place) >= 0).all() and place[-1] == len(sample)


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, SAID["en"].format(1), None)], "id bigint, text string, label string")
    models = languages.train(df)
    assert [(r["lang"], r["confidence"]) for r in languages.document_languages(df, models).collect()] == [("und", 0.0)]
    assert languages.wrong_labels(df, models).count() == 0


def test_kneser_ney_sums_to_one():
    """Over all seen symbols and the mass kept for others, a context's probabilities add up to 1."""
    text = np.array([ord(c) for c in "abracadabra abracadabra banana"], np.uint64)
    g = text[3:] | (text[2:-1] << np.uint64(16)) | (text[1:-2] << np.uint64(32)) | (text[:-3] << np.uint64(48))
    keys, n = np.unique(g, return_counts=True)
    m = languages.Models(["x"], {"x": (keys, n.astype(float))})
    letters = np.unique(text)
    for context in (g[0] >> np.uint64(16), g[5] >> np.uint64(16), np.uint64(0x7A007A007A)):
        p = np.exp(m.score((np.uint64(context) << np.uint64(16)) | letters)[:, 0].astype(float))
        other = np.exp(m.score(np.array([(np.uint64(context) << np.uint64(16)) | np.uint64(0x3042)]))[0, 0].astype(float))
        assert abs(p.sum() + other * (languages.SYMBOLS - len(letters)) - 1) < 1e-3


def test_texts_are_normalised_one_by_one(monkeypatch):
    """A text that needs it does not have all others of its batch rewritten; code points are those of all texts at once."""
    from filedeck.llm import codes

    texts, seen, whole = ["가나" * 500, None, "ﬁ ＡΣ", "a\0b", "ΑΣ"], [], unicodedata.normalize
    monkeypatch.setattr(codes.unicodedata, "normalize", lambda form, t: (seen.append(t), whole(form, t))[1])
    found = codes.joined(texts, nfkc=True)
    assert max(map(len, seen)) == 1000
    assert "".join(map(chr, found)) == whole("NFKC", "".join((t or "").replace("\0", " ") + "\0" for t in texts)).lower()


def test_sequences_by_label_and_part(monkeypatch):
    """Counts of each label and part, whatever the slices; texts without letters have none."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(languages, "AT_ONCE", 40)
    texts, label, fold = ["abc abd", "xyz xyz xyz", None, "abc", "12", "xyz yzx " * 9], ["b", "a", "a", "b", "a", "a"], [1, 0, 2, 1, 1, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(label), pa.array(fold, pa.int32())], ["text", "label", "fold"])

    def counted(votes, folds):
        parts = list(languages._count(votes, ["a", "b"], folds)([batch, batch]))
        return {(lang, f, int(np.int64(g).astype(np.uint64))): n for part in parts for lang, g, f, n in zip(*(c.to_pylist() for c in part.columns))}

    def expected(of):
        out = collections.Counter()
        for t, lang, f in zip(texts, label, of):
            for g in languages.Sentences([t]).grams.tolist():
                out[lang, f, g] += 2
        return dict(out)

    under = counted(None, 1)
    assert under == expected([0] * len(texts))
    grams = {lang: tuple(map(np.array, zip(*sorted((g, n) for (x, _, g), n in under.items() if x == lang)))) for lang in "ab"}
    votes = languages.Votes(["a", "b"], {lang: (k.astype(np.uint64), n.astype(float)) for lang, (k, n) in grams.items()})
    assert counted(SimpleNamespace(value=votes), 3) == expected(fold)
