"""The pN_ queries on the smallest tables, with SQL against DuckDB, the others against plain Python."""

import collections
import glob
import os

import duckdb
import numpy as np
import pytest

from filedeck.llm import pairs, repeated_lines
from filedeck.llm import queries as llm


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def table(db, sql):
    return db.execute(sql).fetchall()


def lines_of(db, found):
    """Counts of every line in two or more chunks of a filing."""
    ids, total = collections.defaultdict(set), collections.Counter()
    for i, source, text in table(db, "SELECT id, rcept_no, text FROM chunks WHERE rcept_no IS NOT NULL"):
        total[source] += 1
        for line in (text or "").split("\n"):
            if key := repeated_lines.line_key(line):
                ids[source, key].add(i)
    expected = collections.Counter((s, len(x), total[s], len(x) >= 5 and len(x) >= 0.05 * total[s]) for (s, _), x in ids.items() if len(x) >= 2)
    assert collections.Counter((r["rcept_no"], r["n_ids"], r["n"], r["at_level"]) for r in found) == expected
    assert all(r["excess"] for r in found if r["at_level"])


def lists_of(db, found):
    """A table of one window: the lists are the exact ones."""
    rows = [(i, np.array(v, float)) for i, v in table(db, "SELECT id, embedding FROM chunks WHERE embedding IS NOT NULL ORDER BY id") if any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in rows])
    s = u @ u.T
    np.fill_diagonal(s, -2)
    expected = {(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in np.argsort(-s[a], kind="stable")[:10]}
    assert {(r["id"], r["near_id"]) for r in found} == expected


def recall_of(db, found):
    assert len(found) == 1 and found[0]["recall"] == 1


def pieces_of(db, found):
    texts = dict(table(db, "SELECT id, text FROM chunks"))
    assert all(texts[r["id"]][r["begin"] : r["end"]] == r["text"] for r in found) and all(r["n_pieces"] >= r["piece_no"] for r in found)


def defects_of(db, found):
    expected = {i: pairs.defect(q, a)[0] for i, q, a in table(db, "SELECT item_id, question, answer FROM baseline_items")}
    assert {r["item_id"]: r["defect"] for r in found if r["defect"]} == {i: k for i, k in expected.items() if k}


def places_of(db, found):
    wanted = dict(table(db, "SELECT doc_id, n_tokens FROM documents"))
    whole, held = collections.Counter(), collections.Counter()
    for r in found:
        whole[r["doc_id"]] += r["tokens"]
        held[r["container"]] += r["tokens"]
    assert set(whole) == set(wanted) and all(whole[i] == n for i, n in wanted.items() if n is not None and n >= 0)
    assert max(held.values()) <= 2048 and sorted(held) == list(range(len(held))) and len(held) <= 1.03 * sum(held.values()) / 2048 + 1


def containers_of(db, found):
    assert all(r["tokens"] + r["unused"] == 2048 and r["unused"] >= 0 for r in found)


def program_of(db, found):
    (r,) = found
    # a table of twenty containers, few for a program
    assert r["bound"] <= r["value"] <= 1.05 * r["bound"] and abs(r["covered"] - 1) < 1e-6 and r["containers"] >= r["bound"] - 1e-6


def languages_of(db, found):
    ids = {i for (i,) in table(db, "SELECT doc_id FROM documents")}
    assert {r["doc_id"] for r in found} <= ids and all(0 <= r.asDict().get("confidence", 0) <= 1 for r in found)


def stretches_of(db, found):
    texts = dict(table(db, "SELECT doc_id, text FROM documents"))
    assert found and all(0 <= r["begin"] < r["end"] <= len(texts[r["doc_id"]]) for r in found)
    assert all(any(c.isalpha() for c in texts[r["doc_id"]][r["begin"] : r["end"]]) for r in found)


MODELS = {"p2_lines": lines_of, "p3_topk": lists_of, "p3_recall": recall_of, "p4_pieces": pieces_of, "p5_found": defects_of, "p5_defects": defects_of, "p6_pack": places_of, "p6_containers": containers_of}
MODELS |= {"p6_program": program_of, "p8_found": languages_of, "p8_languages": languages_of, "p8_unknown": languages_of, "p8_stretches": stretches_of}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, sf, db, name):
    df = llm.queries()[name](spark, sf)
    if name not in llm.oracle_sql():
        MODELS[name](db, df.collect())
        return
    columns = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert mine == sorted((tuple(r) for r in found), key=repr)
