"""The registered queries run on the smallest tables, and those with SQL agree with DuckDB."""

import collections
import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from filedeck.operators import search
from filedeck.plans import catalog, oracles


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.isoformat(sep=" ") if hasattr(v, "hour") else str(v) if hasattr(v, "year") else v


def test_entry(spark):
    assert entry.entry(spark).columns


def test_names():
    assert set(oracles.ORACLES) <= set(catalog.queries())


# Queries without SQL, against plain Python over the same tables


def parts_of(text, most=1500):
    head, *body = text.split("\n")
    if len(text) <= most:
        return [text]
    out = []
    for row in body:
        if out and len(out[-1]) + 1 + len(row) <= most:
            out[-1] += "\n" + row
        else:
            out.append(head + "\n" + row)
    return out


def packed(text, source, target):
    out, held, blanks = [], [], 0
    for line in text.split("\n"):
        if not line.strip():
            blanks += 1
            continue
        section = (source or "", str(blanks))
        if " | " in line and len(line) >= 200:
            held = []
            out += [(section, "table", t) for t in parts_of(line)]
            continue
        if not held or held[0] != section or sum(map(len, held[1:])) + len(line) > target:
            held = [section]
            out.append(None)
        held.append(line)
        out[-1] = (section, "paragraph", "\n".join(held[1:]))
    return out


def packed_chunks(db):
    out = []
    for doc, text, source in db.execute("SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL").fetchall():
        seen = collections.Counter()
        for n, (section, kind, chunk) in enumerate(packed(text, source, 900)):
            out.append({"doc_id": doc, "ordinal": n, "section": section, "type": kind, "text": chunk, "chunk_index": seen[section]})
            seen[section] += 1
    return out


def packed_chunks_by_target(db):
    docs = db.execute("SELECT text, source FROM documents WHERE text IS NOT NULL").fetchall()
    made = {t: [len(x[2]) for text, source in docs for x in packed(text, source, t)] for t in (600, 900, 1200)}
    return [{"target": t, "n_chunks": len(n), "n_chars": sum(n), "longest": max(n)} for t, n in made.items()]


def split_tables(db):
    rows = db.execute("SELECT id, text FROM chunks WHERE lower(trim(chunk_type)) = 'table' AND length(text) > 1500").fetchall()
    return [{"id": i, "part": n, "text": t} for i, text in rows for n, t in enumerate(parts_of(text))]


def embedded_search(db):
    model = search.HashingEmbedder()
    asked = db.execute("SELECT min(golden_id), question FROM golden GROUP BY question").fetchall()
    texts = db.execute("SELECT id, coalesce(text, '') FROM chunks").fetchall()
    q, v = (model([t for _, t in rows])[0].astype(float) for rows in (asked, texts))
    q, v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (q, v))
    out = []
    for (query, _), scores in zip(asked, np.round(q @ v.T, 6)):
        best = sorted((-s, i) for (i, _), s, w in zip(texts, scores.tolist(), v) if w.any())[:5]
        out += [{"query_id": query, "id": i, "score": -s, "rank": n} for n, (s, i) in enumerate(best, 1)]
    return out


MODELS = {f.__name__: f for f in (packed_chunks, packed_chunks_by_target, split_tables, embedded_search)}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_query_by_model(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    assert mine == sorted((tuple(plain(r[c]) for c in columns) for r in MODELS[name](db)), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(MODELS)))
def test_query(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in oracles.ORACLES:  # their functions are tested by value elsewhere
        assert mine and all(v is not None for r in mine for v in r)
        return
    found = db.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert mine == sorted((tuple(plain(v) for v in r) for r in found), key=repr)
