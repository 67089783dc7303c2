"""Cutting oversized texts into overlapping pieces at natural boundaries.

Possible ends of a piece carry a penalty: after a line (or table row) none, after a sentence little,
after a blank more, anywhere else most; each of the last two is offered only where nothing better
comes within a quarter of the limit. The next piece begins `overlap` characters before that end: at the line or
sentence start nearest below or above that place if it is at most `tolerance` characters away, else exactly there, which costs
a penalty too. A dynamic program over the ends and these beginnings then minimises the sum of penalties and of squared
deviations from equal sizes, subject to the limit.

So any two neighbours share `overlap` characters, or between overlap - tolerance and overlap + tolerance where a
line or sentence begins there. An overlap above half the limit counts as half, a tolerance above a quarter of the overlap as a quarter.

Nulls and texts within their limit are not cut and give no piece. Pieces are exact substrings;
the first begins at 0, the last ends at the text's end. Repeated rows are cut alike.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters a piece may have, characters two neighbours share, and how far from that a natural beginning may be.
LIMITS = {"table": 1500, "paragraph": 900}
OVERLAPS = {"table": 150, "paragraph": 90}
TOLERANCES = {"table": 37, "paragraph": 22}
LINE, SENTENCE, BLANK, ANYWHERE = 0.0, 0.05, 0.5, 2.0
#: Penalty of a beginning inside a line or sentence.
INSIDE = 0.25
SENTENCE_END = re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+|(?<=[。！？])")
GAP = re.compile(r"\s+")


def boundaries(text: str, rows_only: bool, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, penalty) of the possible cuts, in order, the text's end included."""
    at: dict[int, float] = {}
    if not rows_only:
        at |= {m.end(): SENTENCE for m in SENTENCE_END.finditer(text)}
    p = text.find("\n")
    while p >= 0:
        at[p + 1] = LINE
        p = text.find("\n", p + 1)
    at.pop(0, None)
    at[len(text)] = LINE
    for a, b in _gaps(at, step):
        at |= {m.end(): BLANK for m in GAP.finditer(text, a, b) if a < m.end() < b}
    for a, b in _gaps(at, step):
        at |= {p: ANYWHERE for p in range(a + step, b, step)}
    places = np.array(sorted(at))
    return places, np.array([at[p] for p in places])


def _gaps(at: dict[int, float], step: int) -> list[tuple[int, int]]:
    """Stretches of more than step characters without a cut."""
    places = [0, *sorted(at)]
    return [(a, b) for a, b in zip(places, places[1:]) if b - a > step]


def beginnings(places: np.ndarray, penalties: np.ndarray, overlap: int, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each end two places [ends, 2] where the piece after it may begin, and what they cost (inf: none there)."""
    natural = np.r_[0, places[penalties <= SENTENCE]]
    wanted = places - overlap
    above = np.searchsorted(natural, wanted, "left")
    at = np.stack([natural[np.maximum(np.searchsorted(natural, wanted, "right") - 1, 0)], natural[np.minimum(above, len(natural) - 1)]], 1)
    away = np.abs(at - wanted[:, None])
    cost = np.where(away <= tolerance, 0.0, np.inf)
    none = ~np.isfinite(cost).any(1)
    at[none, 0], cost[none, 0] = wanted[none], INSIDE
    return at, cost


def cuts(text: str, kind: str, limit: int, overlap: int, tolerance: int | None = None) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a text longer than its limit."""
    n = len(text)
    overlap = min(overlap, limit // 2)
    tolerance = min(TOLERANCES[kind] if tolerance is None else tolerance, overlap // 4)
    places, penalties = boundaries(text, kind == "table", max(1, limit // 4))
    begins, extra = beginnings(places, penalties, overlap, tolerance)
    least = overlap + tolerance + 1  # what a piece needs so that the next one begins after it
    count = max(2, -(-(n - overlap) // max(1, limit - overlap)))
    ideal = (n + (count - 1) * overlap) / count
    best, back = np.full(len(places), np.inf), np.full((len(places), 2), -1)
    for i, e in enumerate(places):
        if least <= e <= limit:
            best[i] = ((e - ideal) / limit) ** 2
        j = np.searchsorted(places[:i], e - limit + overlap - tolerance, "left")
        if j < i:
            size = e - begins[j:i]
            fits = (size <= limit) & ((size >= least) | (e == n))
            cost = np.where(fits, best[j:i, None] + extra[j:i] + ((size - ideal) / limit) ** 2, np.inf)
            k = int(np.argmin(cost))
            if cost.flat[k] < best[i]:
                best[i], back[i] = cost.flat[k], (j + k // 2, k % 2)
        best[i] += penalties[i]
    out, i = [], len(places) - 1
    while i >= 0:
        j, o = back[i]
        out.append((int(begins[j, o]) if j >= 0 else 0, int(places[i])))
        i = j
    return out[::-1]


def kind_of(chunk_type: Column, text: Column) -> Column:
    """'table' or 'paragraph'; a type that is neither is told from the lines, as a null one is."""
    named = F.lower(F.regexp_replace(chunk_type, r"(?U)^\s+|\s+$", ""))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"(?U)\S"))
    told = F.when(2 * F.size(F.filter(full, lambda x: x.contains(" | "))) >= F.size(full), "table").otherwise("paragraph")
    return F.when(named.isin("table", "paragraph"), named).otherwise(told)


def _pieces(limits: dict[str, int], overlaps: dict[str, int], tolerances: dict[str, int]):
    def run(frames):
        for f in frames:
            rows = []
            for i, kind, path, text in zip(f["id"], f["chunk_type"], f["section_path"], f["text"]):
                found = cuts(text, kind, limits[kind], overlaps[kind], tolerances[kind])
                for n, (a, b) in enumerate(found, 1):
                    rows.append((i, n, len(found), kind, path, a, b, found[n - 2][1] - a if n > 1 else 0, text[a:b]))
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "chunk_type", "section_path", "begin", "end", "overlap", "text"])

    return run


def oversized(chunks: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(id, chunk_type, section_path, text) of the chunks above their limit, by built-in expressions."""
    limits = limits or LIMITS
    long = chunks.filter(F.length("text") > min(limits.values()))  # reaches the scan before anything else is looked at
    typed = long.select(F.col("id").cast("bigint").alias("id"), kind_of(F.col("chunk_type"), F.col("text")).alias("chunk_type"), "section_path", "text")
    return typed.filter(F.length("text") > F.when(F.col("chunk_type") == "table", limits["table"]).otherwise(limits["paragraph"]))


def pieces(chunks: DataFrame, limits: dict[str, int] | None = None, overlaps: dict[str, int] | None = None, tolerances: dict[str, int] | None = None) -> DataFrame:
    """chunks (id, section_path, chunk_type, text) -> the pieces of every chunk above its limit.

    piece_no counts from 1; begin and end are places in code points; overlap is the number of
    characters shared with the piece before (0 for the first)."""
    limits, overlaps, tolerances = limits or LIMITS, overlaps or OVERLAPS, tolerances or TOLERANCES
    schema = "id bigint, piece_no int, n_pieces int, chunk_type string, section_path array<string>, begin int, end int, overlap int, text string"
    return oversized(chunks, limits).mapInPandas(_pieces(limits, overlaps, tolerances), schema)


def rebuilt(found: DataFrame) -> DataFrame:
    """(id, text, most, least_shared, most_shared) of pieces: the text they give together, the longest piece, and the
    fewest and most characters that two neighbours share. The pieces of one text are gathered, never those of several."""
    own = F.struct("piece_no", F.substr("text", F.col("overlap") + 1).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["t"]), "")
    shared = F.when(F.col("piece_no") > 1, F.col("overlap"))
    return found.groupBy("id").agg(text.alias("text"), F.max(F.length("text")).alias("most"), F.min(shared).alias("least_shared"), F.max(shared).alias("most_shared"))
