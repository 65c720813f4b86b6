"""Vectors nearest to asked ones by cosine, as products of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and asked vectors of a block on average, and asked ones that are scored at once.
PIECE, CHUNK, TILE = 8192, 2048, 128
#: Scores stand for themselves in units of the last digit; these are the other places in the order.
NOT_A_NUMBER, UNKNOWN, ITSELF = 1 << 40, -(1 << 40), -(1 << 41)


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, vectors, and which of them are known."""
    rows = rows.sort_by("id")
    vectors = rows.column("e").combine_chunks()
    known = np.array(vectors.is_valid())
    widths = pc.list_value_length(vectors.drop_null()).unique().to_pylist()
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths)}")
    out = np.zeros((len(known), *widths)) if widths else np.zeros((len(known), 0))
    if widths:
        out[known] = np.asarray(vectors.drop_null().flatten(), float).reshape(-1, *widths)
    return np.array(rows.column("id")), out, known


def nearest(vectors: DataFrame, asked: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The ``k`` vectors of greatest cosine, rounded to ``digits``, for each asked id; equal ones by smaller id.

    Both have id and e (doubles).  An id is no neighbour of its own.  The cosine with a vector of length zero
    is no number and comes first, that with an unknown vector is unknown and comes last.  Blocks of vectors meet
    blocks of asked ones in tasks; only a block's best ``k`` leave it.
    """
    pieces, chunks = -(-vectors.count() // PIECE) or 1, -(-asked.count() // CHUNK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = vectors.where("id is not null").select(dealt(pieces).alias("piece"), every(chunks).alias("chunk"), "id", "e")
    right = asked.where("id is not null").select(every(pieces).alias("piece"), dealt(chunks).alias("chunk"), "id", "e")

    def best(mine: pa.Table, others: pa.Table) -> pa.Table:
        ids, v, known = _matrix(mine)
        asks, q, sure = _matrix(others)
        found: list[tuple[np.ndarray, ...]] = []
        squares, last = (v * v).sum(1), np.arange(len(ids))[::-1]
        comparable = known.any() and sure.any() and v.shape[1] > 0
        for start in range(0, len(asks) if len(ids) else 0, TILE):
            part = slice(start, start + TILE)
            some = asks[part]
            order = np.full((len(some), len(ids)), UNKNOWN, np.int64)
            if comparable:
                with np.errstate(all="ignore"):
                    s = q[part] @ v.T / np.sqrt((q[part] * q[part]).sum(1)[:, None] * squares)
                    s = np.clip(s, -1, 1) * 10.0**digits
                    whole = np.trunc(s)
                    whole += np.copysign(np.abs(s - whole) >= 0.5, s)
                scores = np.where(np.isnan(whole), NOT_A_NUMBER, whole).astype(np.int64)
                order = np.where(sure[part][:, None] & known, scores, order)
            order[some[:, None] == ids] = ITSELF
            # Places are told apart by id: ids ascend, so the later column has the lower place.
            place = order * len(ids) + last
            top = np.argpartition(place, -min(k, len(ids)), axis=1)[:, -min(k, len(ids)) :]
            score = np.take_along_axis(order, top, 1)
            row, column = np.nonzero(score != ITSELF)
            found.append((some[row], ids[top[row, column]], score[row, column]))
        q_id, v_id, score = (np.concatenate(x) if found else np.array([], np.int64) for x in (list(zip(*found)) or [()] * 3))
        return pa.table({"q": pa.array(q_id, pa.int64()), "id": pa.array(v_id, pa.int64()), "score": pa.array(score, pa.int64())})

    pairs = left.groupBy("piece", "chunk").cogroup(right.groupBy("piece", "chunk")).applyInArrow(best, "q long, id long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
