"""Centroid clustering with Drake's adaptive bounds, exact.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds of the
distances to its several next nearest centroids, and one bound for all the rest.  When centroids
move, bounds move with them.  A vector is looked at anew only where its bounds can't certify the
order: first against its own centroid, then against the listed ones, and against all where the
remainder bound fails too.  The number of listed centroids shrinks to what a round has needed.

Distances are whole numbers; bounds are doubles with a margin over their rounding, and only
strict order certifies, so ties go to the smaller number exactly.  Rounds are tables in the shared
folder.  Only centroids, their moves and sums (``k`` rows) pass the driver.

Defined results: vectors that are null, of another length, or with a null or non-finite component
take no part.  Components are whole numbers within LIMIT, beyond which a distance would not fit a
long; larger ones raise an error.  Of fewer than ``k`` vectors each is a starting centroid.
Repeated rows count as often as they occur; repeated ids are told apart by their components.  A
null id hashes as an empty one.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Largest component: squared distances of vectors of up to 64 components fit a long.
LIMIT = 1 << 27
#: Relative margin over the rounding of bounds.
MARGIN = 1e-9


def whole_vectors(table: DataFrame, size: int = 64, scale: float = 256.0) -> DataFrame:
    """vec_id and ``q``: components floor(scale * x) of the vectors that are whole."""
    x = F.col("embedding")
    good = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(x, lambda v: F.abs(v.cast("double") * scale) < LIMIT)
    q = F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT} / {scale}")).cast("array<bigint>"))
    return table.where(F.coalesce(good, F.lit(False))).select("vec_id", q.alias("q"))


def starting_centroids(vectors: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r.q for r in rows], dtype=np.int64)


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``q`` to rows of ``c`` (the same number, or one)."""
    d = q - c
    return np.einsum("ij,ij->i", d, d)


def _table(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        out[:, j] = squared(q, c)
    return out


def _above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + MARGIN)


def _below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - MARGIN)


def scanned(q: np.ndarray, centroids: np.ndarray, listed: int) -> tuple[np.ndarray, ...]:
    """Own centroid, upper bound, listed centroids with lower bounds, remainder bound: from all distances."""
    d = _table(q, centroids)
    order = np.argsort(d, axis=1, kind="stable")  # ties: smaller number first
    own = order[:, 0]
    upper = _above(np.take_along_axis(d, order[:, :1], 1)[:, 0])
    near = order[:, 1 : 1 + listed]
    low = _below(np.take_along_axis(d, near, 1))
    after = order[:, 1 + listed : 2 + listed]
    rest = _below(np.take_along_axis(d, after, 1)[:, 0]) if after.shape[1] else np.full(len(q), np.inf)
    return own, upper, near, low, rest


def moved_bounds(own, upper, near, low, rest, moves: np.ndarray, listed: int):
    """Bounds after the centroids moved; bounds beyond ``listed`` join the remainder."""
    if near.shape[1] > listed:
        rest = np.minimum(rest, low[:, listed:].min(axis=1))
        near, low = near[:, :listed], low[:, :listed]
    up = moves * (1 + MARGIN)
    return (upper + up[own]) * (1 + MARGIN), near, low - up[near] - MARGIN, rest - up.max() - MARGIN


def reassigned(q, centroids, own, upper, near, low, rest) -> tuple[np.ndarray, ...]:
    """Exact assignment again, with the bounds, how many listed ones each row asked, and whether all were."""
    n, listed = near.shape
    own, upper, near, low, rest = own.copy(), upper.copy(), near.copy(), low.copy(), rest.copy()
    asked, full = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    lowest = np.minimum(low.min(axis=1) if listed else np.inf, rest)
    doubtful = np.flatnonzero(upper >= lowest)
    if not len(doubtful):
        return own, upper, near, low, rest, asked, full
    exact = squared(q[doubtful], centroids[own[doubtful]])
    upper[doubtful] = _above(exact)
    open_ = upper[doubtful] >= lowest[doubtful]
    at, best, who = doubtful[open_], exact[open_], own[doubtful][open_]
    own_square = best.copy()
    squares = np.full((len(at), listed), -1, dtype=np.int64)
    for j in range(listed):  # the listed ones that may be as near, in turn
        ask = np.flatnonzero(low[at, j] <= upper[at])
        d = squared(q[at[ask]], centroids[near[at[ask], j]])
        squares[ask, j] = d
        c = near[at[ask], j]
        nearer = (d < best[ask]) | ((d == best[ask]) & (c < who[ask]))
        best[ask[nearer]], who[ask[nearer]] = d[nearer], c[nearer]
    known = squares >= 0
    asked[at] = np.where(known.any(axis=1), listed - np.argmax(known[:, ::-1], axis=1), 0) if listed else 0
    low[at] = np.where(known, _below(np.maximum(squares, 0)), low[at])
    change = np.flatnonzero(who != own[at])
    if len(change):  # the old centroid takes the place of the new one in the list
        slot = np.argmax(near[at[change]] == who[change, None], axis=1)
        near[at[change], slot] = own[at[change]]
        low[at[change], slot] = _below(own_square[change])
        own[at[change]] = who[change]
    upper[at] = _above(best)
    again = at[upper[at] >= rest[at]]  # the remainder bound certifies nothing: look at all
    if len(again):
        full[again] = True
        own[again], upper[again], near[again], low[again], rest[again] = scanned(q[again], centroids, listed)
    return own, upper, near, low, rest, asked, full


BOUNDS = "own int, upper double, near array<int>, low array<double>, rest double, asked int, full boolean"


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type, width: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def _round(centroids: np.ndarray, moves: np.ndarray | None, before: int, listed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task of one round: bounds are moved and asked, or made where there are none yet."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("q"), np.int64, centroids.shape[1])
            if moves is None:
                own, upper, near, low, rest = scanned(q, centroids, listed)
                asked, full = np.full(len(q), listed), np.ones(len(q), dtype=bool)
            else:
                own = batch.column("own").to_numpy().astype(np.int64)
                near = _matrix(batch.column("near"), np.int64, before) if before else np.zeros((len(q), 0), dtype=np.int64)
                low = _matrix(batch.column("low"), np.float64, before) if before else np.zeros((len(q), 0))
                upper, rest = batch.column("upper").to_numpy(), batch.column("rest").to_numpy()
                upper, near, low, rest = moved_bounds(own, upper, near, low, rest, moves, listed)
                own, upper, near, low, rest, asked, full = reassigned(q, centroids, own, upper, near, low, rest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("q"),
                    pa.array(own, pa.int32()),
                    pa.array(upper),
                    _lists(near, pa.int32()),
                    _lists(low, pa.float64()),
                    pa.array(rest),
                    pa.array(asked, pa.int32()),
                    pa.array(full),
                    pa.array(squared(q, centroids[own])),
                ],
                names=["vec_id", "q", *[x.split()[0] for x in BOUNDS.split(", ")], "distance"],
            )

    return task


def _updated(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; empty ones stay."""
    parts = [F.sum(F.get("q", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in rows.groupBy("own").agg(F.count("*").alias("n"), *parts).collect():  # at most one row a centroid
        out[r["own"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def clustered(vectors: DataFrame, centroids: np.ndarray, rounds: int = 5, reports: list[dict] | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows with their final centroid (``own``) and squared ``distance``, and the centroids.

    ``reports`` gets, for each round after the first, how many rows asked all centroids and
    how many centroids were listed.
    """
    k = len(centroids)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, q array<bigint>, {BOUNDS}, distance bigint"
    listed, least = min(max(1, k // 4), k - 1), min(max(1, k // 8), k - 1)
    rows = stored(vectors.mapInArrow(_round(centroids, None, 0, listed), schema), "round")
    for _ in range(rounds):
        after = _updated(rows, centroids)
        moves = _above(squared(after, centroids))
        needed = rows.agg(F.max(F.when(~F.col("full"), F.col("asked"))).alias("m")).first()["m"]
        fewer = listed if needed is None else min(listed, max(least, needed))
        rows = stored(rows.mapInArrow(_round(after, moves, listed, fewer), schema), "round")
        centroids, listed = after, fewer
        if reports is not None:
            reports.append({"listed": listed, "full": rows.where("full").count()})
    return rows, centroids


RESULT = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster_report(table: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: float = 256.0) -> DataFrame:
    """For each whole vector its cluster, squared distance, inertia of cluster and of all, and its centroid's hash."""
    spark = table.sparkSession
    vectors = stored(whole_vectors(table, size, scale), "vectors")
    start = starting_centroids(vectors, k)
    if not len(start):
        id_type = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {id_type}, {RESULT}")
    rows, centroids = clustered(vectors, start, rounds)
    sums = {r["own"]: r["s"] for r in rows.groupBy("own").agg(F.sum("distance").alias("s")).collect()}  # at most k
    total = sum(sums.values())
    digest = {j: hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest() for j in sums}
    facts = spark.createDataFrame(
        [(j, s, total, digest[j]) for j, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return rows.select("vec_id", F.col("own").alias("cluster"), "distance").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256) -> str:
    """The same rows in SQL: every round compares all vectors with all centroids, in long form."""
    parts = [
        f"""k AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {size}
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"v AS MATERIALIZED (SELECT vec_id, i, CAST(floor(CAST(embedding[i] AS DOUBLE) * {scale}) AS BIGINT) AS x FROM k, range(1, {size + 1}) r(i))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM k QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN v USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT vec_id, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM v JOIN c{r} m USING (i) GROUP BY ALL)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY ALL)")
            mean = "(s - ((s % n) + n) % n) // n"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce({mean}, x) AS x FROM c{r} LEFT JOIN s{r} USING (c, i))")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return (
        "WITH "
        + ",\n".join(parts)
        + f""" SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"""
    )
