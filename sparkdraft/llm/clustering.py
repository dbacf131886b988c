"""Clustering vectors around centroids, in whole numbers, by equal-average equal-variance search.

Vectors become whole numbers once a task reads them.  The squared distance of two
vectors of ``d`` components is at least ``(difference of sums)² / d`` plus
``(difference of deviations)²``, where a vector's deviation is its distance from the
vector whose components all equal its mean.  With the centroids sorted by their sum, the
search for a vector starts at its own sum and goes outward on both sides: the first
inequality ends it, the second passes a centroid over, and what is left is measured
exactly.  Sums are compared as whole numbers and deviations with a margin for
rounding, so that nothing nearest, and no tie, is passed over.

A round is one pass over the stored vectors.  Tasks send at most one row of sums per
centroid (and per 40 bits, where numbers are huge), so nothing grows with a cluster;
the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.llm.common import query, stored
from sparkdraft.session import importable

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
LABEL = "3:"

#: Below this magnitude all steps of the search fit into 64 bits; beyond it numbers are Python's own.
_SMALL = 2**24
#: Bits of a sum that travel in one row.
_LIMB = 40
#: Vectors searched at a time.
_STRIP = 8192


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of every component, exactly."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not scaled.size or np.abs(scaled).max() < _SMALL:
        return scaled.astype(np.int64)
    # Beyond 2**53 a double is whole, and scaling it may leave the doubles.
    exact = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _alike(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as 64-bit numbers if both are small, else as Python's."""
    points = np.array(centroids, dtype=object)
    if vectors.dtype != object and max(map(abs, points.ravel())) < _SMALL:
        return vectors, points.astype(np.int64)
    return vectors.astype(object), points


def _deviations(vectors: np.ndarray) -> np.ndarray:
    dims = vectors.shape[1]
    sums = vectors.sum(axis=1)
    return np.sqrt((dims * (vectors * vectors).sum(axis=1) - sums * sums) / dims)


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid and its squared distance; ties go to the smaller number."""
    vectors, points = _alike(vectors, centroids)
    rows, dims = vectors.shape
    last = len(points) - 1
    sums = points.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    line = sums[order]
    own = vectors.sum(axis=1)
    by_deviation = vectors.dtype != object
    if by_deviation:
        spread, own_spread = _deviations(points)[order], _deviations(vectors)
    best = np.full(rows, -1, dtype=vectors.dtype)
    number = np.zeros(rows, dtype=np.int64)
    right = np.searchsorted(line, own)
    left = right - 1
    active = np.arange(rows)
    while len(active):
        lo, hi = left[active], right[active]
        below = own[active] - line[np.maximum(lo, 0)]
        above = line[np.minimum(hi, last)] - own[active]
        down = (lo >= 0) & ((hi > last) | (below <= above))
        gap = np.where(down, below, above)
        # Sums only get farther away from here on: the inequality of the means ends the search.
        going = ((lo >= 0) | (hi <= last)) & ((best[active] < 0) | (gap * gap <= dims * best[active])).astype(bool)
        active, down, gap = active[going], down[going], gap[going]
        place = np.where(down, left[active], right[active])
        left[active] -= down
        right[active] += ~down
        tried = np.ones(len(active), dtype=bool)
        if by_deviation:
            bound = gap * gap / dims + (own_spread[active] - spread[place]) ** 2
            tried = (best[active] < 0) | (bound <= best[active] * (1 + 1e-6) + 1e-3)
        found, centroid = active[tried], order[place[tried]]
        step = vectors[found] - points[centroid]
        distance = (step * step).sum(axis=1)
        held = best[found]
        nearer = ((held < 0) | (distance < held) | ((distance == held) & (centroid < number[found]))).astype(bool)
        best[found[nearer]] = distance[nearer]
        number[found[nearer]] = centroid[nearer]
    return number, best


def kept_vectors(vectors: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """``id, vector``: the rows with ``dimensions`` components, none null or not finite."""
    kind = vectors.schema[vector].dataType
    column = F.col(f"`{vector}`")
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        column = column.cast("array<double>")
    fine = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vectors.select(F.col(f"`{key}`").alias("id"), column.alias("vector")).filter(
        (F.size("vector") == dimensions) & fine
    )


def _strips(batch: pa.RecordBatch, dimensions: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column("vector")
    for at in range(0, batch.num_rows, _STRIP):
        strip = column.slice(at, _STRIP)
        flat = strip.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield at, whole_numbers(flat.reshape(-1, dimensions), scale)


def _sums(vectors: DataFrame, centroids: list[list[int]], dimensions: int, scale: int) -> dict[int, tuple[int, list]]:
    """Count and componentwise sum of the vectors nearest to each centroid."""
    schema = pa.schema([("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for _, numbers in _strips(batch, dimensions, scale):
                which, _ = nearest(numbers, centroids)
                for cluster in np.unique(which).tolist():
                    mine = numbers[which == cluster]
                    counts[cluster] = counts.get(cluster, 0) + len(mine)
                    old = totals.get(cluster, [0] * dimensions)
                    totals[cluster] = [a + b for a, b in zip(old, mine.sum(axis=0).tolist())]
        out = []
        for cluster, total in totals.items():
            rest, limb = total, 0
            while limb == 0 or any(rest):
                # What does not fit into 64 bits leaves its low bits here; the sign stays with the rest.
                low = [x if abs(x) < 2**62 else x & (1 << _LIMB) - 1 for x in rest]
                rest = [(x - y) >> _LIMB for x, y in zip(rest, low)]
                out.append((cluster, limb, counts[cluster] if limb == 0 else 0, low))
                limb += 1
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    parts = vectors.select("vector").mapInArrow(run, "cluster int, limb int, n bigint, sums array<bigint>")
    rows = (
        parts.select("cluster", "limb", "n", F.posexplode("sums").alias("at", "part"))
        .groupBy("cluster", "limb", "at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
        .collect()
    )
    found: dict[int, tuple[int, list]] = {}
    for r in rows:
        count, total = found.get(r["cluster"], (0, [0] * dimensions))
        total[r["at"]] += int(r["part"]) << (_LIMB * r["limb"])
        found[r["cluster"]] = (max(count, r["n"]), total)
    return found


def first_centroids(vectors: DataFrame, clusters: int, label: str, scale: int) -> list[list[int]]:
    """The vectors whose ids have the smallest SHA-256; equal ids by vector, null ids last."""
    hashed = F.sha2(F.concat(F.lit(label), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    return [whole_numbers(np.array([r["vector"]], dtype=np.float64), scale)[0].tolist() for r in rows]



def cluster_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    label: str = LABEL,
) -> tuple[DataFrame, list[list[int]]]:
    """One row per kept vector, ``id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, and the centroids.

    Vectors that are null, of another length, or hold a null or a number that is not
    finite are left out.  Repeated rows and equal ids are vectors of their own; a
    null id is clustered like any other but starts a centroid last.  With fewer vectors
    than ``clusters`` there are as many centroids as vectors, without any the result is
    empty.  Distances and sums of them that do not fit into 64 bits are null, while
    the search itself stays exact.  Further columns are not looked at.
    """
    importable(vectors.sparkSession)
    kind = vectors.schema[key].dataType
    held = stored(kept_vectors(vectors, key, vector, dimensions), "vectors")
    centroids = first_centroids(held, clusters, label, scale)
    for _ in range(rounds if centroids else 0):
        found = _sums(held, centroids, dimensions, scale)
        moved = [
            [x // found[c][0] for x in found[c][1]] if c in found else centroids[c] for c in range(len(centroids))
        ]
        if moved == centroids:  # every further round would give the same
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, numbers in _strips(batch, dimensions, scale):
                which, far = nearest(numbers, centroids)
                fits = [x if x < 2**63 else None for x in far.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, len(which)),
                        pa.array(which, pa.int32()),
                        pa.array(fits, pa.int64()),
                    ],
                    names=["id", "cluster", "distance"],
                )

    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    )
    assigned = stored(held.mapInArrow(run, schema), "assigned") if centroids else held.sparkSession.createDataFrame([], schema)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    unknown = F.max(F.col("distance").isNull())
    # One row per centroid: a window over them, and a broadcast, of a size that a parameter sets.
    sums = assigned.groupBy("cluster").agg(F.when(~unknown, exact).alias("sum")).collect()
    per_cluster = {r["cluster"]: r["sum"] for r in sums}
    total = None if None in per_cluster.values() else sum(map(int, per_cluster.values()))
    table = [
        (
            c,
            _fits(per_cluster.get(c)),
            _fits(total),
            hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest(),
        )
        for c, centroid in enumerate(centroids)
        if c in per_cluster
    ]
    facts = held.sparkSession.createDataFrame(
        table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ), centroids


def _fits(number) -> int | None:
    return int(number) if number is not None and int(number) < 2**63 else None


def _check_sql() -> str:
    parts = [
        f"""
with kept as materialized (
  select row_number() over () as r, vec_id,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS}
), c0 as materialized (
  select cast(row_number() over (order by sha256('{LABEL}' || vec_id)) - 1 as integer) as cluster, v as c
  from kept order by sha256('{LABEL}' || vec_id) limit {CLUSTERS}
)"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} as materialized (
  select r, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': cast(d as bigint), 'c': cluster}}) as m
  from (
    select r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from kept, c{i}
  ) group by r
)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""s{i} as (
  select m.c as cluster, p, cast(sum(v[p]) as hugeint) as s, count(*) as n
  from a{i}, range(1, {DIMENSIONS + 1}) t(p) group by all
), c{i + 1} as materialized (
  select cluster, coalesce(x.c, c{i}.c) as c from c{i} left join (
    select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by p) as c from s{i} group by 1
  ) x using (cluster)
)"""
            )
    return (
        ",\n".join(parts)
        + f"""
select vec_id, m.c as cluster, m.d as distance,
  cast(sum(m.d) over (partition by m.c) as bigint) as cluster_inertia, cast(sum(m.d) over () as bigint) as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} on m.c = cluster"""
    )


@query("op13_centroid_clustering", table="embeddings", sql=_check_sql())
def op13(embeddings: DataFrame) -> DataFrame:
    """The contract's columns of every kept vector."""
    return cluster_vectors(embeddings)[0].withColumnRenamed("id", "vec_id")
