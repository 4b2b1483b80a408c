import hashlib
import math
import random

import pytest

from siftwork.llm import heaps

SCHEMA = "vec_id bigint, embedding array<double>, label int, cluster string, distance int"


def by_hand(rows, clusters, rounds, dims, scale=256):
    """Plain k-means in whole numbers."""
    kept = [
        (key, [math.floor(scale * x) for x in v])
        for key, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]

    def order(row):
        name = "" if row[0] is None else str(row[0])
        return hashlib.sha256(f"2:{name}".encode()).hexdigest()

    centroids = [v for _, v in sorted(kept, key=order)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [
            [sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c
            for n, c in enumerate(centroids)
        ]
    found = [(key, *reversed(nearest(v))) for key, v in kept]
    whole = sum(d for *_, d in found)
    return sorted(
        ((key if key is not None else -1), n, d, sum(e for _, m, e in found if m == n), whole, tuple(centroids[n]))
        for key, n, d in found
    )


def got(df):
    return sorted(
        (r.key if r.key is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid))
        for r in df.collect()
    )


def cloud(n, dims, seed, step=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        center = rng.randrange(6)
        v = [rng.gauss(center * (1 if j % 2 else -1), 0.3) for j in range(dims)]
        out.append((i, [round(x / step) * step for x in v] if step else v))
    return out


@pytest.mark.parametrize(("rows", "clusters", "dims"), [
    (cloud(400, 4, 1), 8, 4),
    (cloud(300, 2, 2, step=1 / 16), 12, 2),  # many ties
    (cloud(3, 4, 3), 8, 4),  # fewer vectors than clusters
    (cloud(50, 4, 4), 1, 4),
])
def test_equals_plain_rounds(spark, rows, clusters, dims):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    assert got(heaps.cluster(table, clusters, 5, dims)) == by_hand(rows, clusters, 5, dims)


def test_odd_rows(spark):
    rows = cloud(60, 3, 5) + [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0])]
    rows += [(104, [1.0, float("inf"), 0.0]), (105, [1.0] * 4), (None, [0.5, 0.5, 0.5])]
    rows += cloud(60, 3, 5)[:20] + [(106, [30000.0, -30000.0, 0.25])]  # repeated rows; beyond what floats hold exactly
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(4)
    assert got(heaps.cluster(table, 6, 5, 3)) == by_hand(rows, 6, 5, 3)


def test_empty_table_and_too_large_components(spark):
    assert heaps.cluster(spark.createDataFrame([], SCHEMA), dims=3).count() == 0
    table = spark.createDataFrame([(1, [1e30], 1, "", 1)], SCHEMA)
    with pytest.raises(Exception, match="no exact squared distances"):
        heaps.cluster(table, 2, 1, 1).collect()


def test_only_expired_vectors_are_compared_again(spark):
    rows = cloud(2000, 4, 7)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    state = heaps.grow(table, 6, 5, 4, 256, "vec_id", "embedding")
    compared = [run.count() for run in state.runs]
    assert compared[0] == 2000 and sum(compared[1:]) < 5 * 2000 / 2
    assert state.held().count() == 2000  # each vector is in one heap
    assert [s[-1] for s in state.sums] == [n for _, n in sorted(state.held().groupBy("cluster").count().collect())]
