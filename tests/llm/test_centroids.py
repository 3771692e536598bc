"""Lloyd rounds against plain Python integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import centroids


def plain(rows, k, rounds, scale, dimensions):
    kept = []
    for vec_id, x in rows:
        if vec_id is not None and x is not None and len(x) == dimensions and all(v is not None and np.isfinite(v) for v in x):
            kept.append((vec_id, [int(np.floor(scale * float(v))) for v in x]))
    by_hash = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)
    at = [v for _, v in by_hash[:k]]
    where = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        met = {}
        for _, v in kept:
            met.setdefault(where(v)[1], []).append(v)
        at = [[sum(col) // len(met[c]) for col in zip(*met[c], strict=True)] if c in met else old for c, old in enumerate(at)]
    found = [(i, where(v)[1], where(v)[0]) for i, v in kept]
    own = {c: sum(d for _, x, d in found if x == c) for c in range(len(at))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((i, c, d, own[c], sum(own.values()), digest[c]) for i, c, d in found)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 2, 3)]) for i in range(90)]
    rows += [(3, rows[3][1]), (3, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (200, None), (201, [1.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [1.0, float("-inf"), 2.0]), (205, [])]
    got = centroids.described(*centroids.lloyd(table(spark, rows).repartition(5), 7, 3, 64.0, "1", 3))
    assert sorted(map(tuple, got.collect())) == plain(rows, 7, 3, 64.0, 3)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(9, [1.0, 1.0])]
    assigned, at = centroids.lloyd(table(spark, rows), 4, 2, 1.0, "1", 2)
    got = centroids.described(assigned, at)
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, 2, 1.0, 2)
    assert len(at) == 4 and {r["cluster"] for r in got.where("vec_id < 9").collect()} == {min(c for c, x in enumerate(at.tolist()) if x == [0, 0])}


def test_floor_of_negative_means(spark):
    rows = [(1, [-1.0]), (2, [-2.0]), (3, [-2.0])]
    _, at = centroids.lloyd(table(spark, rows), 1, 1, 1.0, "1", 1)
    assert at.tolist() == [[-2]]  # -5 / 3, down


def test_fewer_vectors_than_centroids_empty_table_and_clashing_names(spark):
    few = table(spark, [(1, [0.5, 0.5]), (2, [0.25, -0.5])]).withColumns({"cluster": F.lit("x"), "distance": F.lit(1.5), "n": F.lit(0), "sums": F.lit("y"), "inertia": F.lit(None)})
    got = centroids.described(*centroids.lloyd(few, 16, 3, 64.0, "1", 2))
    assert got.columns == [x.split()[0] for x in centroids.RESULT.split(", ")] and got.count() == 2
    none = centroids.described(*centroids.lloyd(few.limit(0)))
    assert none.columns == got.columns and none.count() == 0


def test_narrow_and_wide_integers_agree():
    rng = np.random.default_rng(5)
    v, c = rng.integers(-60, 60, (300, 8)), rng.integers(-60, 60, (5, 8))
    n1, d1 = centroids.nearest(v, c)
    n2, d2 = centroids.nearest(v * 100_000, c * 100_000)
    assert (n1 == n2).all() and (d1 * 10**10 == d2).all()


def test_components_beyond_the_bound_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.lloyd(table(spark, [(1, [1e9])]), 1, 1, 64.0, "1", 1)
