"""Exact top-k search against all scores."""

import math

import numpy as np
import pytest
from cases import rows
from pyspark.sql import functions as F

from replipulse.llm import queries, topk


def plain(vectors, k=20, every=20):
    usable = [
        (i, [math.floor(64 * float(x)) for x in v])
        for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for n, (i, q) in enumerate(usable):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(usable) if m != n)
            found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(found, key=repr)


def got(df, **more):
    return rows(topk.search(df, **more).drop("depth"))


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, label int")


@pytest.mark.parametrize("blocks", [(topk.QUERY_BLOCK, topk.CANDIDATE_BLOCK), (3, 40)])
def test_random_vectors_with_ties(spark, blocks):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.15, (60, 16)).round(2)
    vectors = [(i, base[i % 60].tolist() if i % 3 else base[5].tolist(), 0) for i in range(300)]
    found = got(frame(spark, vectors), query_block=blocks[0], candidate_block=blocks[1])
    assert found == plain([v[:2] for v in vectors])


def test_awkward_rows(spark):
    vectors = [
        (0, [1.0, -2.0], 0), (20, None, 0), (40, [float("nan"), 1.0], 0), (60, [1.0, None], 0), (80, [], 0),
        (100, [0.5], 0), (3, [float("inf"), 0.0], 0), (4, [1.0, 1.0, 3.0], 0), (4, [1.0, 1.0, 3.0], 0),
        (5, [2.0, 0.1], 0), (5, [-2.0, 0.1], 0), (20, [0.3, 0.3], 0), (20, [-0.3, 0.9], 1), (0, [1.0, -2.0], 0), (None, [1.0, 1.0], 0), (-20, [0.01, -0.01], 0), (-1, [1.0, -2.0], None),
    ]
    df = frame(spark, vectors)
    expected = plain([v[:2] for v in vectors])
    assert got(df) == expected
    assert got(df, candidate_block=4, query_block=2) == expected
    clash = df.select("*", *[F.lit(1).alias(n) for n in ("id", "vector", "cell", "score", "rank", "EMBEDDING")])
    assert got(clash) == expected
    assert rows(topk.search(df.limit(0))) == []
    assert rows(topk.search(df.filter("vec_id = 4"))) == []
    assert rows(topk.search(df.filter("vec_id = 100"))) == []


@pytest.mark.parametrize("size", [1.0, 1e4, 1e7])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(6)
    vectors = [(i, (rng.normal(0, size, 8)).tolist(), 0) for i in range(60)]
    assert got(frame(spark, vectors), k=5, candidate_block=25) == plain([v[:2] for v in vectors], k=5)


def test_reading_stops_early_when_outsiders_cannot_qualify():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 20, (40, 32))
    data = np.rint(centres[np.arange(4000) % 40] + rng.normal(0, 2, (4000, 32))).astype(np.int64)
    lists = topk.Lists(np.arange(4000), data)
    parts = list(topk.best_of_block(np.arange(0, 40), data[:40], lists))
    assert max(d for p in parts for d in p[3]) < 1
    found = [(q, c, s) for a in parts for q, c, s, _ in zip(*a)]
    for q in range(40):
        scores = data @ data[q]
        order = [c for c in np.lexsort((np.arange(4000), -scores)) if c != q][:20]
        assert [c for a, c, _ in found if a == q] == order


def test_what_others_must_reach_shortens_the_reading():
    """Random directions, the hardest case: with a bound from elsewhere the lists are not read to their end."""
    rng = np.random.default_rng(8)
    data = rng.normal(0, 1, (6000, 64))
    data = np.floor(64 * data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.int64)
    lists = topk.Lists(np.arange(3000), data[:3000])
    scores = data[3000:3100] @ data[:3000].T
    reach = np.sort(data[3000:3100] @ data[3100:].T, axis=1)[:, -20]
    parts = list(topk.best_of_block(np.arange(3000, 3100), data[3000:3100], lists, 20, reach))
    assert max(d for p in parts for d in p[3]) < 1
    found = {(int(q), int(c)): int(s) for p in parts for q, c, s, _ in zip(*p)}
    for q in range(100):
        order = [c for c in np.lexsort((np.arange(3000), -scores[q]))[:20] if scores[q, c] >= reach[q]]
        assert [c for a, c in found if a == 3000 + q] == order
        assert all(found[3000 + q, c] == scores[q, c] for c in order)


def test_query_on_the_test_tables(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert rows(queries.op3_nra_topk(spark, sf_dir)) == plain(vectors)
