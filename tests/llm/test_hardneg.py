"""Hard negatives against all scores."""

import math

import numpy as np
import pytest
from cases import rows
from pyspark.sql import functions as F

from replipulse.llm import hardneg, queries

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(table, every=100):
    usable = []
    for i, v, label in table:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * x) for x in v], label))
    found = []
    for n, (anchor, q, label) in enumerate(usable):
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), i, other) for m, (i, v, other) in enumerate(usable) if m != n]
        positives = sorted(s for s in scored if s[2] == label)[:5]
        for score, positive, _ in positives:
            window = sorted(s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score)
            found += [(anchor, positive, r + 1, i, -score, -s) for r, (s, i, _) in enumerate(window[:5])]
    return sorted(found, key=repr)


def got(df, **more):
    return rows(hardneg.mine(df, **more).select(*COLUMNS))


@pytest.mark.parametrize("blocks", [{}, {"tree": 30, "anchor_block": 3}])
def test_clusters_ties_and_copies(spark, blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (9, 12)).round(1)
    table = []
    for i in range(400):
        v = centres[i % 9] + (rng.normal(0, 0.2, 12).round(1) if i % 4 else 0)
        table.append((i * 10, v.tolist(), int(rng.integers(3))))
    table += [(7, centres[0].tolist(), 1)] * 60  # one vector many times
    assert got(spark.createDataFrame(table, SCHEMA), **blocks) == plain(table)


def test_random_vectors_of_one_norm(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (500, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = [(i, v[i].tolist(), i % 4) for i in range(500)]
    assert got(spark.createDataFrame(table, SCHEMA), tree=100) == plain(table)


def test_awkward_rows(spark):
    table = [
        (0, [1.0, -2.0], 0), (100, None, 0), (200, [float("nan"), 1.0], 0), (300, [1.0, None], 0), (400, [], 0),
        (500, [0.5], 0), (3, [float("inf"), 0.0], 0), (4, [1.0, 1.0, 3.0], 0), (4, [1.0, 1.0, 3.0], 1),
        (0, [1.0, -2.0], 1), (None, [1.0, 1.0], 0), (-100, [0.01, -0.01], 0), (-1, [1.0, -2.0], None),
        (600, [0.0, 0.0], 2), (601, [0.0, 0.0], 2), (602, [0.0, 0.0], 1), (700, [-1.0, 2.0], 0), (800, [9e3, 1.0], 3),
    ]
    df = spark.createDataFrame(table, SCHEMA)
    expected = plain(table)
    assert expected and got(df) == expected
    clash = df.select("*", *[F.lit(1).alias(n) for n in ("id", "row", "vector", "cell", "windows", "LABEL")])
    assert got(clash) == expected
    assert got(df.limit(0)) == []
    assert got(df.filter("vec_id = 4")) == []
    assert got(df.filter("vec_id = 500")) == []


def test_trees_cover_and_separate():
    rng = np.random.default_rng(7)
    vectors = np.rint(rng.normal(0, 50, (30, 8))[rng.integers(30, size=600)] + rng.normal(0, 4, (600, 8))).astype(np.int64)
    order, nodes = hardneg.cover_tree(vectors)
    assert sorted(order) == list(range(600)) and nodes[0][:2] == (0, 600)
    norms = (vectors**2).sum(axis=1)
    whole = np.concatenate([vectors, np.sqrt(norms.max() - norms)[:, None]], axis=1) / math.sqrt(norms.max())
    whole = whole[order]
    for first, end, radius, parent in nodes:
        chords = np.linalg.norm(whole[first:end] - whole[first], axis=1)
        assert np.isclose(2 * np.arcsin(chords.max() / 2), radius)
        if parent >= 0:
            assert nodes[parent][0] <= first and end <= nodes[parent][1] and radius <= nodes[parent][2] / 2
    by_parent = {}
    for number, (first, end, _, parent) in enumerate(nodes):
        by_parent.setdefault(parent, []).append((first, end))
    for parent, parts in by_parent.items():
        if parent >= 0:  # the children share their parent's rows among them
            assert sorted(parts)[0][0] == nodes[parent][0] and sum(b - a for a, b in parts) == nodes[parent][1] - nodes[parent][0]


def test_bounds_skip_most_of_clustered_candidates(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (60, 16))
    table = [(i, (centres[i % 60] + rng.normal(0, 0.02, 16)).tolist(), i // 60 % 2) for i in range(3000)]
    found = hardneg.mine(spark.createDataFrame(table, SCHEMA))
    assert rows(found.select(*COLUMNS)) == plain(table)
    assert found.agg(F.max("opened")).first()[0] < 1000


def test_query_on_the_test_tables(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    table = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 and label is not None else label) for i, v, label in table]
    assert rows(queries.op13_hard_negatives(spark, sf_dir).select(*COLUMNS)) == plain(table)
