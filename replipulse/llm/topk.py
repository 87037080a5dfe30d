"""Exact top-k search by no-random-access aggregation (NRA).

Each component is a list of the candidates sorted by it, read from the top for queries
with a positive weight there and from the bottom for a negative one. The lists of a block
of candidates are read to the same depth, step by step. What has been read of a candidate
and the value at which each list stands bound its score from above; the list's far end
bounds it from below. The k-th best lower bound is what others must reach: candidates
whose upper bound stays below it cannot qualify. When few pairs are left open (or the lists
end), their scores are resolved and the k best given out.

Queries and candidates meet in blocks, one task per pair of blocks. First, every query reads
the lists of the block that its own row is in. The k-th best score there is a lower bound for
the whole search, so with it the other blocks are read from the start: an outsider must reach
it, and lists need no lower bounds of their own. The k best of all blocks are ranked per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replipulse.llm.common import pick, written

K = 20
EVERY = 20
SCALE = 64
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Queries that are bounded at once within a block, and depths the lists are read to.
GROUP = 256
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0)
#: Read on while more than this share of the pairs may still qualify.
FEW = 0.05
#: Pairs whose scores are resolved at once.
PAIRS = 1 << 17


def _number_kind(queries: np.ndarray, rows: np.ndarray) -> type:
    """A float type in which every bound is an exact integer, or Python's integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else object


class Lists:
    """The sorted lists of a block of candidates, which stand by id; ``keys`` name their rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, keys: np.ndarray | None = None) -> None:
        keys = ids if keys is None else keys
        order = np.lexsort((keys, ids))
        self.ids, self.rows, self.keys = ids[order], rows[order], keys[order]
        self.sorted = np.sort(self.rows, axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists stand, read from the top and from the bottom."""
        return self.sorted[len(self.ids) - depth], self.sorted[depth - 1]

    def upper(self, weights: np.ndarray, depth: int, kind: type, some: np.ndarray) -> np.ndarray:
        """Upper bounds of some candidates' scores: what is not read is at most where a list stands."""
        top, bottom = self.read(depth)
        rows = self.rows[some]
        up = np.concatenate([np.maximum(rows, top), np.minimum(rows, bottom)], axis=1).astype(kind)
        return weights.astype(kind) @ up.T

    def lower(self, weights: np.ndarray, depth: int, kind: type) -> np.ndarray:
        """Lower bounds of all scores: what is not read is at least a list's far end."""
        top, bottom = self.read(depth)
        rows = self.rows
        low = [np.where(rows >= top, rows, self.sorted[0]), np.where(rows <= bottom, rows, self.sorted[-1])]
        return weights.astype(kind) @ np.concatenate(low, axis=1).astype(kind).T


def _kth_best(known: np.ndarray, others: np.ndarray, k: int, kind: type) -> np.ndarray:
    """The k-th largest of each row's bounds, itself left out."""
    if kind is object:
        return np.array([sorted((v for v, o in zip(*row) if o), reverse=True)[k - 1] for row in zip(known, others)], object)[:, None]
    total = known.shape[1]
    return np.partition(np.where(others, known, -np.inf), total - k, axis=1)[:, total - k, None]


def best_of_block(
    query_keys: np.ndarray, queries: np.ndarray, lists: Lists, k: int = K, reach: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of queries: query keys, candidate ids, scores of the k best candidates, and the
    depth (a share of the lists) that was read.

    ``reach`` are scores that some k other candidates have, wherever they are; those below
    them are left out.
    """
    kind = _number_kind(queries, lists.rows)
    total = len(lists.ids)
    for start in range(0, len(query_keys), GROUP):
        keys, weights = query_keys[start : start + GROUP], queries[start : start + GROUP]
        signed = np.concatenate([np.maximum(weights, 0), np.minimum(weights, 0)], axis=1)
        others = lists.keys[None, :] != keys[:, None]
        needed = None if reach is None else reach[start : start + GROUP, None]
        left = others.copy()
        depth = 0
        while needed is not None or total > k:
            depth = max(1, math.ceil(total * next(d for d in DEPTHS if d * total > depth)))
            # Candidates that no query of the group can want any more are not bounded again.
            some = np.flatnonzero(left.any(axis=0))
            if not len(some):
                break
            least = needed
            if needed is None:
                least = _kth_best(lists.lower(signed, depth, kind), others, k, kind)
            left[:, some] &= lists.upper(signed, depth, kind, some) >= least
            if depth == total or left.sum() <= max(k * len(keys), FEW * left.size):
                break
        q, c = np.nonzero(left)
        scores = np.empty(len(q), object if kind is object else np.int64)
        for i in range(0, len(q), PAIRS):
            part = slice(i, i + PAIRS)
            scores[part] = np.einsum("ij,ij->i", weights[q[part]], lists.rows[c[part]])
        if needed is not None and len(q):
            enough = scores >= needed[q, 0]
            q, c, scores = q[enough], c[enough], scores[enough]
        # Candidates stand by id, so a stable sort by score leaves ties to the smaller id.
        order = np.lexsort((c, -scores, q)) if kind is not object else np.array(
            sorted(range(len(q)), key=lambda i: (q[i], -scores[i], c[i])), np.int64
        )
        q, c, scores = q[order], c[order], scores[order]
        first = np.searchsorted(q, q, "left")
        top = np.arange(len(q)) - first < k
        yield keys[q[top]], lists.ids[c[top]], scores[top].astype(np.int64), np.full(int(top.sum()), depth / max(total, 1))


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for a vector that takes no part."""
    whole = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(usable, F.transform(whole, lambda x: F.floor(x * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one width; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(column), width), np.int64)
    found[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return found


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    every: int = EVERY,
    scale: int = SCALE,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """For every row whose id is divisible by ``every``, its k best other rows:
    ``query_id``, ``rank`` (from 1), the candidate's id, ``score``; ties go to the smaller id.
    ``depth`` is the share of its block's lists that was read before the row was resolved.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without an id. Rows that repeat an id are rows of their own: as candidates each may be
    named, as queries each gets its rows. Vectors of different lengths are compared as if the
    shorter one ended in zeros. An empty table, or one without a query, gives no row. Other
    columns are not read. A score must fit a long.
    """
    rows = pick(vectors, id=id_col, vector=vector_col)
    whole = rows.select(F.col("id").cast("long").alias("id"), quantized(F.col("vector"), scale).alias("vector"))
    usable = whole.filter("id is not null and vector is not null").withColumn("row", F.monotonically_increasing_id())
    usable = written(usable, "topk-vectors")
    asks = F.col("id") % every == 0
    size = usable.agg(
        F.count("*").alias("rows"), F.count_if(asks).alias("queries"), F.max(F.size("vector")).alias("width")
    ).first()
    width = size["width"] or 0
    blocks = max(1, math.ceil(size["rows"] / candidate_block))
    query_blocks = max(1, math.ceil(size["queries"] / query_block))
    home = F.pmod(F.xxhash64("row"), F.lit(blocks))
    nothing = F.lit(None).cast("long").alias("reach")

    def best(cell: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(cell).combine_chunks()
        asked = table.column("query").to_numpy()
        ids, keys = table.column("id").to_numpy(), table.column("row").to_numpy()
        matrix = _matrix(table.column("vector").chunk(0), width)
        if asked.all() or not asked.any():
            return
        lists = Lists(ids[~asked], matrix[~asked], keys[~asked])
        reach = table.column("reach").filter(pa.array(asked))
        given = None if reach.null_count else reach.to_numpy()
        for key, found, score, depth in best_of_block(keys[asked], matrix[asked], lists, k, given):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(found), pa.array(score), pa.array(depth)], ["query", "id", "score", "depth"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[-1].column(0)[0].as_py() != cells[a]:
                    yield from best(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from best(held)

    def searched(cells: DataFrame) -> DataFrame:
        dealt = cells.repartition("cell").sortWithinPartitions("cell").select("cell", "query", "row", "id", "vector", "reach")
        return dealt.mapInArrow(run, "query long, id long, score long, depth double")

    named = ["row", "id", "vector"]
    at_home = usable.select(home.alias("cell"), F.lit(False).alias("query"), *named, nothing).unionByName(
        usable.filter(asks).select(home.alias("cell"), F.lit(True).alias("query"), *named, nothing)
    )
    first = written(searched(at_home), "topk-home")
    # k rows a query at most. Fewer than k say nothing of what others must reach.
    lowest = first.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("found"))
    lowest = lowest.select(F.col("query").alias("row"), F.when(F.col("found") >= k, F.col("least")).alias("reach"))
    # Without k others at home nothing is known; the least number keeps all.
    known = F.coalesce("reach", F.lit(-(2**62))).alias("reach")
    queries = usable.filter(asks).join(lowest, "row", "left").select(*named, known, home.alias("home"))
    away = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("block != home")
    mine = F.pmod(F.xxhash64("row"), F.lit(query_blocks))
    asked = away.select((mine * blocks + F.col("block")).alias("cell"), F.lit(True).alias("query"), *named, "reach")
    others = usable.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select(
        (F.col("other") * blocks + home).alias("cell"), F.lit(False).alias("query"), *named, nothing
    )
    found = first.unionByName(searched(others.unionByName(asked))) if blocks > 1 else first
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    name = usable.filter(asks).select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(name, "query").select("query_id", "rank", F.col("id").alias(id_col), "score", "depth")
