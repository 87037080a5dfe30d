"""Hard negatives by cover trees over norm-augmented candidates.

Every vector gets one more component that brings all vectors of a block to one norm, so an
inner product with an anchor falls with the angle between them. A block of candidates is
stored as a cover tree: a node is a centre and a covering radius (an angle), its children are
centres that lie further apart than half of it, level by level. The angle between anchor and
centre and the radius bound all inner products below a node from both sides.

Anchors descend the trees best first, twice: for their best candidates of the same label, and,
once these are known over all blocks, for candidates of other labels whose scores lie in the
windows that these open. Nodes that lie outside all windows are skipped; scores of what a
leaf holds are worked out as whole numbers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replipulse.llm.common import pick, written
from replipulse.llm.topk import quantized

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A negative's score lies between LOW / HIGH of its positive's score and that score.
LOW, HIGH = 80, 100
#: Candidates of a tree, anchors that descend it in one task, and candidates of a leaf.
TREE, ANCHORS, LEAF = 4096, 4096, 8
#: Room for rounding in the bounds, as a part of the largest score.
SLACK = 1e-9


# --- trees -------------------------------------------------------------------


def cover_tree(vectors: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float, int]]]:
    """Rows in the order of a cover tree, and its nodes as (first, end, radius, parent).

    A node holds the rows from its first, which is its centre, up to its end; nodes come
    before their children. Centres are taken farthest first until all rows lie within half of
    their parent's radius.
    """
    points = vectors.astype(np.float64)
    norms = (points * points).sum(axis=1)
    longest = norms.max(initial=0.0)
    points = np.concatenate([points, np.sqrt(np.maximum(longest - norms, 0))[:, None]], axis=1)
    if longest:
        points /= math.sqrt(longest)

    def angles(rows: np.ndarray, centre: int) -> np.ndarray:
        # From the chord, which is exact for small angles.
        chord = np.sqrt(((points[rows] - points[centre]) ** 2).sum(axis=1))
        return 2 * np.arcsin(np.minimum(chord / 2, 1))

    order = np.empty(len(points), np.int64)
    nodes: list[tuple[int, int, float, int]] = []
    rows = np.arange(len(points))
    work = [(rows, angles(rows, 0) if len(rows) else np.empty(0), 0, -1)] if len(rows) else []
    while work:
        rows, near, first, parent = work.pop()
        radius = float(near.max())
        number = len(nodes)
        nodes.append((first, first + len(rows), radius, parent))
        if len(rows) <= LEAF or radius == 0:
            order[first : first + len(rows)] = rows
            continue
        owner, centres = np.zeros(len(rows), np.int64), [0]
        near = near.copy()
        while near.max() > radius / 2:
            far = int(near.argmax())
            to_far = angles(rows, rows[far])
            closer = to_far < near
            owner[closer] = len(centres)
            near[closer] = to_far[closer]
            centres.append(far)
        by_owner = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_owner], np.arange(len(centres) + 1))
        for i, centre in enumerate(centres):
            mine = by_owner[cuts[i] : cuts[i + 1]]
            mine = np.concatenate(([centre], mine[mine != centre]))
            work.append((rows[mine], near[mine], first + cuts[i], number))
    return order, nodes


class Tree:
    """A tree as it is searched. Rows stand in its order, so a node is a range of them."""

    def __init__(self, ids: np.ndarray, row_keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, nodes: np.ndarray):
        self.ids, self.row_keys, self.labels, self.vectors = ids, row_keys, labels, vectors
        self.first, self.end = nodes[:, 0].astype(np.int64), nodes[:, 1].astype(np.int64)
        self.radius, parent = nodes[:, 2], nodes[:, 3].astype(np.int64)
        by_parent = np.argsort(parent, kind="stable")
        cuts = np.searchsorted(parent[by_parent], np.arange(len(nodes) + 1))
        self.children = [by_parent[cuts[i] : cuts[i + 1]] for i in range(len(nodes))]
        self.norm = math.sqrt(float((vectors.astype(object) ** 2).sum(axis=1).max())) if len(vectors) else 0.0


class Descent:
    """One anchor in one tree. Scores that are worked out once are kept for the next window."""

    def __init__(self, tree: Tree, anchor: np.ndarray, label: object, row_key: int) -> None:
        self.tree, self.anchor, self.label, self.row_key = tree, anchor, label, row_key
        self.reach = math.sqrt(float((anchor.astype(object) ** 2).sum())) * tree.norm
        self.scores = np.zeros(len(tree.ids), np.int64)
        self.known = np.zeros(len(tree.ids), bool)
        self.opened = 0

    def score(self, rows: np.ndarray) -> np.ndarray:
        new = rows[~self.known[rows]]
        if len(new):
            self.scores[new] = self.tree.vectors[new] @ self.anchor
            self.known[new] = True
            self.opened += len(new)
        return self.scores[rows]

    def bounds(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest scores below nodes."""
        centre = self.score(self.tree.first[nodes]).astype(np.float64)
        if not self.reach:
            return centre, centre
        angle = np.arccos(np.clip(centre / self.reach, -1, 1))
        radius, room = self.tree.radius[nodes], self.reach * SLACK + 1e-6
        # Beyond rounding of the centre's angle, which is coarse near 0 and pi.
        blur = np.where(radius > 0, 1e-7, 0.0)
        high = self.reach * np.cos(np.maximum(angle - radius - blur, 0)) + room
        low = self.reach * np.cos(np.minimum(angle + radius + blur, math.pi)) - room
        exact = radius == 0
        return np.where(exact, centre - room, low), np.where(exact, centre + room, high)

    def best(self, k: int, same: bool, low: float, high: float) -> list[tuple[int, int]]:
        """Ids and scores of the k best rows of the same, or of another, label within a window."""
        tree = self.tree
        found: list[tuple[int, int]] = []  # (score, -id), the worst on top
        root = np.zeros(1, np.int64) if len(tree.first) else np.empty(0, np.int64)
        heap: list[tuple[float, int]] = []

        def consider(nodes: np.ndarray) -> None:
            lowest, highest = self.bounds(nodes)
            inside = (highest >= low) & (lowest <= high)
            if len(found) == k:
                inside &= highest >= found[0][0]
            nodes, highest = nodes[inside], highest[inside]
            leaves = np.array([len(tree.children[n]) == 0 for n in nodes], bool)
            for node, value in zip(nodes[~leaves].tolist(), highest[~leaves].tolist()):
                heapq.heappush(heap, (-min(value, high), node))
            if leaves.any():
                starts, sizes = tree.first[nodes[leaves]], (tree.end - tree.first)[nodes[leaves]]
                rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                take(rows)

        def take(rows: np.ndarray) -> None:
            fits = (tree.labels[rows] == self.label) == same
            rows = rows[fits & (tree.row_keys[rows] != self.row_key)]
            scores = self.score(rows)
            inside = (scores >= low) & (scores <= high)
            if len(found) == k:
                inside &= scores >= found[0][0]
            rows, scores = rows[inside], scores[inside]
            order = np.lexsort((tree.ids[rows], -scores))[:k]
            for row, score in zip(rows[order].tolist(), scores[order].tolist()):
                entry = (score, -int(tree.ids[row]))
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)

        if len(root):
            consider(root)
        while heap:
            bound, node = heapq.heappop(heap)
            if len(found) == k and -bound < found[0][0]:
                break
            consider(tree.children[node])
        return [(-i, score) for score, i in sorted(found, reverse=True)]


# --- on Spark ----------------------------------------------------------------

_ROW = "cell long, place int, row long, id long, label string, vector array<int>, nodes binary"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(column), width), np.int64)
    found[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return found


def _by_cell(
    work: Callable[[pa.Table], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Work on the rows of one cell at a time; rows come sorted by their cell, the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[-1].column(0)[0].as_py() != cells[a]:
                    yield from work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _trees(rows: DataFrame, size: int, width: int, tree: int) -> DataFrame:
    """Candidates in the order of their block's tree; a row holds the nodes that begin with it."""
    blocks = max(1, math.ceil(size / tree))

    def plant(block: pa.Table) -> Iterator[pa.RecordBatch]:
        vectors = _matrix(block.column("vector").chunk(0), width)
        order, nodes = cover_tree(vectors)
        starting: list[list[float]] = [[] for _ in order]
        for number, (first, end, radius, parent) in enumerate(nodes):
            starting[first] += [number, first, end, radius, parent]
        packed = [np.array(s, np.float64).tobytes() for s in starting]
        taken = block.select(["cell", "row", "id", "label", "vector"]).take(pa.array(order)).combine_chunks()
        names = ["cell", "place", "row", "id", "label", "vector", "nodes"]
        columns = {n: taken.column(n).chunk(0) for n in taken.column_names}
        columns |= {"place": pa.array(np.arange(len(order), dtype=np.int32)), "nodes": pa.array(packed, pa.binary())}
        for i in range(0, len(order), 1024):
            yield pa.RecordBatch.from_arrays([columns[n].slice(i, 1024) for n in names], names)

    cell = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("cell")
    dealt = rows.select(cell, "row", "id", "label", "vector").repartition("cell").sortWithinPartitions("cell", "row")
    return dealt.mapInArrow(_by_cell(plant), _ROW)


def _descended(
    trees: DataFrame, anchors: DataFrame, width: int, counts: tuple[int, int],
    search: Callable[[Descent, dict], Iterator[tuple[int, ...]]], out: list[str],
) -> DataFrame:
    """Every block of anchors meets every tree, a task for each pair of them.

    ``anchors`` has ``row``, ``id``, ``label``, ``vector`` and ``windows``.
    """
    tree_blocks, anchor_blocks = counts
    met = trees.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    rows = met.select(
        (F.col("cell") * anchor_blocks + F.col("other")).alias("cell"),
        "place", "row", "id", "label", "vector", "nodes", F.lit(None).cast("array<bigint>").alias("windows"),
    )
    mine = F.pmod(F.xxhash64("row"), F.lit(anchor_blocks))
    asking = anchors.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tree_blocks - 1))))
    asked = asking.select(
        (F.col("other") * anchor_blocks + mine).alias("cell"),
        F.lit(-1).alias("place"), "row", "id", "label", "vector", F.lit(None).cast("binary").alias("nodes"), "windows",
    )
    names = [f.split()[0] for f in out]

    def work(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        place = cell.column("place").to_numpy()
        vectors = _matrix(cell.column("vector").chunk(0), width)
        ids, keys = cell.column("id").to_numpy(), cell.column("row").to_numpy()
        labels = np.array(cell.column("label").to_pylist(), object)
        inside = place >= 0
        if inside.all() or not inside.any():
            return
        nodes = np.frombuffer(b"".join(b for b in cell.column("nodes").to_pylist() if b), np.float64).reshape(-1, 5)
        nodes = nodes[np.argsort(nodes[:, 0])][:, 1:]
        tree = Tree(ids[inside], keys[inside], labels[inside], vectors[inside], nodes)
        windows = cell.column("windows").to_pylist()
        found = []
        for i in np.flatnonzero(~inside).tolist():
            descent = Descent(tree, vectors[i], labels[i], int(keys[i]))
            given = {"row": int(keys[i]), "id": int(ids[i]), "windows": windows[i]}
            found += search(descent, given)
        for i in range(0, len(found), 10_000):
            columns = zip(*found[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    cells = rows.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "place")
    return cells.mapInArrow(_by_cell(work), ", ".join(out))


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = EVERY,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    tree: int = TREE,
    anchor_block: int = ANCHORS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``,
    and ``opened``: the candidates of the negative's block whose scores the anchor worked out.

    Components become floor(scale * x); a score is the whole inner product with the anchor, and
    must fit a long. Anchors are rows whose id is divisible by ``every``; their positives are
    the best other rows of their label. For each, the best ``negatives`` rows of other labels
    whose score s satisfies low * positive <= high * s <= high * positive are given, ranked
    from 1. Ties go to the smaller id.

    Rows with a null id or label, or a vector that is null or holds a null or non-finite
    component, take no part. Rows that repeat an id are rows of their own: as anchors they
    each get their rows, as candidates each may be named. Vectors of different lengths are
    compared as if the shorter one ended in zeros. A positive below zero has an empty
    window. An empty table, or one without an anchor, gives no row. Other columns are not read.
    """
    rows = pick(vectors, id=id_col, vector=vector_col, label=label_col)
    whole = rows.select(
        F.col("id").cast("long").alias("id"),
        F.col("label").cast("string").alias("label"),
        quantized(F.col("vector"), scale).cast("array<int>").alias("vector"),
    )
    usable = whole.filter("id is not null and label is not null and vector is not null")
    usable = written(usable.withColumn("row", F.monotonically_increasing_id()), "hardneg-vectors")
    asks = F.col("id") % every == 0
    size = usable.agg(F.count("*").alias("rows"), F.count_if(asks).alias("anchors"), F.max(F.size("vector")).alias("width")).first()
    width = size["width"] or 0
    counts = max(1, math.ceil(size["rows"] / tree)), max(1, math.ceil(size["anchors"] / anchor_block))
    trees = written(_trees(usable, size["rows"], width, tree), "hardneg-trees")
    anchors = usable.filter(asks)

    def first_pass(descent: Descent, given: dict) -> Iterator[tuple[int, ...]]:
        for found, score in descent.best(positives, True, -math.inf, math.inf):
            yield given["row"], found, score

    plain = anchors.withColumn("windows", F.lit(None).cast("array<bigint>"))
    near = _descended(trees, plain, width, counts, first_pass, ["anchor long", "id long", "score long"])
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    chosen = written(chosen, "hardneg-positives")
    # One row per anchor, with a few positives each.
    windows = chosen.groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_set("score")).alias("windows"))

    def second_pass(descent: Descent, given: dict) -> Iterator[tuple[int, ...]]:
        for score in given["windows"]:
            for found, other in descent.best(negatives, False, -(-low * score // high), score):
                yield given["row"], score, found, other, descent.opened

    open_windows = anchors.join(windows, "row")
    out = ["anchor long", "score long", "negative_id long", "negative_score long", "opened long"]
    found = _descended(trees, open_windows, width, counts, second_pass, out)
    order = Window.partitionBy("anchor", "score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = chosen.select("anchor", F.col("id").alias("positive_id"), "score", "place").join(
        anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor"
    )
    return named.join(ranked, ["anchor", "score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score", "opened"
    )
