"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens, document after document. Merging the queues by the time
``(place + 1/2) / weight`` gives every token a rank, and ranks are cut into frames of
``FRAME`` windows. A rank has a closed form, so a task finds the frames of its documents
by itself, and what a queue still has to give at the end of a frame (its deficit, below
one token) is carried into the next one, whatever partition that falls into.

Within a frame, one task, deficit round-robin fills window after window: each queue's
deficit grows by its share of the window, queues whose deficit reaches ``QUANTUM`` tokens
send that much in turn, and what room is left goes to the largest deficits, which then
turn negative. Deficits are carried from window to window and are zero at the frame's end.

Weights are the queues' own tokens unless given: then all queues end together. With
other weights, the queues that last longer share what the ended ones leave.

Sources without a queue of their own share one. Their documents are cut into pieces, which
stand in the shared queue by each source's own time, so that any stretch of it holds its
sources in proportion. The weight of a shared queue is the sum of its sources'.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from replipulse.llm.common import in_chunks, pick, written

WINDOW = 2048  # tokens of a full sequence
FRAME = 128  # windows
QUANTUM = 128  # tokens
END = 1  # id after each document
#: Queues of their own for so many sources, those with most tokens; the others share.
OWN_QUEUES, SHARED_QUEUES = 448, 64
CHUNK_CHARS = 1 << 20

# --- tokens ------------------------------------------------------------------

_RARE = re.compile("[ɐ-\U0010ffff]")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of texts by one vocabulary, for which two public libraries have files.

    Latin texts take the faster library. Texts with other characters, for which the
    libraries' Unicode tables may differ in version, and texts that hold the special
    token take ``tokenizers``.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            # The special token is named, as a search for none would stop at every byte.
            special = {_SPECIAL: max(ranks.values()) + 1}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def array(self, text: str) -> np.ndarray:
        if self.fast and not _RARE.search(text) and _SPECIAL not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> list[int]:
        return self.array(text).tolist()


def _paths(tokenizer_path: str | None, ranks_path: str | None) -> tuple[str, str | None]:
    if tokenizer_path:
        return tokenizer_path, ranks_path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenized(rows: DataFrame, tokenizer_path: str | None, ranks_path: str | None) -> DataFrame:
    """Ids of every row, its source, and its place in what its task has of that source."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*_paths(tokenizer_path, ranks_path))
        part = TaskContext.get().partitionId()
        filled: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sources = batch.column(1).to_pylist()
            for a, b in in_chunks([len(t or "") for t in texts], CHUNK_CHARS):
                ids, names, places, sizes = [], [], [], []
                for text, source in zip(texts[a:b], sources[a:b]):
                    found = np.append(encoder.array(text or ""), np.uint32(END))
                    name = source or ""
                    places.append(filled.get(name, 0))
                    filled[name] = places[-1] + len(found)
                    names.append(name)
                    sizes.append(len(found))
                    ids.append((found.astype("<u2") if found.max() < 1 << 16 else found).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([part] * (b - a), pa.int64()),
                        pa.array(names, pa.string()),
                        pa.array(places, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["id", "part", "source", "place", "size", "ids"],
                )

    return rows.mapInArrow(run, f"id {kind}, part long, source string, place long, size long, ids binary")


def _before(rows: DataFrame, key: str) -> DataFrame:
    """Per key and part, the tokens of the parts before."""
    parts = rows.groupBy(key, "part").agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, "part", "size", F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("before"))


def _interleaved(rows: DataFrame, piece: int) -> DataFrame:
    """Rows of shared queues, with ``source``, ``place`` in it and ``weight``, as pieces with a
    place in the queue: by the time of their middle.

    A range sort over keys that end in a place, so no range is one large source or queue.
    """
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(piece).cast("long")))
    cut = rows.withColumn("start", at).withColumn("length", F.least(F.col("size") - F.col("start"), F.lit(piece)))
    width = F.octet_length("ids") / F.col("size")
    data = F.substring("ids", (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    place = F.col("place") + F.col("start")
    time = (place + F.col("length") / 2) / F.col("weight")
    pieces = cut.select(
        "id", "queue", time.alias("time"), "source", place.alias("place"), F.col("length").alias("size"),
        data.alias("ids"), "start", F.col("size").alias("doc_tokens"),
    )
    order = ["queue", "time", "source", "place"]
    kind = rows.schema["id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        filled: dict[int, int] = {}
        for batch in batches:
            queue, size = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("queue", "size"))
            places = np.cumsum(size) - size
            for q in np.unique(queue):
                mine = queue == q  # neighbours, as rows are in order
                places[mine] += filled.get(int(q), 0) - places[mine][0]
                filled[int(q)] = int(places[mine][-1] + size[mine][-1])
            kept = [batch.column(n) for n in ("id", "queue", "size", "ids", "start", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(places.astype(np.int64)), pa.array(np.full(len(size), part, np.int64))],
                ["id", "queue", "size", "ids", "start", "doc_tokens", "place", "part"],
            )

    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"id {kind}, queue long, size long, ids binary, start long, doc_tokens long, place long, part long"
    found = written(ordered.mapInArrow(number, schema), "packing-shared")
    parts = written(_before(found, "queue"), "packing-shared-parts")
    return found.join(parts.select("queue", "part", "before"), ["queue", "part"]).select(
        "id", "queue", (F.col("before") + F.col("place")).alias("place"), "size", "ids", "start", "doc_tokens"
    )


# --- ranks -------------------------------------------------------------------


class Mixture:
    """Ranks of the tokens of queues: by time, then by queue."""

    def __init__(self, tokens: np.ndarray, weights: np.ndarray) -> None:
        self.tokens, self.weights = tokens, weights

    def rank(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        time = (place + 0.5) / self.weights[queue]
        total = np.zeros(len(queue), np.int64)
        for q in np.flatnonzero(self.tokens):
            tokens, weight = self.tokens[q], self.weights[q]
            # The first place whose token does not come before this time.
            count = np.clip(np.ceil(time * weight - 0.5), 0, tokens).astype(np.int64)
            count -= (count > 0) & ((count - 0.5) / weight >= time)
            count += (count < tokens) & ((count + 0.5) / weight < time)
            # At the same time, a queue before this one is first.
            count += (q < queue) & (count < tokens) & ((count + 0.5) / weight == time)
            total += np.where(queue == q, place, count)
        return total

    def first_place(self, queue: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The first place between low and high whose rank is not below the one given."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high) // 2
            below = self.rank(queue, middle) < rank
            low = np.where(below & (low < high), middle + 1, low)
            high = np.where(~below & (low < high), middle, high)
        return low


def _to_frames(mixture: Mixture, frame_tokens: int, kind: str):
    """Cut documents where a frame ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queue, place, size = (
                batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3)
            )
            ids = batch.column(4).to_pylist()
            base, whole = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            first = mixture.rank(queue, place) // frame_tokens
            last = mixture.rank(queue, place + size - 1) // frame_tokens
            row = np.repeat(np.arange(len(queue)), last - first + 1)
            step = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            frame = first[row] + step
            start = np.zeros(len(row), np.int64)
            inner = np.flatnonzero(step > 0)
            r = row[inner]
            if len(inner):
                start[inner] = (
                    mixture.first_place(queue[r], place[r], place[r] + size[r], frame[inner] * frame_tokens)
                    - place[r]
                )
            end = np.append(start[1:], 0)
            final = np.append(row[1:] != row[:-1], True) if len(row) else np.empty(0, bool)
            end = np.where(final, size[row], end)
            # A queue may leave out a frame; such a part is empty.
            some = np.flatnonzero(end > start)
            for lo, hi in in_chunks(((end - start)[some] * 4).tolist(), 1 << 23):
                at = some[lo:hi]
                r = row[at]
                width = [len(ids[i]) // int(size[i]) for i in r]
                cut = [ids[i][s * w : e * w] for i, s, e, w in zip(r, start[at].tolist(), end[at].tolist(), width)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(r)),
                        pa.array(frame[at]),
                        pa.array(queue[r]),
                        pa.array(place[r] + start[at]),
                        pa.array(base[r] + start[at]),
                        pa.array(end[at] - start[at]),
                        pa.array(whole[r]),
                        pa.array(cut, pa.binary()),
                    ],
                    ["id", "frame", "queue", "place", "start", "length", "doc_tokens", "ids"],
                )

    schema = (
        f"id {kind}, frame long, queue long, place long, start long, length long, "
        "doc_tokens long, ids binary"
    )
    return run, schema


# --- windows -----------------------------------------------------------------


def round_robin(quota: np.ndarray, window: int = WINDOW, quantum: int = QUANTUM) -> list[list[tuple[int, int]]]:
    """Fill windows from queues with so many tokens: per window, (queue, tokens) in turn."""
    left = quota.astype(np.int64).copy()
    total = int(left.sum())
    share = left / max(total, 1) * window
    deficit = np.zeros(len(left))
    windows = []
    turn = 0
    while total:
        room = min(window, total)
        total -= room
        deficit += share
        sent: dict[int, int] = {}
        ready = np.flatnonzero((deficit >= quantum) & (left > 0))
        for q in (*ready[ready >= turn], *ready[ready < turn]):
            amount = int(min(deficit[q], left[q], room))
            if amount:
                sent[q] = amount
                left[q] -= amount
                deficit[q] -= amount
                room -= amount
                turn = int(q) + 1
        while room:
            q = int(np.argmax(np.where(left > 0, deficit, -np.inf)))
            amount = int(min(left[q], room, max(quantum, deficit[q])))
            sent[q] = sent.get(q, 0) + amount
            left[q] -= amount
            deficit[q] -= amount
            room -= amount
        windows.append(list(sent.items()))
    return windows


def powers_of_two(tokens: int) -> list[int]:
    return [1 << b for b in range(tokens.bit_length() - 1, -1, -1) if tokens >> b & 1]


def _packer(window: int, frame_windows: int, quantum: int, with_ids: bool, kind: pa.DataType):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = [kind, *[pa.int64()] * 6]
    if with_ids:
        names, types = [*names, "token_ids"], [*types, pa.list_(pa.int32())]

    def pack(frame: int, rows: list[tuple]) -> pa.RecordBatch:
        """rows: (id, queue, start, length, doc_tokens, ids), by queue and place."""
        queues = sorted({r[1] for r in rows})
        number = {q: i for i, q in enumerate(queues)}
        grouped: dict[int, list[tuple]] = {q: [] for q in queues}
        for r in rows:
            grouped[r[1]].append(r)
        waiting = {q: iter(g) for q, g in grouped.items()}
        quota = np.zeros(len(queues), np.int64)
        for r in rows:
            quota[number[r[1]]] += r[3]
        current = {q: None for q in queues}
        out: list[tuple] = []
        sequence = frame * frame_windows
        for sends in round_robin(quota, window, quantum):
            filled = sum(n for _, n in sends)
            sizes = [filled] if filled == window else powers_of_two(filled)
            room, offset = sizes.pop(0), 0
            for i, tokens in sends:
                q = queues[i]
                while tokens:
                    if current[q] is None:
                        r = next(waiting[q])
                        data = r[5] if len(r[5]) == 4 * r[3] else np.frombuffer(r[5], "<u2").astype("<u4").tobytes()
                        current[q] = (r, memoryview(data), 0)
                    r, data, used = current[q]
                    take = min(tokens, r[3] - used, room)
                    part = data[4 * used : 4 * (used + take)]
                    values = (r[0], r[2] + used, take, zlib.crc32(part), r[4], sequence, offset)
                    out.append((*values, np.frombuffer(part, "<i4")) if with_ids else values)
                    current[q] = (r, data, used + take) if used + take < r[3] else None
                    tokens -= take
                    room -= take
                    offset += take
                    if not room:
                        sequence, offset = sequence + 1, 0
                        room = sizes.pop(0) if sizes else 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for row_id, found, *rest in zip(*columns):
                if found != frame and rows:
                    yield pack(frame, rows)
                    rows = []
                frame = found
                rows.append((row_id, *rest))
        if rows:
            yield pack(frame, rows)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Mapping[str, float] | None = None,
    window: int = WINDOW,
    frame_windows: int = FRAME,
    quantum: int = QUANTUM,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, if asked for, ``token_ids``.

    Every id of every row, and the end id, lies in exactly one piece. Sequences are full;
    what is left after the last full one is cut into sequences of powers of two, so that
    none is padded. Null and empty texts are the end id alone. A null source is a queue of
    its own, named by the empty text. Rows that repeat are packed as often as they come.
    Columns other than those named are not read; an empty table gives no row. The sources
    with most tokens have their own queue, the rest share queues by a hash of their name, in
    pieces of ``quantum`` tokens at most; ``weights`` hold for the sources they name, others
    keep the weight of their tokens.
    """
    rows = pick(docs, id=id_col, source=source_col, text=text_col)
    tokens = written(tokenized(rows, tokenizer_path, ranks_path), "packing-tokens")
    parts = written(_before(tokens, "source"), "packing-parts")
    totals = written(parts.groupBy("source").agg(F.sum("size").alias("tokens")), "packing-totals")
    most = totals.orderBy(F.desc("tokens"), "source").limit(OWN_QUEUES).collect()
    own = {r["source"]: i for i, r in enumerate(most)}
    given = {source or "": float(weight) for source, weight in (weights or {}).items()}
    size = totals.agg(F.count("*").alias("sources"), F.sum("tokens").alias("tokens")).first()
    named = rows.sparkSession.createDataFrame(
        [(s, own.get(s), given.get(s)) for s in sorted({*own, *given})], "source string, own long, given double"
    )
    shared = F.lit(len(own)) + F.pmod(F.crc32("source"), F.lit(SHARED_QUEUES))
    sources = written(
        totals.join(named, "source", "left").select(
            "source",
            "tokens",
            F.coalesce("own", shared).alias("queue"),
            F.coalesce(F.col("given") * (size["tokens"] or 0), F.col("tokens").cast("double")).alias("weight"),
        ),
        "packing-sources",
    )
    held = np.zeros(len(own) + SHARED_QUEUES, np.int64)
    share = np.ones(len(held))
    queues = sources.groupBy("queue").agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight"))
    for r in queues.collect():  # a row per queue
        held[r["queue"]], share[r["queue"]] = r["tokens"], r["weight"]
    kind = rows.schema["id"].dataType.simpleString()
    cut, schema = _to_frames(Mixture(held, share), window * frame_windows, kind)
    starts = written(
        parts.join(sources, "source").select("source", "part", "before", "queue", "weight"), "packing-starts"
    )
    found = tokens.join(starts, ["source", "part"]).withColumn("place", F.col("before") + F.col("place"))
    alone = found.filter(F.col("queue") < len(own)) if size["sources"] > len(own) else found
    placed = alone.select(
        "id", "queue", "place", "size", "ids", F.lit(0).cast("long").alias("start"), F.col("size").alias("doc_tokens")
    )
    if size["sources"] > len(own):
        placed = placed.unionByName(_interleaved(found.filter(F.col("queue") >= len(own)), quantum))
    frames = placed.mapInArrow(cut, schema).repartition("frame").sortWithinPartitions("frame", "queue", "place")
    run = _packer(window, frame_windows, quantum, with_ids, to_arrow_type(rows.schema["id"].dataType))
    packed = frames.select("id", "frame", "queue", "start", "length", "doc_tokens", "ids").mapInArrow(
        run,
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", token_ids array<int>" if with_ids else ""),
    )
    return packed.withColumnRenamed("id", id_col)
