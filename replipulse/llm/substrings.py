"""Removal of repeated byte strings by suffix arrays, built by the difference-cover algorithm.

Every byte that a string of ``length`` bytes covers goes if that string starts anywhere else.

Distribution. Of the grams that begin within a window from a start, the smallest by hash (the
first of several) is the start's anchor. Equal strings have their anchors at one offset, and
equal bytes behind them, so all starts of one string share a key, a hash of these bytes.
Neighbouring starts with one anchor are a stretch: one narrow row. Keys of one stretch alone
repeat nothing; stretches that equal another one byte by byte (by two hashes) repeat
as a whole. Only of keys with different stretches are the bytes needed, once for equal ones.

Suffix arrays. Stretches of such keys are dealt by key to shards of bounded size. A shard's
suffixes are put in order by the difference-cover algorithm: the triples at two of three
places are sorted and named, the names' own suffixes are put in order by recursion if names
repeat, the remaining suffixes are sorted by their first letter and the rank of what follows,
and both are merged. Starts whose neighbour in this order has the same ``length`` bytes repeat.

A key with more stretches than a shard takes is not cut short: its stretches are cut into short
ones by the distance from the anchor, whose keys are all but a few bytes of their strings. They
are dealt like the others; should one of these keys have too many stretches again, its starts
go by themselves, counted by two hashes of their bytes, so no group is in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replipulse.llm.common import as_bytes, pick, written

LENGTH = 200
#: Bytes of a gram, bytes of text that are looked at at once, stretches a key may have in a
#: shard, bytes of a shard, and stretches' bytes that are handed on at once.
GRAM, CHUNK, CLASS, SHARD, HELD_PIECES = 16, 1 << 18, 2048, 1 << 20, 1 << 13
#: Short stretches of a window.
PARTS = 8

_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _words(raw: bytes | bytearray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))


def _hashed(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of byte ranges of eight bytes or more; the last word overlaps the one before."""
    h = sizes.astype(np.uint64) * _M[0] + np.uint64(seed)
    last = sizes - 8
    for at in range(0, int(last.max(initial=-8)) + 8, 8):
        on = np.flatnonzero(last > at - 8)
        part = h[on] ^ words[starts[on] + np.minimum(at, last[on])]
        part *= _M[1]
        part ^= part >> np.uint64(32)
        part *= _M[2]
        h[on] = part ^ (part >> np.uint64(29))
    return h.view(np.int64)


def window_of(length: int) -> int:
    """Places an anchor may have; what is left of the string is the key, and holds a gram."""
    return max(1, min(length * 5 // 8, length - GRAM + 1))


def stretches(raw: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First and last start, ``key`` and ``whole`` (a hash of all bytes) of each stretch.

    ``starts`` are places of ``raw``, in order, that have ``length`` bytes.
    """
    words = _words(raw)
    anchor = _anchors(words, starts, length)
    fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1))))
    first, last = starts[fresh], starts[np.concatenate((fresh[1:] - 1, [len(starts) - 1]))]
    rest = np.full(len(fresh), length - window_of(length) + 1)
    return first, last, _hashed(words, anchor[fresh], rest, 1), _hashed(words, first, last - first + length, 2)


def _anchors(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    window = window_of(length)
    h = words[: len(words) - 8] * _M[0]
    h ^= h >> np.uint64(32)
    h += words[8:] * _M[1]
    h ^= h >> np.uint64(29)
    h *= _M[2]
    # The place makes the first of equal grams the smallest.
    low = h & ~np.uint64((1 << 20) - 1) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[starts], low[starts + (window - size)])
    return (low & np.uint64((1 << 20) - 1)).astype(np.int64)


def _portions(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts of ``length`` bytes or more as (text, place, bytes), some at once; long ones overlap."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, CHUNK):
            part = text if len(text) <= CHUNK else text[at : at + CHUNK + length - 1]
            if held and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
            if part is text:
                break
    if held:
        yield held


def marks(rows: DataFrame, length: int) -> DataFrame:
    """``row``, ``first``, ``last``, ``key``, ``whole`` of every stretch of ``row``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            for portion in _portions(texts, length):
                sizes = np.array([len(p) for _, _, p in portion])
                begins = np.cumsum(sizes) - sizes
                fits = sizes - length + 1
                starts = np.repeat(begins - np.cumsum(fits) + fits, fits) + np.arange(fits.sum())
                first, last, key, whole = stretches(b"".join([p for _, _, p in portion]), starts, length)
                owner = np.searchsorted(begins, first, "right") - 1
                shift = np.array([at for _, at, _ in portion])[owner] - begins[owner]
                row = batch.column(0).take(pa.array(np.array([i for i, _, _ in portion])[owner]))
                yield pa.RecordBatch.from_arrays(
                    [row, pa.array(first + shift), pa.array(last + shift), pa.array(key), pa.array(whole)],
                    ["row", "first", "last", "key", "whole"],
                )

    return rows.select("row", "text").mapInArrow(run, "row long, first long, last long, key long, whole long")


# --- suffix arrays -----------------------------------------------------------


def suffix_order(letters: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order. Letters are whole numbers from 1 on, below 2^21."""
    n = len(letters)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: letters[i:].tolist()), np.int64)
    padded = np.concatenate([letters, np.zeros(3, letters.dtype)]).astype(np.uint64)
    base = padded.max() + np.uint64(1)
    # Places 1 and 2 of every three; one beyond the end keeps the halves of the names apart.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([ones, np.arange(2, n, 3)])
    triples = (padded[sample] * base + padded[sample + 1]) * base + padded[sample + 2]
    named, names = np.unique(triples, return_inverse=True)
    if len(named) < len(sample):
        inner = suffix_order(names.astype(np.int64) + 1)
        names = np.empty(len(sample), np.int64)
        names[inner] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.uint64)
    rank[sample] = names.astype(np.uint64) + np.uint64(1)
    ordered = np.empty(len(sample), np.int64)
    ordered[names] = sample
    ordered = ordered[ordered < n]
    many = np.uint64(n + 3)

    def one(at: np.ndarray) -> np.ndarray:
        return padded[at] * many + rank[at + 1]

    def two(at: np.ndarray) -> np.ndarray:
        return (padded[at] * base + padded[at + 1]) * many + rank[at + 2]

    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(one(rest), kind="stable")]
    # Remaining suffixes stand behind the sampled ones that are smaller.
    smaller = np.searchsorted(one(ordered[ordered % 3 == 1]), one(rest))
    smaller += np.searchsorted(two(ordered[ordered % 3 == 2]), two(rest))
    found = np.empty(n, np.int64)
    at_rest = smaller + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[at_rest] = True
    found[at_rest] = rest
    found[~taken] = ordered
    return found


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece: whether a string of ``length`` bytes that starts there has an equal one."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    # Bytes from 2 on, so that 1 ends a piece before any byte.
    raw = b"\0".join(pieces) + bytes(length)
    letters = np.frombuffer(raw, np.uint8)[: int(sizes.sum()) + len(pieces)].astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    letters[ends] = 1
    order = suffix_order(letters)
    begins = ends - sizes
    whole = np.zeros(len(letters), bool)
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        whole[begin : begin + size - length + 1] = True
    order = order[whole[order]]
    equal = np.ones(max(len(order) - 1, 0), bool)
    words = _words(raw)
    for at in [*range(0, length - 8, 8), length - 8]:  # neighbours that are equal so far
        left = np.flatnonzero(equal)
        equal[left] = words[order[left] + at] == words[order[left + 1] + at]
    again = np.zeros(len(letters), bool)
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    return [again[b : b + s] for b, s in zip(begins.tolist(), sizes.tolist())]


def _shards(length: int, shard: int):
    """Intervals of repeated strings in pieces that come sorted by key; whole keys at a time."""

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        pieces = as_bytes(table.column("piece").chunk(0))
        found = repeated_starts(pieces, length)
        row, first, alone = (table.column(c).to_numpy() for c in ("row", "first", "alone"))
        at = [i for i in range(len(pieces)) if alone[i]]
        starts = [np.flatnonzero(found[i]) for i in at]
        many = [len(s) for s in starts]
        if sum(many):
            places = np.concatenate(starts) + np.repeat(first[at], many)
            yield _intervals(np.repeat(row[at], many), places, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if size > shard and held[-1].column(0)[-1].as_py() != keys[a]:
                    yield from work(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += sum(map(len, as_bytes(held[-1].column("piece"))))
        if held:
            yield from work(held)

    return run


def _intervals(row: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Bytes that strings cover, neighbouring starts as one interval; rows of one text are together."""
    fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:] - 1, [len(row) - 1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(row[first]), pa.array(start[first]), pa.array(start[last] + length)], ["row", "start", "end"]
    )


_INTERVAL = "row long, start long, end long"


# --- on Spark ----------------------------------------------------------------


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed for the way to another task: ``row``, further columns, ``packed``."""
    kept = [c for c in rows.columns if c != "text"]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(batch.num_columns - 1))]
            packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, packed], [*kept, "size", "packed"])

    return rows.select(*kept, "text").mapInArrow(run, f"{fields}, size long, packed binary")


def _unpack(batch: pa.RecordBatch) -> list[bytes]:
    codec = pa.Codec("zstd")
    sizes, packed = batch.column("size").to_pylist(), batch.column("packed").to_pylist()
    return [codec.decompress(p, decompressed_size=n, asbytes=True) if n else b"" for p, n in zip(packed, sizes)]


def _pieces(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the stretches wanted, with ``key``, ``row``, ``first``, ``alone`` and ``large``."""
    listed = wanted.groupBy("row").agg(
        F.collect_list(F.struct("first", "last", "key", "alone", "large")).alias("stretches")
    )

    names = ["key", "row", "first", "alone", "large", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*found) if found else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                row, (text,) = part.column("row")[0].as_py(), _unpack(part)
                for s in part.column("stretches")[0].as_py():
                    piece = text[s["first"] : s["last"] + length]
                    found.append((s["key"], row, s["first"], s["alone"], s["large"], piece))
                    if len(found) == HELD_PIECES:
                        yield out()
                        found.clear()
        yield out()

    joined = _packed(rows.select("row", "text")).join(listed, "row").select("row", "size", "packed", "stretches")
    return joined.mapInArrow(run, "key long, row long, first long, alone boolean, large boolean, piece binary")


def refined(piece: bytes, length: int) -> tuple[np.ndarray, ...]:
    """A stretch as short stretches: first and last start, ``key`` and ``whole`` of each.

    Starts of equal strings are as far from their anchor, so stretches are cut by that distance
    and no string lies in two. All strings of a short stretch hold the bytes of its key, which
    are all but a few of theirs.
    """
    words = _words(piece)
    step = max(1, window_of(length) // PARTS)
    anchor = _anchors(words, np.zeros(1, np.int64), length)[0]
    part = (anchor - np.arange(len(piece) - length + 1)) // step
    cuts = np.flatnonzero(np.diff(part)) + 1
    first, last = np.append(0, cuts), np.append(cuts - 1, len(part) - 1)
    part = part[first]
    key = _hashed(words, anchor - part * step, np.full(len(part), length - step + 1), 5)
    key = (key.view(np.uint64) ^ part.astype(np.uint64) * _M[3]).view(np.int64)
    return first, last, key, _hashed(words, first, last - first + length, 6)


def _of_large_keys(pieces: DataFrame, length: int, largest: int, shard: int) -> DataFrame:
    """Intervals of keys with very many stretches: of short stretches with keys of their own."""
    names = ["key", "whole", "row", "first", "alone", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                found: list[tuple] = []
                for row, start, alone, piece in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns)):
                    for first, last, key, whole in zip(*(a.tolist() for a in refined(piece, length))):
                        found.append((key, whole, row, start + first, alone, piece[first : last + length]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    short = pieces.select("row", "first", "alone", "piece").mapInArrow(
        run, "key long, whole long, row long, first long, alone boolean, piece binary"
    )
    short = written(short, "substrings-short")
    keys = short.groupBy("key").agg(F.count("*").alias("times"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    again = keys.filter("times > 1").select("key", (F.col("a") != F.col("b")).alias("mixed"))
    hits = written(short.join(written(again, "substrings-short-keys"), "key"), "substrings-short-hits")
    covers = [F.col("row"), F.col("first").alias("start"), (F.col("first") + F.octet_length("piece")).alias("end")]
    same = hits.filter("not mixed and alone").select(*covers)
    mixed = hits.filter("mixed")
    kinds_of = mixed.groupBy("key", "whole").agg(
        F.count("*").alias("times"), F.first("row").alias("row"), F.first("first").alias("first"),
        F.bool_or("alone").alias("alone"), F.first("piece").alias("piece"),
    )
    kinds_of = written(kinds_of.withColumn("alone", F.col("alone") & (F.col("times") == 1)), "substrings-short-kinds")
    equal = kinds_of.filter("times > 1").select("key", "whole")
    copies = mixed.filter("alone").join(equal, ["key", "whole"]).select(*covers)
    many = kinds_of.groupBy("key").count().filter(F.col("count") > largest).select("key", F.lit(True).alias("large"))
    found = kinds_of.join(written(many, "substrings-short-large"), "key", "left")
    dealt = found.filter("large is null").select("key", "row", "first", "alone", "piece")
    sharded = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(length, shard), _INTERVAL)
    rest = _by_start(found.filter("large").select("row", "first", "alone", "piece"), length)
    return same.unionByName(copies).unionByName(sharded).unionByName(rest)


def _by_start(pieces: DataFrame, length: int) -> DataFrame:
    """Intervals of short keys with very many stretches even so: each start by itself, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first = (batch.column(c).to_numpy() for c in ("row", "first"))
            alone = batch.column("alone").to_numpy(zero_copy_only=False)
            for i, piece in enumerate(as_bytes(batch.column("piece"))):
                starts = np.arange(len(piece) - length + 1)
                sizes, words = np.full(len(starts), length), _words(piece)
                hashes = [pa.array(_hashed(words, starts, sizes, seed)) for seed in (3, 4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *hashes,
                        pa.array(np.full(len(starts), row[i])),
                        pa.array(starts + first[i]),
                        pa.array(np.full(len(starts), alone[i])),
                    ],
                    ["one", "two", "row", "start", "alone"],
                )

    single = pieces.select("row", "first", "alone", "piece").mapInArrow(run, "one long, two long, row long, start long, alone boolean")
    single = written(single, "substrings-starts")
    # Stored, so that both sides of the join are plain and a frequent string is split.
    often = written(single.groupBy("one", "two").count().filter("count > 1").select("one", "two"), "substrings-often")
    found = single.filter("alone").join(often, ["one", "two"])
    return found.select("row", "start", (F.col("start") + length).alias("end"))


def _intervals_of(rows: DataFrame, length: int, largest: int, shard: int) -> DataFrame:
    """``row``, ``start``, ``end``: bytes covered by strings that repeat; they may overlap."""
    found = marks(rows, length)
    keys = found.groupBy("key").agg(F.count("*").alias("times"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    again = keys.filter("times > 1").select("key", (F.col("a") != F.col("b")).alias("mixed"))
    # Stored, so that both sides of the join are plain and a frequent key is split.
    hits = written(found.join(written(again, "substrings-keys"), "key"), "substrings-stretches")
    covers = [F.col("row"), F.col("first").alias("start"), (F.col("last") + length).alias("end")]
    same = hits.filter("not mixed").select(*covers)
    mixed = hits.filter("mixed")
    kinds = mixed.groupBy("key", "whole").agg(
        F.count("*").alias("times"), F.first("row").alias("row"), F.first("first").alias("first"), F.first("last").alias("last")
    )
    kinds = written(kinds, "substrings-kinds")
    copies = mixed.join(kinds.filter("times > 1").select("key", "whole"), ["key", "whole"]).select(*covers)
    many = written(kinds.groupBy("key").count().filter(F.col("count") > largest).select("key", F.lit(True).alias("large")), "substrings-large")
    wanted = kinds.join(many, "key", "left").select(
        "key", "row", "first", "last", (F.col("times") == 1).alias("alone"), F.coalesce("large", F.lit(False)).alias("large")
    )
    pieces = written(_pieces(rows, wanted, length), "substrings-pieces")
    dealt = pieces.filter("not large").select("key", "row", "first", "alone", "piece")
    sharded = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(length, shard), _INTERVAL)
    single = _of_large_keys(pieces.filter("large"), length, largest, shard)
    return same.unionByName(copies).unionByName(sharded).unionByName(single)


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Intervals that overlap or touch as one, in order: rows of (start, end)."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    last = np.concatenate((fresh[1:] - 1, [len(starts) - 1]))
    return np.stack([starts[fresh], reach[last]], axis=1)


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    stored: bool = False,
    largest: int = CLASS,
    shard: int = SHARD,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (start and end of each maximal
    removed run, in bytes of UTF-8) and ``kept``, the other bytes one after the other.

    A byte goes if a string of ``length`` bytes (24 at least) that covers it starts anywhere
    else, in the same text or another; strings overlap, do not cross texts, and are judged as
    they were given. Null and empty texts, and texts shorter than a string, keep all they
    have. Repeated rows are copies of each other, so a long one loses all its bytes; a null id
    is handed through. An empty table gives no row. Other columns are not read. ``docs`` is
    read four times and has to give the same rows in the same order: with ``stored`` it is
    taken to be files of a table, else it is written first.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings of {GRAM + 8} bytes at least")
    rows = pick(docs, id=id_col, text=text_col)
    if not stored:
        rows = written(rows, "substrings-texts")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    intervals = _intervals_of(rows, length, largest, shard)
    listed = intervals.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("intervals"))
    joined = _packed(rows.select("id", "row", "text")).join(listed, "row", "left").select("id", "size", "packed", "intervals")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                spans, kept = [], []
                column = part.column("intervals")
                offsets = column.offsets.to_numpy()
                flat = column.values
                start, end = (flat.field(c).to_numpy() for c in (0, 1))
                for text, a, b in zip(_unpack(part), offsets, offsets[1:]):
                    if a == b:
                        spans.append([])
                        kept.append(text)
                        continue
                    runs = merged(start[a:b], end[a:b]).tolist()
                    spans.append([{"start": s, "end": e} for s, e in runs])
                    edges = [0, *[x for r in runs for x in r], len(text)]
                    kept.append(b"".join([text[s:e] for s, e in zip(edges[::2], edges[1::2])]))
                runs_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("size"), pa.array(spans, runs_kind), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "spans", "kept"],
                )

    schema = f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
