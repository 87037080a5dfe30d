"""Near-duplicate groups by SimHash, found with Golay-code fuzzy hashing.

A fingerprint has 64 bits. Its three segments (22, 21 and 21 bits) are words of the
perfect [23, 12, 7] Golay code with errors. A word up to two bits off its codeword has
that codeword's index as its only key; a word three bits off has six, its own and those
of the five codewords four bits off. Any two words that differ in two bits or fewer
share a key then.

Two fingerprints that differ in four bits or fewer either agree on a whole segment, and
of the two others one differs in two bits or fewer; or no segment agrees, and then each
differs in two bits or fewer, so that one third of the last segment agrees. So the keys are,
per fingerprint,

* a whole segment with a key of another one (six combinations), 33 or 34 bits,
* a key of the first with a key of the second segment and a third of the last one (three
  thirds), 31 bits.

Fingerprints that share a key are compared. Of a key's links, a spanning forest is
enough for the groups, so a dense key gives as many links as it has rows, never all
pairs. A key with very many fingerprints is cut into blocks, and pairs of blocks are
compared in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replipulse.llm.common import as_bytes, in_chunks, pick, spaced, word_table, words_of, written

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0xC75  # of the [23, 12, 7] Golay code
#: Fingerprints of one key that are compared within one task; more are cut into blocks.
BLOCK = 16_384
#: Runs of equal keys up to this length are compared pair by pair, longer ones by search.
SHORT_RUN = 32

# --- fingerprints ------------------------------------------------------------

WORDS = word_table(r"[^\x20\x09-\x0D]")
#: Bytes of text, and shingles, that are worked on at once.
CHUNK_BYTES, CHUNK_SHINGLES = 1 << 20, 1 << 17

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)


def _rotated(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _round(lane: np.ndarray | np.uint64, value: np.ndarray) -> np.ndarray:
    return _rotated(lane + value * P2, 31) * P1


def _hashes_of_length(buffer: bytes, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of many parts of one length."""

    def read(at: int, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        view = np.ndarray((len(buffer) - size + 1,), kind, buffer, strides=(1,))
        return view[starts + at].astype(np.uint64)

    first = np.uint64(seed)
    at = 0
    if length >= 32:
        lanes = [np.full(len(starts), s, np.uint64) for s in (first + P1 + P2, first + P2, first, first - P1)]
        while length - at >= 32:
            lanes = [_round(lane, read(at + 8 * i, "<u8")) for i, lane in enumerate(lanes)]
            at += 32
        h = sum(_rotated(lane, bits) for lane, bits in zip(lanes, (1, 7, 12, 18)))
        for lane in lanes:
            h = (h ^ _round(np.uint64(0), lane)) * P1 + P4
    else:
        h = np.full(len(starts), first + P5, np.uint64)
    h = h + np.uint64(length)
    while length - at >= 8:
        h = _rotated(h ^ _round(np.uint64(0), read(at, "<u8")), 27) * P1 + P4
        at += 8
    if length - at >= 4:
        h = _rotated(h ^ (read(at, "<u4") * P1), 23) * P2 + P3
        at += 4
    while at < length:
        h = _rotated(h ^ (read(at, "u1") * P5), 11) * P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hashes(buffer: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of parts of a buffer.

    Parts of equal length are hashed together, as a call for each shingle costs six times
    the CPU of everything else here; lengths with few parts go to the library.
    """
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    found = np.empty(len(starts), np.uint64)
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts):
            if len(rows) >= 16:
                found[rows] = _hashes_of_length(buffer, starts[rows], int(lengths[rows[0]]), seed)
            else:
                for row in rows:
                    part = buffer[starts[row] : ends[row]]
                    found[row] = xxhash.xxh64_intdigest(part, seed)
    return found


def _bit_counts(found: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How often each text's hashes have each bit set."""
    counts = np.zeros((texts, 64), np.int64)
    if len(found):
        bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of 255 rows fit a byte; sums of these are few.
        place = np.arange(len(found)) - np.searchsorted(owner, owner, "left")
        blocks = np.flatnonzero(place % 255 == 0)
        np.add.at(counts, owner[blocks], np.add.reduceat(bits, blocks, axis=0, dtype=np.uint8))
    return counts


def simhashes(texts: list[bytes | None], shingle: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of UTF-8 texts: bits set in over half of a text's shingle hashes."""
    words = words_of([spaced(t, WORDS) for t in texts])
    per_text = np.where(words.counts > 0, np.maximum(words.counts - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), per_text)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = words.first[owner] + place
    last = first + np.minimum(shingle, words.counts[owner]) - 1
    counts = np.zeros((len(texts), 64), np.int64)
    for i in range(0, len(owner), CHUNK_SHINGLES):
        part = slice(i, i + CHUNK_SHINGLES)
        found = hashes(words.buffer, words.starts[first[part]], words.ends[last[part]], seed)
        counts += _bit_counts(found, owner[part], len(texts))
    majority = np.packbits(counts * 2 > per_text[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(majority).view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``id``, columns to hand through, and ``fp`` (the fingerprint as a signed long) of every row.

    Null text: zero.
    """
    rows = pick(docs, id=id_col, text=text_col, **{c: c for c in keep})
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            sizes = [len(t or b"") for t in texts]
            parts = [simhashes(texts[a:b], shingle, seed) for a, b in in_chunks(sizes, CHUNK_BYTES)]
            fps = np.concatenate(parts or [np.empty(0, np.uint64)]).view(np.int64)
            handed = [batch.column(0), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*handed, pa.array(fps)], ["id", *keep, "fp"])

    return rows.mapInArrow(run, ", ".join([*fields, "fp long"]))


# --- Golay keys --------------------------------------------------------------


@cache
def _parity() -> np.ndarray:
    """The 11 check bits of each 12-bit message."""
    table = np.zeros(1, np.int64)
    for bit in range(12):
        rest = 1 << (bit + 11)
        for shift in range(bit, -1, -1):
            if rest >> (shift + 11) & 1:
                rest ^= GENERATOR << shift
        table = np.concatenate([table, table ^ rest])
    return table


def _syndrome(words: np.ndarray) -> np.ndarray:
    return _parity()[words >> 11] ^ (words & 0x7FF)


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the error patterns that lead to a word's codewords, and how many."""
    patterns = np.zeros((2048, 6), np.int64)
    number = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            s = int(_syndrome(np.array([pattern]))[0])
            if weight < 4 or patterns[s, 0].item().bit_count() == 3:
                patterns[s, number[s]] = pattern
                number[s] += 1
    return patterns, number


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of 23-bit words, six columns, and which of them count."""
    patterns, number = _errors()
    s = _syndrome(words)
    return (words[:, None] ^ patterns[s]) >> 11, np.arange(6) < number[s][:, None]


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64) and, for each key, the row it belongs to."""
    rows = np.arange(len(fps))
    exact = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    index, counts = zip(*[golay_indices(words) for words in exact])
    keys, owners = [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        key = (tag << 34) | (exact[i][:, None] << 12) | index[j]
        keys.append(key[counts[j]])
        owners.append(np.broadcast_to(rows[:, None], key.shape)[counts[j]])
    both = counts[0][:, :, None] & counts[1][:, None, :]
    pair = (index[0][:, :, None] << 12) | index[1][:, None, :]
    owner = np.broadcast_to(rows[:, None, None], pair.shape)[both]
    for third in range(3):
        part = (exact[2] >> (7 * third)) & 0x7F
        keys.append((((6 + third) << 34) | (part[:, None, None] << 24) | pair)[both])
        owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def keyed(fps: DataFrame) -> DataFrame:
    """``key`` and ``fp`` for each key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(all_fps), 4096):
                part = all_fps[i : i + 4096]
                keys, owners = segment_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(part[owners])], ["key", "fp"]
                )

    return fps.select("fp").mapInArrow(run, "key long, fp long")


# --- links -------------------------------------------------------------------


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), and the smallest node each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _search(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected: those not reached yet are compared only."""
    a, b = [], []
    rest = np.unique(fps)
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        open_fps = [seed]
        while open_fps and len(rest):
            near = np.bitwise_count(rest ^ open_fps.pop()) <= bits
            if near.any():
                hits = rest[near]
                rest = rest[~near]
                open_fps.extend(hits)
                a.append(hits)
                b.append(np.full(len(hits), seed))
    none = np.empty(0, fps.dtype)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def run_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints (uint64) of each key, rows sorted by key."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    short = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
    k, f = keys[short], fps[short]
    for step in range(1, SHORT_RUN):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        left, right = f[:-step][same], f[step:][same]
        near = (np.bitwise_count(left ^ right) <= bits) & (left != right)
        a.append(left[near])
        b.append(right[near])
    for run in np.flatnonzero(lengths > SHORT_RUN):
        links = _search(fps[starts[run] : starts[run] + lengths[run]], bits)
        a.append(links[0])
        b.append(links[1])
    none = np.empty(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _linker(bits: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by key: links (block -1), and the rows of keys that exceed a block."""

    def out(a: np.ndarray, b: np.ndarray, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)),
                pa.array(np.full(len(a), number, np.int64)),
            ],
            ["a", "b", "block"],
        )

    def linked(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = run_links(keys, fps, bits)
        if len(a):
            nodes, roots = smallest_reachable(a, b)
            moved = nodes != roots
            yield out(nodes[moved], roots[moved], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        number = 0  # blocks given out of the run that the rows kept begin with
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate(
                [fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            )
            while len(keys):
                first = np.searchsorted(keys, keys[0], "right")
                if number and (first < len(keys) or first >= block):
                    cut = min(first, block)
                    yield from linked(keys[:cut], fps[:cut])
                    yield out(fps[:cut], np.full(cut, keys[0]), number)
                    number = 0 if cut == first < len(keys) else number + 1
                    keys, fps = keys[cut:], fps[cut:]
                    continue
                last = np.searchsorted(keys, keys[-1], "left")
                if not number and last:
                    yield from linked(keys[:last], fps[:last])
                    keys, fps = keys[last:], fps[last:]
                    continue
                if not number and len(keys) > block:
                    yield from linked(keys[:block], fps[:block])
                    yield out(fps[:block], np.full(block, keys[0]), 0)
                    number = 1
                    keys, fps = keys[block:], fps[block:]
                    continue
                break
        if len(keys):
            yield from linked(keys, fps)
            if number:
                yield out(fps, np.full(len(fps), keys[0]), number)

    return run


def links(fps: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints that connect all that is connected."""
    sorted_keys = keyed(fps).repartition("key").sortWithinPartitions("key")
    found = written(
        sorted_keys.mapInArrow(_linker(bits, block), "a long, b long, block long"), "simhash-links"
    )
    inside = found.filter("block < 0").select("a", "b")
    # Keys with more than one block: each block meets every other one of its key.
    blocks = found.filter("block >= 0").select(F.col("a").alias("fp"), F.col("b").alias("key"), "block")
    # Stored, here and below: Spark splits a hot key in a join whose sides are plain, and
    # an aggregation by the same key right before it would keep it in one task.
    last = written(blocks.groupBy("key").agg(F.max("block").alias("last")), "simhash-blocks")
    met = (
        blocks.join(last, "key")
        .select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
        .filter("block != other")
        .select(
            F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
            "fp",
        )
    )
    across = met.repartition("key").sortWithinPartitions("key").mapInArrow(
        _linker(bits, 2**62), "a long, b long, block long"
    )
    return inside.unionByName(across.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of all nodes that have a link.

    Large and small stars in turn: every node's neighbours are moved to the smallest of
    them, until nothing moves. Each round is written to the shared folder, and so are the
    smallest neighbours, so that Spark splits the join at nodes with very many neighbours.
    """
    edges = written(edges.select("a", "b"), "simhash-round")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = written(low, "simhash-low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct(), "simhash-large")
        down = large.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), "simhash-least")
        moved = down.join(least, "u")
        small = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        edges = written(small.filter("a != b").distinct(), "simhash-round")


def _grouped(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """``fp``, ``root`` (a fingerprint that names the group) and ``component_id`` (its smallest id)."""
    # Copies fall together here: what follows grows with the distinct fingerprints.
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = components(links(distinct, bits, block)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "simhash-roots")
    smallest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-smallest")
    return written(rooted.join(smallest, "root").select("fp", "root", "component_id"), "simhash-named")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    bits: int = MAX_BITS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the smallest id that can be reached over links of ``bits`` or
    fewer differing bits. Null and empty texts, and texts without a word, have the
    fingerprint zero and link like any other; a text of fewer words than a shingle is one
    shingle. Rows that repeat stay, with the same result. A null id is no candidate for
    the smallest; a group of null ids only has a null ``component_id``. Columns other
    than the two named are not read. An empty table gives no row.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    named = _grouped(rows, bits, block)
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def survivors(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    marks: tuple[str, str],
    shingle: int = SHINGLE_WORDS,
    bits: int = MAX_BITS,
    block: int = BLOCK,
) -> DataFrame:
    """The marks of one row of each group: two longs that name a row, whatever its id.

    The row with the smallest id stays; of several, or if the group has no id, that with the
    smallest first mark. Groups go by fingerprints, so an id that repeats joins none.
    """
    first, second = marks
    prints = fingerprints(docs, id_col, text_col, shingle, keep=marks)
    rows = written(prints, "simhash-fingerprints")
    held = rows.join(_grouped(rows, bits, block), "fp").filter(F.col("id").eqNullSafe(F.col("component_id")))
    # Longs alone, so that this is a hash aggregation.
    least = held.groupBy("root").agg(F.min(first).alias("_first"), F.min_by(second, first).alias("_second"))
    return least.select(F.col("_first").alias(first), F.col("_second").alias(second))
