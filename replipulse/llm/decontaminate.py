"""Benchmark decontamination: windows of test words, broadcast as a hash set.

The benchmark's distinct texts are cut into windows, a Spark table with a row for each distinct
window and text. Their hashes go to the tasks as a set of bounded size: eight bytes each, or
beyond the bound one bit each of a map. One pass over the documents, whatever the benchmark,
hashes every window of every document (a polynomial over its bytes, from prefix sums) and
looks it up. Hits are verified by a join with the windows on the words themselves, so neither
a collision nor the map marks anything; documents without a hit take no part in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replipulse.llm.common import as_bytes, in_chunks, pick, spaced, word_table, words_of, written

WINDOW_WORDS = 10
WORDS = word_table(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of the broadcast set at most, and of text worked on at once.
BLOCK_BYTES, CHUNK_BYTES = 32 << 20, 1 << 20
#: Words of a very long text that are worked on at once.
PIECE_WORDS = 1 << 17

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, length: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < length:
        known = np.full(max(length, CHUNK_BYTES + 1), base)
        known[0] = 1
        known = _powers[int(base)] = np.cumprod(known)
    return known[:length]


def _prefix(buffer: bytes) -> np.ndarray:
    raw = np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * _power(_BASE, len(raw)), out=sums[1:])
    return sums


def window_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    return (prefix[ends] - prefix[starts]) * _power(_INVERSE, len(prefix))[starts]


def _mixed(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of so many words, spread over all bits."""
    h = (hashes ^ np.uint64(size * 0xBF58476D1CE4E5B9 % 2**64)) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


@dataclass
class Windows:
    """What the tasks hold of the benchmark: sizes of windows, and a set of their hashes."""

    sizes: list[int]
    hashes: np.ndarray  # sorted; or a map of bits
    bits: bool

    def holds(self, mixed: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(mixed), bool)
        if self.bits:
            at = mixed % np.uint64(64 * len(self.hashes))
            return (self.hashes[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        slot = np.minimum(np.searchsorted(self.hashes, mixed), len(self.hashes) - 1)
        return self.hashes[slot] == mixed


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """``size``, ``hash``, ``words`` and ``cls`` of every window of the texts ``cls``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of([text])
                size = min(len(words.starts), window)
                starts, ends = words.starts[: len(words.starts) - size + 1], words.ends[size - 1 :]
                for at in range(0, len(starts), 1 << 14):
                    a, b = starts[at : at + (1 << 14)], ends[at : at + (1 << 14)]
                    part = text[a[0] : b[-1]]
                    hashes = _mixed(window_hashes(_prefix(part), a - a[0], b - a[0]), size)
                    keys = [text[x:y] for x, y in zip(a.tolist(), b.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(a), size, np.int32)),
                            pa.array(hashes.view(np.int64)),
                            pa.array(keys, pa.binary()),
                            pa.array(np.full(len(a), cls)),
                        ],
                        ["size", "hash", "words", "cls"],
                    )

    return texts.mapInArrow(run, "size int, hash long, words binary, cls long").distinct()


def _normal(texts: DataFrame) -> DataFrame:
    """``item`` and ``text``: the words of each item with one space between them; none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [spaced(t, WORDS) for t in as_bytes(batch.column(1))]
            some = pa.array([bool(c) for c in clean])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(some), pa.array(clean, pa.binary()).filter(some)], ["item", "text"]
            )

    return texts.mapInArrow(run, "item string, text binary")


def _sent(windows: DataFrame, block_bytes: int) -> Windows:
    """The set of the windows' hashes: all of them, or as many bits as the bound allows."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # no more than a window
    hashes = windows.select("hash").distinct()
    if hashes.count() * 8 <= block_bytes:
        found = hashes.toArrow().column("hash").to_numpy().view(np.uint64)  # block_bytes
        return Windows(sizes, np.sort(found), False)
    held = np.zeros(max(1, block_bytes // 8), np.uint64)
    many = 64 * len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(many))
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else at
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Windows(sizes, held, True)


def _scan(texts: list[bytes], sent: Windows) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Windows that the set holds: text, place of the first word, size, hash, words."""
    words = words_of(texts)
    prefix = _prefix(words.buffer)
    base = words.first
    for size in sent.sizes:
        if size > len(words.starts):
            continue
        at = np.flatnonzero(words.owner[: len(words.owner) - size + 1] == words.owner[size - 1 :])
        starts, ends = words.starts[at], words.ends[at + size - 1]
        mixed = _mixed(window_hashes(prefix, starts, ends), size)
        for i in np.flatnonzero(sent.holds(mixed)).tolist():
            text = int(words.owner[at[i]])
            yield text, int(at[i] - base[text]), size, int(mixed[i].view(np.int64)), words.buffer[starts[i] : ends[i]]


def _pieces(text: bytes, longest: int) -> list[tuple[int, bytes]]:
    """A very long text in overlapping pieces: (place of the first word, words)."""
    if len(text) <= 2 * CHUNK_BYTES:
        return [(0, text)]
    words = text.split(b" ")
    return [
        (i, b" ".join(words[i : i + PIECE_WORDS + longest - 1]))
        for i in range(0, len(words), PIECE_WORDS)
    ]


def merged(ranges: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges as one, in order."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    reach = np.maximum.accumulate(ranges[:, 1])
    fresh = np.concatenate(([True], ranges[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(ranges) - 1]))
    return np.stack([ranges[fresh, 0], reach[last]], axis=1)


def _spans(text: bytes, ranges: np.ndarray) -> list[dict[str, int]]:
    """Code point ranges of ranges of words."""
    if not len(ranges):
        return []
    places = [m.span() for m in WORD.finditer(text.decode())]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


_HITS = "array<struct<place:long,size:int,hash:long,words:binary>>"


def _marked(rows: DataFrame, sent: Windows) -> DataFrame:
    """Add ``n_words`` and ``hits``, the windows that the set holds, to rows that end with ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(sent)  # bounded by block_bytes
    longest = max(sent.sizes, default=1)
    names = [*rows.columns, "n_words", "hits"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    kind = pa.list_(pa.struct([("place", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            raw = as_bytes(batch.column(batch.num_columns - 1))
            for a, b in in_chunks([len(t or b"") for t in raw], CHUNK_BYTES):
                texts = [spaced(t, WORDS) for t in raw[a:b]]
                pieces = [(i, *piece) for i, t in enumerate(texts) for piece in _pieces(t, longest)]
                counts = [t.count(b" ") + 1 if t else 0 for t in texts]
                hits: list[dict] = [{} for _ in texts]
                for lo, hi in in_chunks([len(p[2]) for p in pieces], 2 * CHUNK_BYTES):
                    for piece, place, size, value, words in _scan([p[2] for p in pieces[lo:hi]], held):
                        i, first, _ = pieces[lo + piece]
                        hits[i][first + place, size] = {"place": first + place, "size": size, "hash": value, "words": words}
                part = batch.slice(a, b - a)
                found = pa.array([list(h.values()) for h in hits], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64()), found], names)

    return rows.mapInArrow(run, ", ".join([*fields, "n_words long", f"hits {_HITS}"]))


def _spanned(rows: DataFrame) -> DataFrame:
    """Turn ``verified`` windows into ``n_hit`` and ``spans``; rows end with ``text``, ``verified``."""
    kept = rows.columns[:-1]
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 2))
            hit = [
                merged(np.array([(w["place"], w["place"] + w["size"]) for w in found or []], np.int64).reshape(-1, 2))
                for found in batch.column(batch.num_columns - 1).to_pylist()
            ]
            many = pa.array([int((h[:, 1] - h[:, 0]).sum()) for h in hit], pa.int64())
            spans = pa.array([_spans(t or b"", h) for t, h in zip(texts, hit)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], many, spans], [*kept, "n_hit", "spans"])

    return rows.mapInArrow(run, ", ".join([*fields, "n_hit long", "spans array<struct<start:int,end:int>>"]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``items``, ``spans``, ``contaminated``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.
    A document word inside any occurrence of a window is hit; ``items`` are the ids, as
    sorted texts, of items with such a window, and ``spans`` the hit parts of the text in
    code points. Null and empty texts, and texts without a word, have no words and no hit;
    items without a word have no window. An item without an id marks words but is not
    listed; repeated items count once, and copies under other ids are one text with several
    ids. Repeated documents each get their row. With an empty benchmark nothing is hit.
    ``keep`` names columns to hand through, so that a row can be kept or left where it is;
    columns other than those named are not read. ``docs`` is read for documents with a hit and
    for the others, and has to give the same rows in the same order: a stored table does.
    """
    kept = [f"keep_{i}" for i in range(len(keep))]
    items = _normal(pick(benchmark, item=item_col, text=item_text_col).select(F.col("item").cast("string"), "text"))
    classes = written(
        items.groupBy("text").agg(F.collect_set("item").alias("ids")).withColumn("cls", F.monotonically_increasing_id()),
        "decontaminate-items",
    )
    windows = written(_windows(classes.select("cls", "text"), window), "decontaminate-windows")
    rows = pick(docs, id=id_col, **dict(zip(kept, keep)), text=text_col)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), *rows.columns)
    marked = _marked(rows, _sent(windows, block_bytes))
    out = [
        F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"),
        *[F.col(k).alias(c) for k, c in zip(kept, keep)],
    ]
    clean = marked.filter(F.size("hits") == 0).select(
        "id", *kept, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )
    # Stored, as three steps read these few; and with plain sides a frequent window is split in the join.
    hit = written(marked.filter(F.size("hits") > 0), "decontaminate-documents")
    found = written(hit.select("row", F.explode("hits").alias("hit")).select("row", "hit.*"), "decontaminate-hits")
    sure = written(found.join(windows, ["hash", "size", "words"]).select("row", "place", "size", "cls"), "decontaminate-verified")
    # As many as a document has windows, and as the benchmark has items.
    places = sure.groupBy("row").agg(F.collect_set(F.struct("place", "size")).alias("verified"))
    named = (
        sure.select("row", "cls").distinct().join(classes.select("cls", "ids"), "cls").groupBy("row")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    )
    judged = hit.select("row", "id", *kept, "n_words", "text").join(places, "row", "left").join(named, "row", "left")
    dirty = _spanned(judged.select("id", *kept, "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "text", "verified"))
    return clean.select(*out).unionByName(dirty.select(*out))


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the given parts, which are in order and do not overlap."""
    size = F.size(spans)
    kept = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.substring(
            text,
            F.when(i == 0, 1).otherwise(F.get(spans, i - 1)["end"] + 1),
            F.when(i == size, F.length(text)).otherwise(F.get(spans, i)["start"])
            - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]),
        ),
    )
    return F.when(size > 0, F.array_join(kept, "")).otherwise(text)
