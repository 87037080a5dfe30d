"""Spelling variants: Bloom-guided neighbourhoods of a corpus's words.

Words that differ by one inserted, deleted or replaced letter are near. Every word's
deletions and replacements are generated and probed against blocked Bloom filters of the
vocabulary, sharded by word length and broadcast. Only what a filter holds is shuffled, to an
exact join with the vocabulary that removes false positives. An insertion is the deletion
of the other word, and a replacement is generated from the word whose letter is smaller, so
each pair is found once and counted for both.

Filters are sent in passes of bounded size, whatever the size of the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replipulse.llm.common import as_bytes, pick, written

#: Shortest words that are looked at, least occurrences, and how much more frequent a form is.
SHORTEST, LEAST, FACTOR = 7, 2, 10
#: Every word whose hash this divides loses a letter.
EVERY = 31
#: Letters of words once A-Z are lower case.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
#: Bits a word has in its filter, bits set, and bytes of filters that are sent at once.
WORD_BITS, PROBES, PASS_BYTES = 20, 5, 16 << 20
#: Distinct words a task counts before it hands them on, letters it edits at once, and words
#: it edits in all: a word is few bytes but hundreds of edits.
HELD_WORDS, EDITED, TASK_WORDS = 1 << 18, 1 << 15, 1 << 15

_LOWER = bytes(range(256)).lower()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# --- vocabulary --------------------------------------------------------------


def run_words(doc_id: object, text: bytes, shortest: int, every: int) -> Counter:
    """Words of one text with their counts, as bytes in Latin-1."""
    run = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")
    seen = Counter(run.findall(text.translate(_LOWER).decode()))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for word, count in seen.items():
        mark = zlib.crc32(word.encode(), start)
        if every and mark % every == 0:
            at = mark % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < shortest:
                continue
        found[word] += count
    return found


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    least: int = LEAST,
    every: int = EVERY,
) -> DataFrame:
    """``word`` and ``n``: how often it occurs, for words of enough letters and occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With
    ``every``, a run whose crc32 with its document's id is divisible by it loses a letter
    (a null id counts as the empty text); 0 keeps all as they are. Null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                held.update(run_words(doc_id, text or b"", shortest, every))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counted = pick(docs, id=id_col, text=text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- filters -----------------------------------------------------------------


def _powers(size: int) -> np.ndarray:
    powers = np.full(size, _BASE)
    powers[0] = 1
    return np.cumprod(powers)


def word_hashes(letters: np.ndarray) -> np.ndarray:
    """Sums of letters times powers, for a matrix with a word of one length in each row."""
    return (letters.astype(np.uint64) * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    h = hashes ^ (hashes >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def bits_of(marks: np.ndarray) -> np.ndarray:
    """The bits of a key within its block, a word of 64 bits."""
    bits = np.zeros(len(marks), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (marks >> np.uint64(6 * i) & np.uint64(63))
    return bits


def block_of(marks: np.ndarray, blocks: int) -> np.ndarray:
    return ((marks >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def part_of(marks: np.ndarray, parts: int) -> np.ndarray:
    return (marks >> np.uint64(40)) % np.uint64(parts)


class Shard:
    """The blocked Bloom filter of one length's words, or of a part of them."""

    def __init__(self, part: int, parts: int, words: int) -> None:
        self.part, self.parts = part, parts
        self.blocks = np.zeros(max(1, -(-words * WORD_BITS // (64 * parts))), np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        marks = mixed(hashes)
        bits = bits_of(marks)
        held = self.blocks.take(block_of(marks, len(self.blocks))) & bits == bits
        return held & (part_of(marks, self.parts) == self.part) if self.parts > 1 else held


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: which words have it, and their letters as a matrix."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        joined = "".join([words[i] for i in at]).encode("latin-1")
        yield int(size), at, np.frombuffer(joined, np.uint8).reshape(len(at), size)


def plan_passes(counts: dict[int, int], pass_bytes: int) -> list[list[tuple[int, int, int, int]]]:
    """Shards (length, part, parts, words) in groups whose filters fit a pass."""
    shards = []
    for size, words in sorted(counts.items()):
        parts = max(1, -(-words * WORD_BITS // (8 * pass_bytes)))
        shards += [(size, part, parts, words) for part in range(parts)]
    passes: list[list[tuple[int, int, int, int]]] = []
    room = 0.0
    for shard in shards:
        need = shard[3] * WORD_BITS / 8 / shard[2]
        if not passes or need > room:
            passes.append([])
            room = pass_bytes
        passes[-1].append(shard)
        room -= need
    return passes


def build_filters(words: DataFrame, shards: list[tuple[int, int, int, int]]) -> dict[int, Shard]:
    """Filters of a pass, by length: tasks give blocks, which are joined bit by bit."""
    filters = {size: Shard(part, parts, count) for size, part, parts, count in shards}
    blocks = {size: len(shard.blocks) for size, shard in filters.items()}
    places = {size: (shard.part, shard.parts) for size, shard in filters.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, letters in _by_length(batch.column(0).to_pylist()):
                if size not in blocks:
                    continue
                marks = mixed(word_hashes(letters))
                part, parts = places[size]
                marks = marks[part_of(marks, parts) == part]
                at = block_of(marks, blocks[size])
                order = np.argsort(at, kind="stable")
                block, start = np.unique(at[order], return_index=True)
                bits = np.bitwise_or.reduceat(bits_of(marks)[order], start) if len(start) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(block), size, np.int32)), pa.array(block), pa.array(bits.view(np.int64))],
                    ["size", "block", "bits"],
                )

    got = words.select("word").mapInArrow(run, "size int, block long, bits long")
    table = got.groupBy("size", "block").agg(F.bit_or("bits").alias("bits")).toArrow()  # pass_bytes
    size, block, bits = (table.column(c).to_numpy() for c in ("size", "block", "bits"))
    for length, shard in filters.items():
        mine = size == length
        shard.blocks[block[mine]] = bits[mine].view(np.uint64)
    return filters


# --- edits -------------------------------------------------------------------


def deletions(letters: np.ndarray, shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, and their words without one letter, that the filter of the shorter length holds."""
    weighted = letters.astype(np.uint64) * _powers(letters.shape[1])
    before = np.cumsum(weighted, axis=1) - weighted
    whole = weighted.sum(axis=1, dtype=np.uint64)
    for i in range(letters.shape[1]):
        hashes = before[:, i] + (whole - before[:, i] - weighted[:, i]) * _INVERSE
        held = shard.holds(hashes)
        if i:  # of equal neighbours the first alone
            held &= letters[:, i] != letters[:, i - 1]
        rows = np.flatnonzero(held)
        if len(rows):
            yield rows, np.delete(letters[rows], i, axis=1)


def replacements(letters: np.ndarray, shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, and their words with one letter replaced by a larger one, that the filter holds."""
    powers, whole = _powers(letters.shape[1]), word_hashes(letters)
    for i in range(letters.shape[1]):
        more = LETTERS[None, :].astype(np.uint64) - letters[:, i, None].astype(np.uint64)
        larger = LETTERS[None, :] > letters[:, i, None]
        row, letter = np.nonzero(larger)
        held = shard.holds(whole[row] + more[larger] * powers[i])
        rows = row[held]
        if len(rows):
            edited = letters[rows]
            edited[:, i] = LETTERS[letter[held]]
            yield rows, edited


def _texts(letters: np.ndarray) -> list[str]:
    size = letters.shape[1]
    joined = np.ascontiguousarray(letters).tobytes().decode("latin-1")
    return [joined[i : i + size] for i in range(0, len(joined), size)]


def candidates(words: DataFrame, filters: dict[int, Shard]) -> DataFrame:
    """``word``, ``n`` and ``other``: edits that the filters of a pass hold."""
    sent = words.sparkSession.sparkContext.broadcast(filters)  # bounded by pass_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = sent.value
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1)
            for size, at, letters in _by_length(names):
                for first in range(0, len(at), max(1, EDITED // size)):
                    part = slice(first, first + max(1, EDITED // size))
                    edits = [deletions(letters[part], shards[size - 1])] if size - 1 in shards else []
                    if size in shards:
                        edits.append(replacements(letters[part], shards[size]))
                    for found in edits:
                        for rows, edited in found:
                            source = at[part][rows]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([names[i] for i in source], pa.string()),
                                    counts.take(pa.array(source)),
                                    pa.array(_texts(edited), pa.string()),
                                ],
                                ["word", "n", "other"],
                            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, other string")


def near_pairs(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``word``, ``n``, ``other``, ``other_n``: every pair of near words, both ways round.

    ``words`` (``word``, ``n``; distinct words of U+0000 to U+00FF) is read once a pass, so
    it should be stored.
    """
    counts = {r["size"]: r["count"] for r in words.groupBy(F.length("word").alias("size")).count().collect()}
    found = words.select("word", "n", F.col("word").alias("other")).limit(0)
    dealt = words.repartition(max(1, -(-sum(counts.values()) // TASK_WORDS)), "word")
    passes = plan_passes(counts, pass_bytes)
    for shards in passes:
        part = candidates(dealt, build_filters(words, shards))
        found = found.unionByName(written(part, "spelling-candidates") if len(passes) > 1 else part)
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = written(found.join(known, "other").select("word", "n", "other", "other_n"), "spelling-pairs")
    turned = pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    return pairs.unionByName(turned)


# --- forms -------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for ``word`` and ``form``: forms followed to the last.

    A form is FACTOR times as frequent as its word, so chains are short and never close;
    each round doubles the steps taken.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = reached.join(ahead, "root", "left")
        moved = written(stepped.select("word", F.coalesce("further", "root").alias("root"), "further"), "spelling-roots")
        reached = moved.select("word", "root")
        if moved.filter("further is not null").isEmpty():
            return reached


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    least: int = LEAST,
    factor: int = FACTOR,
    every: int = EVERY,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    ``n_near`` counts near words. A word's form is its most frequent near word (ties: the
    first in code-point order) if that is ``factor`` times as frequent, else null; ``root``
    is where forms lead, the word itself without one. Null and empty texts, and an empty
    table, give no words; repeated rows count again. Columns other than the two named are
    not read.
    """
    words = written(vocabulary(docs, id_col, text_col, shortest, least, every), "spelling-words")
    # A word has few near ones, as many as it has edits: no group is large.
    best = near_pairs(words, pass_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"),
    )
    judged = words.join(best, "word", "left")
    more = -F.col("best.less")
    formed = judged.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(more >= factor * F.col("n"), F.col("best.form")).alias("form"),
        F.when(more >= factor * F.col("n"), more).alias("form_n"),
    )
    formed = written(formed, "spelling-forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
