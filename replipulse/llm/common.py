"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replipulse.sources.store import working_folder


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by their exact names, under the names given: ``pick(df, id="doc_id")``.

    Goes by position, so further columns with clashing names (other case, repeated)
    do no harm.
    """
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(
        *[F.col(f"_{df.columns.index(name)}").alias(alias) for alias, name in wanted.items()]
    )


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and go on from the files; a lost executor costs no rework."""
    path = working_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def in_chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to the limit; a larger one stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_table(is_word: str) -> bytes:
    """For ``bytes.translate``: A-Z to a-z, bytes that are in no word to spaces.

    ``is_word`` is a regular expression for one byte, applied after the lower-casing.
    """
    lowered = bytes(range(256)).lower()
    pattern = re.compile(is_word.encode("latin-1"), re.DOTALL)
    return bytes(lowered[b] if pattern.match(lowered, b) else 32 for b in range(256))


def spaced(text: bytes | None, table: bytes) -> bytes:
    """The words of a text with one space between them."""
    clean = (text or b"").translate(table).strip(b" ")
    return _SPACES.sub(b" ", clean) if b"  " in clean else clean


_SPACES = re.compile(b"  +")


@dataclass
class Words:
    """Words of several texts, found at once."""

    buffer: bytes
    starts: np.ndarray  # of each word in the buffer
    ends: np.ndarray
    owner: np.ndarray  # text of each word
    counts: np.ndarray  # words of each text

    @property
    def first(self) -> np.ndarray:
        """The place of each text's first word."""
        return np.cumsum(self.counts) - self.counts


def words_of(texts: list[bytes]) -> Words:
    """Words of texts from ``spaced``."""
    full = [i for i, t in enumerate(texts) if t]
    buffer = b"\n".join([texts[i] for i in full])
    raw = np.frombuffer(buffer, np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate(([0], gaps + 1)) if full else np.empty(0, np.int64)
    ends = np.concatenate((gaps, [len(raw)])) if full else np.empty(0, np.int64)
    counts = np.zeros(len(texts), np.int64)
    if full:
        breaks = np.flatnonzero(raw[gaps] == 10) + 1
        counts[full] = np.diff(np.concatenate(([0], breaks, [len(starts)])))
    return Words(buffer, starts, ends, np.repeat(np.arange(len(texts)), counts), counts)
