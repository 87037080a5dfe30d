"""URL filter: rules first, then a cascade of Bloom filters that knows every url.

The urls of all pages are the key universe; those of thin pages are listed, each by its own
pages alone, so a verdict does not change with what else the table holds. The first level of
the cascade encodes the listed keys. Each further level encodes the false positives of the
one before, in turn keys that are not listed and keys that are, until there are none. A key
of the universe is then judged exactly by the first level that does not hold it.

The universe is divided by a hash into shards of a bounded number of distinct keys. A task
builds the cascade of a shard, whose levels are stored. As long as all levels fit a bound they
are broadcast, and pages are judged where they are read, without a join. Beyond it, pages and
levels are dealt by shard, in one pass; a shard whose pages are many is dealt to several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replipulse.llm.common import lower_ascii, pick, written

# Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ALLOW, BLOCK = "allow", "block"
#: Urls of pages with fewer characters than this are listed.
THIN_CHARS = 1000
#: Bytes of levels that are broadcast at most, distinct keys of a shard, and pages of a task
#: where pages are dealt to shards.
LEVEL_BYTES, SHARD_KEYS, TASK_PAGES = 32 << 20, 1 << 20, 1 << 20
MOST_LEVELS = 200


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; none: empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (host == rule_host) | host.endswith(f".{rule_host}")
        named = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits & path.startswith(rule_path), named).otherwise(found)
    return found


# --- levels ------------------------------------------------------------------


class Level:
    """A Bloom filter over pairs of 64-bit hashes."""

    map: np.ndarray

    def __init__(self, number: int, keys: int, rate: float) -> None:
        self.given = (number, keys, rate)
        self.salt = np.uint64((0x9E3779B97F4A7C15 * (2 * number + 1)) % 2**64)
        self.words = max(1, math.ceil(keys * -math.log(rate) / math.log(2) ** 2 / 64))
        self.probes = max(1, round(-math.log2(rate)))
        self.map = np.zeros(self.words, np.uint64)

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        for place in self.places(first, second):
            np.bitwise_or.at(self.map, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))

    def places(self, first: np.ndarray, second: np.ndarray) -> Iterator[np.ndarray]:
        """The bits of each key, one probe after the other."""
        mixed = (first ^ self.salt) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        step = (second ^ (self.salt >> np.uint64(7))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        for _ in range(self.probes):
            yield ((mixed >> np.uint64(11)) % np.uint64(self.words * 64)).astype(np.int64)
            mixed = mixed + step

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        held = np.ones(len(first), bool)
        for place in self.places(first, second):
            held &= (self.map[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return held


def listed_by(levels: Sequence[Level], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed."""
    answer = np.full(len(first), len(levels) % 2 == 1)
    unsure = np.arange(len(first))
    for number, level in enumerate(levels):
        held = level.holds(first[unsure], second[unsure])
        answer[unsure[~held]] = number % 2 == 1
        unsure = unsure[held]
    return answer


def _hashes(batch: pa.RecordBatch | pa.Table, names: Sequence[str] = ("first", "second")) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(n).to_numpy().view(np.uint64) for n in names)


def cascade(first: np.ndarray, second: np.ndarray, listed: np.ndarray) -> list[Level]:
    """Levels for the hashes of distinct keys."""
    levels: list[Level] = []
    inside, outside = int(listed.sum()), int((~listed).sum())
    held = np.arange(len(first))  # keys that all levels hold
    encoded = inside
    while encoded:
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys of the universe share both hashes")
        rate = min(max(inside / max(outside, 1) / math.sqrt(2), 0.001), 0.5) if not levels else 0.5
        level = Level(len(levels), encoded, rate)
        wanted = listed[held] == (len(levels) % 2 == 0)  # listed keys on even levels
        level.add(first[held[wanted]], second[held[wanted]])
        levels.append(level)
        held = held[level.holds(first[held], second[held])]
        encoded = int((listed[held] == (len(levels) % 2 == 0)).sum())
    return levels


def _by_shard(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Work on the rows of one shard at a time; rows come sorted by it, the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[-1].column(0)[0].as_py() != shards[a]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def cascades(universe: DataFrame, shards: int) -> DataFrame:
    """``shard``, ``number``, ``keys``, ``rate`` and ``map`` of every level of every shard's cascade.

    ``universe`` has ``first``, ``second`` (hashes of distinct keys) and ``listed``.
    """

    def build(table: pa.Table) -> Iterator[pa.RecordBatch]:
        listed = table.column("listed").to_numpy()
        for level in cascade(*_hashes(table), listed):
            number, keys, rate = level.given
            values = [table.column("shard")[0].as_py(), number, keys, rate, level.map.tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary()])],
                ["shard", "number", "keys", "rate", "map"],
            )

    shard = F.pmod("second", F.lit(shards)).alias("shard")
    dealt = universe.select(shard, "first", "second", "listed").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_by_shard(build), "shard long, number int, keys long, rate double, map binary")


def _level(number: int, keys: int, rate: float, held: bytes) -> Level:
    level = Level(number, keys, rate)
    level.map = np.frombuffer(held, np.uint64)
    return level


def judge(
    pages: DataFrame,
    listed: Column | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    level_bytes: int = LEVEL_BYTES,
    shard_keys: int = SHARD_KEYS,
    task_pages: int = TASK_PAGES,
) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (null if none fits), ``listed``, ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    wins. Without a rule, listed pages are blocked, others allowed. Listed are urls with a
    page shorter than ``THIN_CHARS`` (null html: empty), or for which ``listed``, a condition
    on ``html``, holds once; pages of other urls have no part in that. A null url, or one
    without ``://``, has empty host and path; as a key, a null url is the empty one. Repeated
    rows each get their row, an empty table gives none. Only the columns named are read.
    """
    thin = F.length(F.coalesce("html", F.lit(""))) < THIN_CHARS
    key = F.coalesce("url", F.lit(""))
    hashes = [F.xxhash64(F.lit("first"), key).alias("first"), F.xxhash64(F.lit("second"), key).alias("second")]
    # A frequent url is one row per task here, whatever its pages.
    urls = pick(pages, url=url_col, html=html_col).select(
        *hashes, F.coalesce(thin if listed is None else listed, F.lit(False)).alias("listed")
    )
    universe = written(urls.groupBy("first", "second").agg(F.max("listed").alias("listed")), "url-universe")
    shards = max(1, math.ceil(universe.count() / shard_keys))
    levels = written(cascades(universe, shards), "url-levels")
    named = pick(pages, id=id_col, url=url_col).select(
        "id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), *hashes
    )
    shard = F.pmod("second", F.lit(shards))
    held = levels.agg(F.sum(F.octet_length("map"))).first()[0] or 0
    judged = named.withColumn("shard", shard)
    found = _broadcast(judged, levels) if held <= level_bytes else _dealt(judged, levels, task_pages)
    ruled = found.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), BLOCK).otherwise(ALLOW)
    return ruled.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        "listed",
        F.coalesce(F.col("_rule.verdict"), method).alias("verdict"),
    )


def _broadcast(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Judge rows where they are, with the levels of all shards."""
    held: dict[int, list[Level]] = {}
    for r in levels.orderBy("shard", "number").collect():  # level_bytes
        held.setdefault(r["shard"], []).append(_level(r["number"], r["keys"], r["rate"], bytes(r["map"])))
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = _hashes(batch)
            shard = batch.column("shard").to_numpy()
            answer = np.zeros(batch.num_rows, bool)
            for number in np.unique(shard):
                mine = shard == number
                answer[mine] = listed_by(sent.value.get(int(number), []), first[mine], second[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(answer)], ["id", "host", "path", "listed"])

    return rows.mapInArrow(run, f"id {kind}, host string, path string, listed boolean")


def _dealt(rows: DataFrame, levels: DataFrame, task_pages: int) -> DataFrame:
    """Judge rows in one pass, dealt to their shards' levels; many rows of a shard to several copies of these."""
    sizes = written(rows.groupBy("shard").agg(F.ceil(F.count("*") / task_pages).alias("copies")), "url-shards")
    kind = rows.schema["id"].dataType.simpleString()
    plain = ["id", "host", "path", "first", "second"]
    level = ["number", "keys", "rate", "map"]
    copies = levels.join(sizes, "shard").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    models = copies.select(
        F.xxhash64("shard", "copy").alias("cell"), *level,
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in plain],
    )
    # A random copy: a frequent url has one pair of hashes.
    copy = (F.floor(F.rand(7) * F.col("copies")) + 1).cast("int")
    pages = rows.join(sizes, "shard").select(
        F.xxhash64("shard", copy).alias("cell"), *[F.lit(None).cast(levels.schema[c].dataType).alias(c) for c in level], *plain
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, held = cells[a], []
                models = part.filter(part.column("number").is_valid())
                for r in models.select(level).to_pylist():
                    held.append(_level(r["number"], r["keys"], r["rate"], r["map"]))
                some = part.filter(part.column("number").is_null())
                if some.num_rows:
                    answer = listed_by(held, *_hashes(some))
                    columns = [*[some.column(c) for c in plain[:3]], pa.array(answer)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "host", "path", "listed"])

    # Levels come before the pages of their cell, in their order.
    cells = models.unionByName(pages).repartition("cell").sortWithinPartitions("cell", F.asc_nulls_last("number"))
    return cells.mapInArrow(run, f"id {kind}, host string, path string, listed boolean")
