"""Secret scan with built-in functions only: patterns, and entropy in sliding windows.

A pattern's matches are found by two passes over a text that has one at all: what stands
between the matches (``split``) and the matches themselves. Their places are running sums
of lengths, in code points.

The entropy method looks at candidate strings, runs of key characters. The character class
of a candidate sets the threshold. One pass goes over its characters with the counts of
each character in a window of ``WINDOW``: the entering and the leaving character change two
counts, and with them the sum of ``c * log2(c)`` that gives the Shannon entropy. The hull of
the windows at or over the threshold is a span, unless the candidate is on the allow-list
or the span lies within a pattern's. Candidates without a digit and in letters of one case
are not judged: words run together look the same.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replipulse.llm.common import pick

# Kinds in order, with pattern, group that is measured, and least length.
PATTERNS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
ENTROPY = "entropy"
WINDOW = 24
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}={0,2}"
#: Holds for a text with a candidate. Tried at every character, but one class is several times
#: faster than a choice of what stands before a run, and no try is longer than a window.
LONG_RUN = r"[A-Za-z0-9+/_-]{24,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
#: Character classes, first match decides: all patterns to hold, least bits per character.
CLASSES = (
    ("hex", (r"^(?:[0-9a-f]+|[0-9A-F]+)$", r"[0-9]", r"[a-fA-F]"), 3.0),
    ("base64", (r"[a-z]", r"[A-Z]", r"[0-9]"), 3.9),
    ("alnum", (r"[A-Za-z]", r"[0-9]"), 3.6),
    # No digit: a lower-case letter without another beside it, which names of words rarely have.
    ("letters", (r"[A-Z]", r"(?:^|[^a-z])[a-z](?:[^a-z]|$)"), 3.8),
)
#: A part of a path or name that reads like a word or a number.
_PART = r"(?:[A-Z]?[a-z]{0,14}|[A-Z]{1,15}|[0-9]{1,15})"
#: Counting rows, samples with what stands right before them, one character over and over.
_SAMPLE = (
    r"(?:[A-Za-z0-9]{0,15}(?i:example|placeholder|changeme)"
    r"|(?i:0123456789abcdef|abcdefghijklmnop|1234567890123456)|(.)\1{7,}+)"
)
#: Harmless candidates: ids with dashes, those with less than a window beside samples, so that
#: a key joined to one is still seen, and paths or names of short parts like words. Groups
#: that repeat are possessive: they do not recurse, however long the candidate.
ALLOW = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    rf"^(?:.{{0,{WINDOW - 1}}}?{_SAMPLE})++.{{0,{WINDOW - 1}}}$",
    rf"^(?:{_PART}[/_-])++{_PART}={{0,2}}$",
)
REDACTED = "[SECRET]"
#: Array elements added up in one go; longer arrays are summed in two levels.
_LEVEL = 512
#: Bits are counted in whole millionths, so that sums never drift.
_SCALE = 1_000_000


def _running(sizes: Column) -> Column:
    """Sums of what stands before each element; linear but for arrays of many thousands."""

    def before(values: Column, start: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(start.cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")
            ),
            lambda acc: acc["out"],
        )

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _LEVEL).cast("int")),
        lambda i: F.slice(sizes, i * _LEVEL + 1, F.lit(_LEVEL)),
    )
    sums = F.transform(
        chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda total, x: total + x)
    )
    return F.when(
        F.size(sizes) > 0, F.flatten(F.zip_with(chunks, before(sums, F.lit(0)), before))
    ).otherwise(F.array().cast("array<bigint>"))


def _matches(text: Column, pattern: str, group: int, likely: Column) -> Column:
    """Every match: code points since the last one, its length, and its measured group.

    ``likely`` holds for every text with a match and is cheaper to find out.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sized = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(whole)),
        whole,
        lambda gap, match: F.struct(
            gap.cast("long").alias("gap"), F.length(match).cast("long").alias("size")
        ),
    )
    found = F.zip_with(
        sized,
        values,
        lambda s, v: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), v.alias("value")),
    )
    none = F.array().cast("array<struct<gap:bigint,size:bigint,value:string>>")
    return F.when(likely, F.when(text.rlike(pattern), found).otherwise(none)).otherwise(none)


def _placed(matches: Column, starts: Column) -> Column:
    """Matches with start and end in the text."""
    return F.zip_with(
        matches,
        starts,
        lambda m, at: F.struct(
            (at + m["gap"]).alias("start"),
            (at + m["gap"] + m["size"]).alias("end"),
            m["value"].alias("value"),
        ),
    )


# --- entropy -----------------------------------------------------------------


def _bits(count: Column) -> Column:
    """``c * log2(c)`` in millionths, for counts up to the window."""
    table = [0, *[round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 1)]]
    return F.get(F.array(*[F.lit(v).cast("long") for v in table]), count)


def least_bits(candidate: Column, classes: Sequence = CLASSES) -> Column:
    """The threshold of a candidate's character class; null if it has none."""
    found = F.lit(None).cast("double")
    for _, patterns, bits in reversed(classes):
        holds = F.lit(True)
        for pattern in patterns:
            holds = holds & candidate.rlike(pattern)
        found = F.when(holds, bits).otherwise(found)
    return found


def entropy_hull(candidate: Column, bits: Column) -> Column:
    """First start and last end of windows with at least so many bits, or null."""
    chars = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    # Entropy = log2(W) - sum / W, so the sum must not exceed this.
    most = F.floor((math.log2(WINDOW) - bits) * WINDOW * _SCALE)

    def step(acc: Column, char: Column) -> Column:
        place = acc["next"]
        gone = F.when(place >= WINDOW, F.get(acc["chars"], (place - WINDOW).cast("int"))).otherwise(-1)
        left = F.when(gone >= 0, F.get(acc["counts"], gone)).otherwise(0)
        less = acc["sum"] - F.when(gone >= 0, _bits(left) - _bits(left - 1)).otherwise(0)
        held = F.get(acc["counts"], char) - F.when(gone == char, 1).otherwise(0)
        total = less + _bits(held + 1) - _bits(held)
        counts = F.transform(
            acc["counts"],
            lambda n, i: n + F.when(i == char, 1).otherwise(0) - F.when(i == gone, 1).otherwise(0),
        )
        high = (place >= WINDOW - 1) & (total <= acc["most"])
        return F.struct(
            (place + 1).alias("next"),
            acc["chars"].alias("chars"),
            acc["most"].alias("most"),
            counts.alias("counts"),
            total.alias("sum"),
            F.when(high & (acc["first"] < 0), place - WINDOW + 1).otherwise(acc["first"]).alias("first"),
            F.when(high, place + 1).otherwise(acc["last"]).alias("last"),
        )

    begin = F.struct(
        F.lit(0).cast("long").alias("next"),
        chars.alias("chars"),
        most.cast("long").alias("most"),
        zero.alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(-1).cast("long").alias("first"),
        F.lit(-1).cast("long").alias("last"),
    )
    return F.aggregate(
        chars,
        begin,
        step,
        lambda acc: F.when(
            acc["first"] >= 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last"))
        ),
    )


def allowed(candidate: Column, allow: Sequence[str] = ALLOW) -> Column:
    return F.exists(F.array(*[F.lit(a) for a in allow]), lambda a: F.regexp_like(candidate, a))


# --- spans -------------------------------------------------------------------


def _spans(kinds: Mapping[str, Column]) -> Column:
    """All kinds' spans by start, then by kind as listed."""
    listed = [_named(spans, rank, kind) for rank, (kind, spans) in enumerate(kinds.items())]
    return F.array_sort(F.concat(*listed))


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def _of_kind(kind: str) -> Column:
    return F.filter("base", lambda s: s["kind"] == kind)


def _long_enough(column: str, least: int) -> Column:
    return F.filter(column, lambda s: F.length(s["value"]) >= least)


def _text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    allow: Sequence[str] = ALLOW,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``found``, the spans as
    ``array<struct<start, rank, end, kind>>`` in code points, end exclusive.

    ``base`` holds the spans of the patterns: leftmost matches that do not overlap, per
    kind; matches too short are dropped after matching. ``found`` adds those of the
    entropy method. Null and empty texts have no span. Repeated rows each get their row,
    an empty table gives none. Only the columns named are read; ``keep`` names further
    ones to hand through.
    """
    rows = pick(docs, _id=id_col, _text=text_col, **{f"_keep_{c}": c for c in keep})
    held = [c for c in rows.columns if c.startswith("_keep_")]
    rows = rows.select("_id", F.coalesce("_text", F.lit("")).alias("_text"), *held)
    rows = rows.withColumn("_run", F.col("_text").rlike(LONG_RUN))
    likely = {
        "assign": F.contains("_text", F.lit("=")) | F.contains("_text", F.lit(":")),
        "access": F.contains("_text", F.lit("AKIA")),
    }
    patterns = {kind: (pattern, group) for kind, pattern, group, _ in PATTERNS}
    patterns["hex"] = (r"[0-9a-f]{24,}", 0)  # the same matches as those of 24 and more
    patterns[ENTROPY] = (CANDIDATE, 0)
    matched = rows.select(
        "*",
        *[
            _matches(F.col("_text"), p, g, likely.get(k, F.col("_run"))).alias(f"_m_{k}")
            for k, (p, g) in patterns.items()
        ],
    )
    placed = matched.select(
        "_id",
        "_text",
        *held,
        *[
            _placed(
                F.col(f"_m_{k}"), _running(F.transform(f"_m_{k}", lambda m: m["gap"] + m["size"]))
            ).alias(f"_p_{k}")
            for k in patterns
        ],
    )
    base = {kind: _long_enough(f"_p_{kind}", least) for kind, _, _, least in PATTERNS}
    candidates = F.filter(
        F.transform(
            F.filter(f"_p_{ENTROPY}", lambda s: ~allowed(s["value"], allow) & least_bits(s["value"]).isNotNull()),
            lambda s: F.struct(
                s["start"].alias("at"), entropy_hull(s["value"], least_bits(s["value"])).alias("hull")
            ),
        ),
        lambda s: s["hull"].isNotNull(),
    )
    spans = placed.select(
        F.col("_id").alias(id_col),
        *[F.col(c).alias(c[len("_keep_") :]) for c in held],
        _spans(base).alias("base"),
        F.transform(
            candidates,
            lambda s: F.struct(
                (s["at"] + s["hull"]["first"]).alias("start"), (s["at"] + s["hull"]["last"]).alias("end")
            ),
        ).alias("_more"),
    )
    new = F.filter(
        "_more",
        lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])),
    )
    added = _named(new, len(PATTERNS), ENTROPY)
    return spans.withColumn("found", F.array_sort(F.concat("base", added))).drop("_more")


def report(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, digest of the base spans, and all spans as text."""
    return spans.select(
        id_col,
        *[
            F.size(_of_kind(kind)).cast("long").alias(f"n_{kind}")
            for kind, *_ in PATTERNS
        ],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.col("found")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = REDACTED) -> Column:
    """A text with every span, or run of overlapping spans, replaced by a mark."""
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    bounds = F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))),
        merged,
        F.array(F.struct(F.length(text).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))),
    )
    kept = F.zip_with(
        F.slice(bounds, F.lit(1), F.size(bounds) - 1),
        F.slice(bounds, F.lit(2), F.size(bounds) - 1),
        lambda left, right: F.substring(
            text, (left["end"] + 1).cast("int"), (right["start"] - left["end"]).cast("int")
        ),
    )
    return F.when(F.size(spans) > 0, F.array_join(kept, mark)).otherwise(text)
