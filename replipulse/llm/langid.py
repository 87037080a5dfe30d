"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords, all character n-grams that do not
reach beyond a word and one boundary on each side, hashed into buckets; a linear softmax
over the mean gives the language. Both are trained by stochastic gradient descent in numpy
on a bounded sample of labelled rows. As the mean is linear, a text's logits are the mean
of its subwords' own logits, so a prediction needs one small table: buckets x languages.

Calibration on rows kept out of the training divides the logits by a temperature, and
texts whose calibrated score stays below a threshold are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replipulse.llm.common import in_chunks, pick, written

SIZES = (2, 3, 4)  # characters of a subword
BUCKETS, DIMENSIONS = 1 << 15, 16  # buckets: a power of two
#: Labelled rows used per language (fewer with very many languages: SAMPLE_ROWS in all),
#: and subwords taken from each, spread evenly over its whole text.
ROWS_PER_LANGUAGE, SAMPLE_ROWS, SUBWORDS = 1500, 24_000, 256
#: Passes over the rows, and rows seen at least in all of them.
EPOCHS, SEEN = 4, 24_000
BATCH, RATE, SEED = 32, 0.5, 7
UNDETERMINED = "und"
#: Characters that are worked on at once.
CHUNK = 1 << 18


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashed subwords, text after text, and how many each text has."""
    lowered = [t.lower() if t else "" for t in texts]
    # A boundary before the first text, and one after each.
    stops = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1) + 1
    joined = "\n".join(["", *lowered, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters().take(codes)
    codes = np.where(letter, codes, np.uint32(0))
    for size in SIZES:
        n = max(len(codes) - size + 1, 0)
        # All but the two ends are letters, and one of a pair is.
        valid = letter[1 : 1 + n] | letter[:n] if size == 2 else letter[1 : 1 + n].copy()
        for i in range(2, size - 1):
            valid &= letter[i : i + n]
        mixed = np.full(n, size, np.uint32)
        for i in range(size):
            mixed ^= codes[i : i + n]
            mixed *= np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        mixed &= np.uint32(buckets - 1)
        before = np.concatenate(([0], np.cumsum(valid)))
        # Its last but one character belongs to the text, whatever boundary follows.
        ends = before[np.clip(stops - max(size - 2, 1), 0, n)]
        yield mixed[valid].astype(np.int64), np.diff(ends, prepend=0)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


# --- model -------------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: each subword's logits
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.languages)))
        number = np.zeros(len(texts))
        for hashed, counts in subwords(texts, len(self.table)):
            some = np.flatnonzero(counts)
            if len(some):
                first = (np.cumsum(counts) - counts)[some]
                total[some] += np.add.reduceat(self.table.take(hashed, axis=0), first, axis=0)
                number += counts
        return total / np.maximum(number, 1)[:, None] + self.bias

    def long_logits(self, text: str) -> np.ndarray:
        """One very long text, part by part; parts end where a word does if one ends near."""
        total, number, at = np.zeros(len(self.languages)), 0, 0
        while at < len(text):
            end = min(at + CHUNK, len(text))
            if end < len(text):
                space = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                end = space if space > 0 else end
            for hashed, _ in subwords([text[at:end]], len(self.table)):
                total += self.table.take(hashed, axis=0).sum(axis=0)
                number += len(hashed)
            at = end
        return total / max(number, 1) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores; no letter: undetermined, score zero."""
        names = [UNDETERMINED] * len(texts)
        scores = np.zeros(len(texts))
        lengths = [len(t or "") for t in texts]
        for a, b in in_chunks(lengths, CHUNK) if self.languages else ():
            if b - a == 1 and lengths[a] > CHUNK:
                logits = self.long_logits(texts[a])[None, :]
            else:
                logits = self.logits(texts[a:b])
            odds = softmax(logits / self.temperature)
            for i, best in enumerate(odds.argmax(axis=1)):
                if has_letter(texts[a + i]):
                    names[a + i] = self.languages[best]
                    scores[a + i] = odds[i, best]
        return names, scores


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def fit(languages: list[str], found: list[np.ndarray], target: np.ndarray, kept_out: np.ndarray) -> Model:
    """Train on rows of hashed subwords, calibrate on those kept out."""
    rng = np.random.default_rng(SEED)
    classes = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, classes))
    bias = np.zeros(classes)
    train = np.flatnonzero(~kept_out)
    epochs = max(EPOCHS, SEEN // max(len(train), 1))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(train)
        for i in range(0, len(train), BATCH):
            rows = train[i : i + BATCH]
            flat = np.concatenate([found[r] for r in rows])
            sizes = np.array([len(found[r]) for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            mean = np.zeros((len(rows), DIMENSIONS))
            np.add.at(mean, owner, embed[flat])
            mean /= sizes[:, None]
            error = softmax(mean @ weights + bias)
            error[np.arange(len(rows)), target[rows]] -= 1
            back = (error @ weights.T) / sizes[:, None]
            weights -= rate * mean.T @ error / len(rows)
            bias -= rate * error.mean(axis=0)
            # The mean spreads a row's gradient thinly over its subwords.
            np.subtract.at(embed, flat, rate * SUBWORDS / 8 * back[owner] / len(rows))
    model = Model(languages, embed @ weights, bias, 1.0, 0.4)
    check = np.flatnonzero(kept_out)
    if len(check):
        logits = np.stack([model.table[found[r]].mean(axis=0) + bias for r in check])
        best = min(
            np.geomspace(0.25, 8, 41),
            key=lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), target[check]] + 1e-12).sum(),
        )
        odds = softmax(logits / best)
        model.temperature = float(best)
        model.threshold = rejection(odds.max(axis=1), odds.argmax(axis=1) == target[check])
    return model


def rejection(scores: np.ndarray, right: np.ndarray, precision: float = 0.95) -> float:
    """The lowest score from which on the accepted rows reach the precision.

    Held within 0.4 and 0.9: below, no language is likely, and a hard sample must not
    reject what is all but certain.
    """
    order = np.argsort(-scores)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    if share[-1] >= precision:
        return 0.4
    enough = np.flatnonzero(share >= precision)
    return float(np.clip(scores[order][enough[-1]] if len(enough) else 1.0, 0.4, 0.9))


# --- on Spark ----------------------------------------------------------------


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out: int = 2,
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> Model:
    """A model from at most ``rows_per_language`` labelled rows of each language.

    Rows of the held-out fold, and rows with a null language or no text, teach nothing.
    Texts are taken in the order of a hash of language and text, each once, whatever the ids
    of its rows: null ids and ids that repeat change nothing, and copies, which tie, count
    as one text. The driver gets ``SUBWORDS`` hashed subwords of each text, 2 kB, and at most
    ``SAMPLE_ROWS`` texts; of more languages than half as many, the most frequent are learned.
    Without any such row the model knows no language.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col)
    labelled = rows.filter((fold(F.col("id")) != held_out) & F.col("lang").isNotNull())
    taught = labelled.select("lang", "text", F.xxhash64("lang", "text", F.lit(SEED)).alias("mark"))
    counts = taught.groupBy("lang").agg(F.approx_count_distinct("mark").alias("texts"))
    counts = written(counts.orderBy(F.desc("texts"), "lang").limit(SAMPLE_ROWS // 2), "langid-languages")
    languages = counts.count()
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0, 0.4)
    limit = max(2, min(rows_per_language, SAMPLE_ROWS // languages))
    # Thinned to some twice as many before texts are told apart and put in order.
    place = F.pmod("mark", F.lit(1 << 30))
    near = taught.select("lang", "mark").join(counts, "lang").filter(place < F.least(2 * limit / F.col("texts"), F.lit(1.0)) * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    chosen = near.groupBy("lang", "mark").count().withColumn("rank", rank).filter(F.col("rank") <= limit)
    # Stored: Spark knows its bytes, SAMPLE_ROWS narrow rows.
    chosen = written(chosen.select("lang", "mark"), "langid-sample")
    sample = taught.join(chosen, ["lang", "mark"]).select("lang", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # of a task, no more than were chosen
        for batch in batches:
            fresh = []
            for i, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if pair not in seen:
                    seen.add(pair)
                    fresh.append(i)
            some = batch.take(pa.array(fresh, pa.int64()))
            spread = []
            for text in some.column(2).to_pylist():
                parts = [hashed for hashed, _ in subwords([text])]
                parts = np.concatenate(parts) if parts else np.empty(0, np.int64)
                at = np.linspace(0, len(parts) - 1, min(SUBWORDS, len(parts))).astype(np.int64)
                spread.append(parts[at])
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(spread, pa.list_(pa.int64()))],
                ["lang", "mark", "found"],
            )

    found = sample.mapInArrow(run, "lang string, mark long, found array<bigint>").filter("size(found) > 0")
    got = sorted((r["lang"], r["mark"], r["found"]) for r in found.groupBy("lang", "mark").agg(F.first("found").alias("found")).collect())
    if not got:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0, 0.4)
    languages = sorted({lang for lang, _, _ in got})
    target = np.array([languages.index(lang) for lang, _, _ in got])
    kept_out = np.array([mark % 5 == 0 for _, mark, _ in got])
    if kept_out.all():
        kept_out[:] = False
    return fit(languages, [np.array(found) for _, _, found in got], target, kept_out)


def identify(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score``, ``rejected``.

    ``keep`` names columns to hand through, so that a row can be kept or left where it is.
    Only the text is looked at. Null and empty texts, and texts without a letter, are
    ``und`` with score zero and rejected; so is every text if the model knows no language.
    A text scoring below the model's threshold keeps its language and is rejected.
    Repeated rows each get their row; an empty table gives none.
    """
    rows = pick(docs, id=id_col, text=text_col, **{f"keep_{i}": c for i, c in enumerate(keep)})
    names = ["lang_pred", "score", "rejected", *[c for c in rows.columns if c != "text"]]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names[3:])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            langs, scores = held.predict(batch.column(1).to_pylist())
            rejected = [n == UNDETERMINED or s < held.threshold for n, s in zip(langs, scores.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()),
                    pa.array(scores),
                    pa.array(rejected, pa.bool_()),
                    batch.column(0),
                    *batch.columns[2:],
                ],
                names,
            )

    found = rows.mapInArrow(run, f"lang_pred string, score double, rejected boolean, {schema}")
    return found.select(
        F.col("id").alias(id_col),
        "lang_pred",
        "score",
        "rejected",
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
    )
