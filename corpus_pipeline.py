"""From raw documents to packed training sequences, stage by stage.

Every stage takes all that the one before kept, is written, and is read again. Columns of
the documents that a stage does not need go through it as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replipulse.llm import decontaminate, langid, packing, secrets, simhash
from replipulse.llm.common import written


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns named by their place, and these names."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*places), dict(zip(docs.columns, places))


def _kept(docs: DataFrame, judge: Callable[..., DataFrame], condition: str) -> DataFrame:
    """The rows for which a condition holds on what an operator says of each.

    The operator hands all columns through, so a row is judged and kept, or left, in the task
    that read it, without a join.
    """
    rows, place = _numbered(docs)
    doc_id, text = place["doc_id"], place["text"]
    found = judge(rows, id_col=doc_id, text_col=text, keep=[c for c in rows.columns if c != doc_id])
    return found.filter(condition).select(*rows.columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; those it rejects go.

    Null and empty texts and texts without a letter are rejected. Without any labelled
    document nothing can be learned and every document is rejected.
    """
    return _kept(docs, partial(langid.identify, model=langid.train(docs)), "not rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id.

    Groups go by text alone: rows that share an id but not their text are judged apart, and a
    group without any id keeps a row as well. Ties go to the smallest hash of the whole row;
    rows alike in all columns are one. Null and empty texts are a group, like any copies; an
    empty table gives none. A row is named by its place in the files of ``docs``, so no text
    is compared or sorted to find it again.
    """
    rows, place = _numbered(docs)
    told = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    # Hashes pass over nulls, so where they stand is hashed too.
    whole = F.xxhash64(*told, *[F.isnull(c) for c in rows.columns]).alias("whole")
    marked = rows.select("*", whole, F.monotonically_increasing_id().alias("row"))
    stays = simhash.survivors(marked, place["doc_id"], place["text"], ("whole", "row"))
    kept = marked.join(stays, "row", "left_semi")
    return kept.select(*rows.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; the others go as a whole.

    Null and empty texts, and texts without a word, have no window and stay; repeated rows are
    judged each, and alike. An empty benchmark, or one of empty items, takes nothing, and an
    empty table gives none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, partial(decontaminate.contamination, benchmark=benchmark), "not contaminated")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; ``n_chars`` follows the text.

    Null texts stay null, and so does their ``n_chars``.
    """
    rows, place = _numbered(docs)
    doc_id, text = place["doc_id"], place["text"]
    spans = secrets.scan(rows, doc_id, text, keep=[c for c in rows.columns if c != doc_id])
    clean = spans.withColumn(text, secrets.redacted(F.col(text), F.col("found")))
    if "n_chars" in place:
        size = F.length(text).cast(rows.schema[place["n_chars"]].dataType)
        clean = clean.withColumn(place["n_chars"], F.when(F.size("found") > 0, size).otherwise(F.col(place["n_chars"])))
    return clean.select(*rows.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as full training sequences: a row per piece, with its tokens.

    A null or empty text is its end token alone; repeated rows are packed each. Rows without a
    source share a queue. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixture packing", packed),
]

#: Hashing, learned languages and tokenizers are beyond SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
