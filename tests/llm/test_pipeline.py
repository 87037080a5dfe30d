"""The pipeline's stages against plain versions."""

import corpus_pipeline
import pytest
from cases import clashing, documents, rows
from test_decontaminate import plain as plain_hits
from test_packing import check_round_trip, exact_encoder
from test_secrets import plain_base, plain_entropy
from test_simhash import plain_fingerprint, plain_groups

from replipulse.llm import secrets
from replipulse.llm.common import written


def redacted(text):
    base = plain_base(text)
    spans = []
    for start, _, end, _ in sorted(base + plain_entropy(text, base)):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    for start, end in reversed(spans):
        text = text[:start] + secrets.REDACTED + text[end:]
    return text


def test_stages_on_the_test_tables(spark, sf_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]

    first = written(stage[names[0]](spark, docs, sf_dir), "test")
    assert first.columns == docs.columns
    assert 0.98 * docs.count() <= first.count() <= docs.count()

    second = written(stage[names[1]](spark, first, sf_dir), "test")
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in first.collect()]
    stays = {d for (d, _), c in zip(prints, plain_groups(prints)) if d == c}
    assert rows(second) == [r for r in rows(first) if r[0] in stays]

    third = written(stage[names[2]](spark, second, sf_dir), "test")
    assert rows(third) == [r for r in rows(second) if not plain_hits(r[1], items)[-1]]

    fourth = written(stage[names[3]](spark, third, sf_dir), "test")
    expected = [(r[0], redacted(r[1]), *r[2:4], len(redacted(r[1]))) for r in rows(third)]
    assert rows(fourth) == sorted(expected, key=repr)

    pieces = stage[names[4]](spark, fourth, sf_dir).collect()
    check_round_trip(fourth.collect(), pieces, exact_encoder())


@pytest.mark.parametrize("change", [clashing, lambda d: d.limit(0)])
def test_awkward_rows(spark, sf_dir, change):
    docs = change(documents(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns
        found.collect()
    corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_run_on_awkward_rows(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, "eins zwei")], "item_id bigint, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 4, 5, 6 and 9 have no letter, 2, 3 and the null id are copies of 1, and 7 is an item.
    assert {p.doc_id for p in pieces} == {1, 8, 10, -11}
    assert sum(p.length for p in pieces if p.doc_id == -11) == 2


def test_secrets_leave_null_texts_alone(spark, sf_dir):
    got = corpus_pipeline.secret_scan(spark, documents(spark), sf_dir)
    assert rows(got) == rows(documents(spark))


def _prose(seed):
    return " ".join(f"w{seed}x{i * i % 89}" for i in range(80))


def test_one_row_of_each_group_whatever_the_ids(spark, sf_dir):
    """Groups without ids keep a row; ids that repeat neither join groups nor lose them."""
    texts = {name: _prose(n) for n, name in enumerate("ABCDEF")}
    given = [
        (None, "A"), (None, "A"), (None, "B"), (7, "C"), (7, "D"), (3, "D"), (7, "E"), (7, "E"), (9, "F"), (None, "F"),
    ]
    docs = spark.createDataFrame(
        [(i, texts[t], "en", None if n % 2 else "s", 1) for n, (i, t) in enumerate(given)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    names = {text: name for name, text in texts.items()}
    expected = sorted([(None, "A"), (None, "B"), (7, "C"), (3, "D"), (7, "E"), (9, "F")], key=repr)
    kept = set()
    for parts in (1, 3, 7):
        found = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), sf_dir)
        assert sorted(((r.doc_id, names[r.text]) for r in found.collect()), key=repr) == expected
        kept.add(tuple(rows(found)))
    assert len(kept) == 1


@pytest.mark.parametrize("given", ["null", "35", "if(n % 3 = 0, null, n)"])
def test_documents_stay_whatever_their_ids(spark, sf_dir, given):
    """Null or repeated ids neither empty the language model nor take documents away."""
    words = "CASE n % 3 WHEN 0 THEN 'the house of wood' WHEN 1 THEN 'das haus aus holz' ELSE 'la maison en bois' END"
    docs = spark.range(3000).selectExpr("id AS n").selectExpr(
        f"bigint({given}) AS doc_id", f"concat({words}, ' ', n) AS text",
        "CASE n % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang", "'s' AS source", "bigint(1) AS n_chars",
    )
    assert corpus_pipeline.language_id(spark, docs, sf_dir).count() > 2900
