"""The pipeline's stages, one after another, against what each should do to its own input."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute as B  # noqa: E402

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    rows = [(i, say(80) + "\n" + say(60) + ("\nShared Footer" if i % 3 == 0 else ""), "en", "s", 1) for i in range(80)]
    rows += [(100, rows[1][1], "en", "s", 1), (101, rows[2][1] + " ", "en", "s", 1)]
    rows += [(110, say(400) + " " + items[2][1] + " " + say(400), "en", "s", 1), (111, items[3][1], "en", "s", 1)]
    rows += [(120, None, "en", None, None), (121, "12 34", None, "s", 5)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def test_stages(spark, tables):
    at, rows, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["language"](spark, docs, at)
    assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows} - {120, 121}

    docs = stages["lines"](spark, docs, at)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and not any("Shared Footer" in t for t in text.values()) and len(text) == len(rows) - 2

    docs = stages["near_duplicates"](spark, docs, at)
    expected = {i for i, (_, c) in B.op8(list(text.items()), words=5).items() if i == c}
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == expected and not expected & {100, 101}

    docs = stages["decontamination"](spark, docs, at)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == expected - {110, 111}

    made = stages["encoding"](spark, docs, at)
    assert made.where("round_trip").count() == len(expected) - 2


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).select(F.sum("n_tokens")).first()[0] > 0


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tables):
    """Further columns, of internal and output names too, come through every stage that returns documents."""
    at, rows, _ = tables
    names = ["_kept", "_row", "n_lines", "n_dropped", "drop_runs", "_id", "_ka", "_kb", "_stays", "_hits", "_language", "component", "hits", "a", "b", "rows"]
    docs = spark.read.parquet(f"{at}/documents.parquet").select("*", *[F.col("doc_id").alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, at)
        assert made.columns == docs.columns, name
        assert all(r[c] == r.doc_id for r in made.collect() for c in names), name


def test_intermediate_tables_go(spark, tables):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    made = corpus_pipeline.run(spark, tables[0])
    assert len(set(os.listdir(folder)) - before) == 1 and made.count() > 0
