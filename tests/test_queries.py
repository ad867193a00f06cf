import pytest

import __spark_entry__
from veilspark.plans import queries as redaction

from .compare import rows_of, rows_of_sql, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return tables(FOLDER)


@pytest.mark.parametrize("name", sorted(redaction.queries()))
def test_query_matches_its_sql(spark, db, name):
    assert rows_of(__spark_entry__.queries()[name](spark, FOLDER)) == rows_of_sql(db, __spark_entry__.oracle_sql()[name])


@pytest.mark.parametrize("name", ["q_email_redact", "q_report_by_lang", "q_buffered_stream"])
def test_very_long_documents_are_processed_whole(spark, tmp_path, name):
    long = "lorem ipsum " * 12_000 + "by user@example.invalid"
    spark.createDataFrame([(1, long, "en"), (2, "short", "en"), (3, "a@example.invalid", "fr")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = rows_of(__spark_entry__.queries()[name](spark, str(tmp_path)))
    assert len(long) > 128_000 and found == rows_of_sql(tables(str(tmp_path)), __spark_entry__.oracle_sql()[name])


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 200


def test_every_redaction_query_has_sql():
    assert set(redaction.queries()) == set(redaction.oracle_sql())


def test_no_other_module_needs_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(__spark_entry__.__file__).parent / "veilspark"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"(from|import) .*\bllm\b", p.read_text())]
