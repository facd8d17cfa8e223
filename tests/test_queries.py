"""Every market query against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from compare import close, table_rows

from marketloom.plans import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, db, name):
    found, wanted = queries.queries()[name](spark, SF).toPandas(), db.sql(oracles.oracle_sql()[name]).df()
    for frame in (found, wanted):
        for c in frame.columns:
            if str(frame[c].dtype).startswith("datetime"):
                frame[c] = frame[c].astype("datetime64[us]")
    assert sorted(found.columns) == sorted(wanted.columns)
    assert close(table_rows(found), table_rows(wanted))


def plan(spark, name: str) -> str:
    df = queries.queries()[name](spark, SF)
    return df._jdf.queryExecution().optimizedPlan().toString() if name == "news_sentiment" else df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_gone_through_once(spark):
    assert plan(spark, "news_sentiment").count("regexp_replace") < 20


def test_feed_reads_little(spark):
    assert plan(spark, "news_feed").count("Exchange hashpartitioning") <= 8


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    """The entry in a copy of the repository without those folders, with and without the pipeline's file."""
    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries()) == sorted(e.oracle_sql()), any(x.startswith('op') or x == 'pipeline' for x in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")})
    assert out.stdout.split() == [str(len(queries.queries())), "True", "False"], out.stderr


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
