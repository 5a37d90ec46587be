from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from umbra import catalog
from umbra.config import Config
from umbra.plans.sanitize import Sanitizer
from umbra.sources.tables import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    session = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            session.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return session


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) and not math.isnan(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_and_sql_agree(spark, duck, small, name):
    df = __spark_entry__.queries()[name](spark, small)
    columns = sorted(df.columns)
    said = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(said.columns)
    got = sorted(map(plain, df.select(*columns).collect()), key=str)
    want = sorted(map(plain, said.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert got == want


def test_every_query_has_sql_but_the_diffs():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"unified_diffs"}


def test_detectors_have_rows_and_negatives(duck):
    found = {n: duck.sql(q).fetchall() for n, q in catalog.oracle_sql().items() if n.startswith("detect_") and n.removeprefix("detect_") in catalog.DERIVED}
    events = duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
    assert all(0 < len(rows) for rows in found.values()) and len(found["detect_jwt"]) < 5 * events


def test_diffs(spark, small):
    """Against difflib over the texts that the sanitising query gives, and twice in one session."""
    import difflib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    done = {r.doc_id: r.sanitized for r in catalog.redact_documents(spark, small).collect() if r.redaction_count}
    want = {i: "".join(difflib.unified_diff(texts[i].splitlines(True), s.splitlines(True), f"doc-{i} (original)", f"doc-{i} (sanitized)")) for i, s in done.items()}
    for _ in range(2):
        got = {r.doc_id: r.diff for r in __spark_entry__.queries()["unified_diffs"](spark, small).collect()}
        assert got == want and len(got) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_plan_is_native_and_prunes(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet")
    done = Sanitizer.from_config(Config(redact_pii=True)).sanitize(rows).select("doc_id", "sanitized")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "n_chars" not in plan


def test_only_tables_of_few_partitions_are_dealt_out(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 9)).rdd.getNumPartitions() == 9
