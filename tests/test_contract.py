"""The driver contract on the smallest tables."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check_queries import TABLES, canonical
from textloom.operators import segmentation
from textloom.plans import bindings, queries
from textloom.plans.oracle import ORACLE
from textloom.plans.queries import REGISTRY

QUICK = ("translation_backlog_cost", "segment_markdown", "hit_miss_counts", "price",
         "p95_nearest_rank", "job_event_feed", "extract_terms", "chrf", "rebuild_documents",
         "search_blocks", "bounded_payload", "document_outline", "mask_code_fences")


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


# Compared with brute force in their own tests.
WITHOUT_STATEMENT = {"extract_literals", "preservation", "quality_report", "model_difference",
                     "block_changes"}


def test_every_query_has_a_statement():
    named = {n for n in contract.queries() if n in REGISTRY}
    assert named - WITHOUT_STATEMENT == set(ORACLE)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_statement(spark, sf, con, name):
    frame = contract.queries()[name](spark, sf)
    done = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in done.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(
        done.fetchall(), columns)


def test_segmentation_itself_needs_no_shuffle(spark, sf):
    docs = bindings.table(spark, sf, "documents").selectExpr("cast(doc_id as string) id", "text")
    plan = segmentation.segment_markdown(docs)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and "Exchange" not in plan


def test_fences_stay_in_the_jvm(spark, sf):
    docs = bindings.markdown_documents(spark, sf)
    plan = segmentation.segment_markdown(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Exchange" not in plan


def test_kept_tables_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffles()
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    rows = queries.kept(counts, "counts")
    for _ in range(50):  # they are removed in the background
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert rows.where("count = 100").count() == 100
    assert spark.conf.get(queries.CLEANUP, "false") == "false"
