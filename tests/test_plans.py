"""Physical plans, scratch folders and session settings."""

import re
from pathlib import Path

import pytest

from spokeworks import workspace
from spokeworks.plans import QUERIES
from spokeworks.sources import read_profiles

FOLDER = "/root/testdata/sf0.001"
LAZY = [n for n in QUERIES if not n.startswith(("stream_", "sitemap_publish", "sitemap_roundtrip", "robots"))]
# Columns each query needs from its input.
READS = {
    "psi_score": {"o_orderkey", "o_custkey"},
    "to_fixed_1": {"l_orderkey", "l_linenumber", "l_extendedprice"},
    "visit_total": {"event_type"},
    "json_contract": {"event_id", "props"},
    "canonical_url": {"page_id", "url"},
    "sitemap_entries": {"url"},
    "sitemap_index": {"url"},
    "object_key": {"page_id", "url", "html"},
    "flatten_sections": {"doc_id", "text"},
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pair_joins_and_no_gathering(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Only a count over the whole table may end in one partition, as one row per task.
    assert ("SinglePartition" in text) == (name == "visit_total_site")
    assert "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", list(READS))
def test_scan_reads_needed_columns_only(spark, name):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(QUERIES[name](spark, FOLDER)))
    assert {c.split(":")[0] for schema in schemas for c in schema.split(",")} == READS[name]


def test_psi_score_has_no_shuffle(spark):
    text = plan(QUERIES["psi_score"](spark, FOLDER))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_scratch_lies_in_the_configured_folder(spark):
    assert workspace.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert workspace.scratch_path(spark, "a") != workspace.scratch_path(spark, "a")


class _Session:
    """A session without a checkpoint folder."""

    class sparkContext:  # noqa: N801
        getCheckpointDir = staticmethod(lambda: None)

    conf = {"spark.sql.warehouse.dir": "store://shared/warehouse/"}


def test_without_a_folder_the_warehouse_serves():
    assert workspace.scratch_root(_Session) == "store://shared/warehouse/scratch"


def test_job_removes_its_tables(spark, tmp_path):
    with workspace.job(spark) as path:
        table = workspace.scratch_table(spark.range(5).toDF("x"), "numbers")
        assert table.inputFiles()[0].startswith(f"file://{path}")
        table.write.parquet(str(tmp_path / "result"))
    assert not Path(path).exists()
    assert spark.read.parquet(str(tmp_path / "result")).count() == 5
    other = workspace.scratch_table(spark.range(1).toDF("x"), "numbers")
    workspace.release(spark, other.inputFiles()[0].rsplit("/", 1)[0])
    assert not Path(other.inputFiles()[0].removeprefix("file://")).exists()


def test_jobs_of_threads_are_apart(spark):
    """A job that ends in one thread leaves the tables of another."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    both = Barrier(2)

    def work(n):
        with workspace.job(spark, f"job{n}") as path:
            both.wait(60)
            table = workspace.scratch_table(spark.range(n).toDF("x"), "numbers")
            assert table.inputFiles()[0].startswith(f"file://{path}")
            both.wait(60)
            if n == 7:
                both.wait(60)  # until the other job has ended
                return table.count()
        both.wait(60)
        return 0

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, (5, 7))) == [0, 7]


def _parses(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_verdicts_are_computed_once(spark):
    whole = _parses(QUERIES["json_contract"](spark, FOLDER))
    assert whole and _parses(QUERIES["json_quarantine"](spark, FOLDER)) == _parses(QUERIES["json_passing"](spark, FOLDER)) == whole


def test_whole_maps_take_one_shuffle(spark):
    assert plan(QUERIES["unique_key_map"](spark, FOLDER)).count("Exchange") == 1


def test_profiles_from_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "profile_id,riderweight,bikeweight,tirewidth,tubeless\n1,150,20,25,true\n2,,20,,false\n"
    )
    assert [tuple(r) for r in read_profiles(spark, str(tmp_path)).collect()] == [
        (1, "150", "20", "25", "true"), (2, None, "20", None, "false"),
    ]
