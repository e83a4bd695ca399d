"""Two versions of plans compared in one pass over the nodes, in partitions of so many rows whatever the input."""

import contextlib
import io

import pytest

from planlens.plans import alignment as al
from planlens.plans import bridge
from planlens.queries import queries


def scans(frame, table="lineitem"):
    """How often a result's plan reads a table."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return sum(f"/{table}.parquet" in line for line in out.getvalue().splitlines() if line.startswith("Location"))


@pytest.mark.parametrize("name", ["u03_shared_modules", "j19_binding_keys", "j13_generated_nodes", "j14_composition_changes", "v14_execution_proof", "j16_boundary_contracts", "j12_matched_plans", "d01_changes"])
def test_versions_are_made_in_one_pass(spark, data, name):
    assert scans(queries()[name](spark, data)) == 1


@pytest.mark.parametrize("name", ["p17_schema_contracts", "d03_dependency_keys", "d01_alignment", "g11_precreated_tasks"])
def test_nodes_are_made_once(spark, data, monkeypatch, name):
    made = []
    of = bridge.Bridge._nodes_of
    monkeypatch.setattr(bridge.Bridge, "_nodes_of", lambda self, lines: made.append(1) or of(self, lines))
    assert scans(queries()[name](spark, data)) <= (name == "d01_alignment") and len(made) == 1


def test_partitions_follow_the_rows(spark, data, monkeypatch):
    monkeypatch.setattr(bridge, "DEALT_ROWS", 500)
    b = bridge.Bridge(spark, data)
    rows = b.table("lineitem").count()
    assert b.versions.rdd.getNumPartitions() == -(-rows // 500)
    assert b.versions.filter("not after").count() == b.node.count() and b.versions.filter("after").count() == b.plan_after.count()


def test_null_keys_meet_nothing(spark):
    rows = spark.createDataFrame([(1, "a", False), (1, "a", True), (1, None, False), (1, None, True), (None, "a", False), (1, "b", True), (1, "b", True)], "plan_id long, module_id string, after boolean")
    got = sorted((str(r["plan_id"]), str(r["module_id"]), r["old_uses"], r["new_uses"]) for r in al.uses(rows).collect())
    assert got == [("1", "None", 0, 1), ("1", "None", 1, 0), ("1", "a", 1, 1), ("1", "b", 0, 2), ("None", "a", 1, 0)]
    assert {(r["module_id"], r["old_uses"]) for r in al.composition_changes(rows.filter("plan_id = 1")).collect()} == {(None, 1), (None, 0), ("b", 0)}
