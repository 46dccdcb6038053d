"""Staged tables and connected components."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from casewright.operators.components import checkpoint_dir, components, stage_step, stage_table


def _staged(spark, name):
    return glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/{name}-*")


def test_step_drops_what_it_staged_and_keeps_its_result(spark):
    outside = stage_table(spark.range(10), "outside")

    def inner():
        return stage_table(outside.filter("id > 2"), "innermost").filter("id > 3")

    def outer():
        found = stage_step(inner, "inner")
        assert not _staged(spark, "innermost") and len(_staged(spark, "inner")) == 1
        return found.filter("id > 4")

    kept = stage_step(outer, "outer-step")
    assert sorted(r.id for r in kept.collect()) == [5, 6, 7, 8, 9]
    assert not _staged(spark, "inner") and _staged(spark, "outer-step") and _staged(spark, "outside")
    assert outside.count() == 10


def test_failed_step_leaves_the_session_as_it_was(spark):
    def broken():
        stage_table(spark.range(3), "leftover")
        raise ValueError("no rows")

    try:
        stage_step(broken, "broken")
    except ValueError:
        pass
    assert _staged(spark, "leftover") and not _staged(spark, "broken")
    assert stage_step(lambda: stage_table(spark.range(4), "again"), "after").count() == 4
    assert _staged(spark, "leftover") and not _staged(spark, "again")


def test_components_of_empty_and_small_tables(spark):
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components(none).count() == 0
    links = spark.createDataFrame([(5, 3), (3, 9), (7, 7), (20, 10), (10, 20)], "a bigint, b bigint")
    got = {(r.node, r.component) for r in stage_step(lambda: components(links), "of").orderBy(F.col("node")).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (7, 7), (10, 10), (20, 10)}
