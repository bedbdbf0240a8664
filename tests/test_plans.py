"""Plans are what they should be: pruned scans, pushed filters, equi-joins, no Python where none is needed."""

import re

import pytest
from pyspark.sql import functions as F

import scriptorium.plans.registry as registry
from scriptorium.operators import geometry
from scriptorium.sources import documents as src
from scriptorium.tables import spread, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [("cores", {"text"}), ("script_profile", {"doc_id", "text"}), ("html_text", {"page_id", "html"}), ("export_keys", {"p_partkey", "p_brand", "p_size"}), ("event_windows", {"ts", "event_type", "value"}), ("worst_scaled", {"l_orderkey", "l_linenumber", "l_returnflag", "l_discount"})],
)
def test_scans_read_only_what_is_used(spark, smallest, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(registry.queries()[name](spark, smallest)))
    assert schemas and all({c.split(":")[0] for c in s.split(",")} == columns for s in schemas)


@pytest.mark.parametrize("name", ["box_overlaps", "row_limits", "smallest_holder", "painted_over", "right_aligned", "placed_items", "missing_targets", "source_word_leaks", "termbase_merge"])
def test_joins_have_keys(spark, smallest, name):
    text = plan(registry.queries()[name](spark, smallest))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"kinsoku_lines"}))
def test_no_python_in_built_in_queries(spark, smallest, name):
    assert not re.search("Python|Pandas|Arrow", plan(registry.queries()[name](spark, smallest)))


def test_filters_reach_the_scan(spark, smallest, tmp_path):
    items = table(spark, smallest, "lineitem").filter("l_quantity > 10")
    assert "GreaterThan(l_quantity,10.0)" in plan(items)
    src.write_segments(spark.range(40).select(F.col("id"), (F.col("id") % 5).cast("int").alias("page")), str(tmp_path / "s"))
    one = spark.read.parquet(str(tmp_path / "s")).filter(src.page_filter("2,4-", F.col("page")))
    assert re.search(r"PartitionFilters: \[[^\]]*page", plan(one)) and one.count() == 24


def test_small_inputs_are_spread_and_large_ones_are_not(spark, smallest):
    docs = table(spark, smallest, "documents")
    assert spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = docs.repartition(16)
    assert spread(many) is many


def test_overlaps_are_not_quadratic(spark):
    """Boxes in a row: the pairs that meet grow with the boxes, not with their square."""
    boxes = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("id"), (F.col("id") * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 10.0 + 12).alias("x1"), F.lit(5.0).alias("y1"))
    assert geometry.overlaps(boxes).count() == 3999


def joined_rows(df):
    """How many rows each join of the executed plan gives."""
    df.collect()

    def walk(node):
        inner = {"AdaptiveSparkPlanExec": "executedPlan"}.get(node.getClass().getSimpleName())
        inner = "plan" if inner is None and node.getClass().getSimpleName().endswith("QueryStageExec") else inner
        if inner:
            yield from walk(getattr(node, inner)())
        elif node.getClass().getSimpleName().endswith("JoinExec"):
            yield node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_row_limits_make_no_pairs(spark):
    """Boxes on one row: what the joins give grows with the boxes, not with their square."""
    boxes = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page"), F.col("id"), (F.col("id") * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 10.0 + 5).alias("x1"), (F.col("id") % 3 + 5.0).alias("y1"))
    limits = geometry.row_limits(boxes, boxes.withColumn("oid", F.col("id")), boxes.select("doc_id", "page").distinct().withColumn("width", F.lit(40000.0)))
    rows = joined_rows(limits)
    assert rows and max(rows) < 10 * 3000
    assert {r["right_limit"] - 10 * r["id"] for r in limits.filter("id between 4 and 2990").collect()} == {8.5}


def test_placements_make_no_pairs(spark, smallest, tmp_path):
    """Parts whose keys put all of them on one row of one page."""
    parts = table(spark, smallest, "part").limit(1).drop("p_partkey").crossJoin(spark.range(2000).select((F.col("id") * 2800).alias("p_partkey")))
    parts.write.parquet(str(tmp_path / "part.parquet"))
    rows = joined_rows(registry.queries()["placements"](spark, str(tmp_path)))
    assert rows and max(rows) < 20 * 2000
