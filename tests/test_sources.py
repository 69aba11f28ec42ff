"""Readers and sinks: CSV round trip through the marketplace file layout."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from conftest import SF01 as SF01_DIR
from ordersight.operators.mart import build_mart
from ordersight.plans import descriptive
from ordersight.sources.adapter import raw_tables_from_testdata
from ordersight.sources.readers import CSV_FILES, read_raw_csv_dir
from ordersight.sources.sinks import write_result_csv


def _to_file_layout(name, df):
    """Add the columns the export files carry but the stored tables drop."""
    if name == "orders":
        cols = df.columns
        df = df.withColumn("order_approved_at", F.lit(None).cast("timestamp_ntz")).withColumn(
            "order_delivered_carrier_date", F.lit(None).cast("timestamp_ntz")
        )
        return df.select(*cols[:4], "order_approved_at", "order_delivered_carrier_date", *cols[4:])
    if name == "order_reviews":
        return df.select(
            "review_id", "order_id", "review_score",
            F.lit('multi-line "quoted"\ncomment').alias("review_comment_title"),
            F.lit("").alias("review_comment_message"),
            "review_creation_date", "review_answer_timestamp",
        )
    if name == "products":
        # The SQL path kept '' categories; write them back as empty strings.
        return df.withColumn("product_category_name", F.coalesce("product_category_name", F.lit("")))
    return df


def test_csv_round_trip_gives_the_same_analysis(spark):
    raw = raw_tables_from_testdata(spark, SF001)
    out = tempfile.mkdtemp(prefix="ordersight-csv-")
    for name, file_name in CSV_FILES.items():
        # RFC 4180 quoting (quotes doubled), as in the marketplace export files.
        _to_file_layout(name, raw[name]).coalesce(1).write.option("header", "true").option("escape", '"').option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
        ).csv(os.path.join(out, file_name))
    back = read_raw_csv_dir(spark, out)
    assert back["order_reviews"].count() == raw["order_reviews"].count()
    assert back["products"].where(F.col("product_category_name").isNull()).count() > 0
    a = descriptive.delay_bucket_reviews(build_mart(raw)).collect()
    b = descriptive.delay_bucket_reviews(build_mart(back)).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_result_csv_sink(spark):
    raw = raw_tables_from_testdata(spark, SF001)
    out = os.path.join(tempfile.mkdtemp(prefix="ordersight-sink-"), "delay")
    write_result_csv(descriptive.delay_bucket_reviews(build_mart(raw)), out)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1
    assert spark.read.option("header", "true").csv(out).count() == 4


def test_result_round_trip_with_schema(spark):
    from ordersight.sources.readers import read_result_csv

    raw = raw_tables_from_testdata(spark, SF001)
    out = os.path.join(tempfile.mkdtemp(prefix="ordersight-result-"), "delay")
    res = descriptive.delay_bucket_reviews(build_mart(raw))
    write_result_csv(res, out)
    back = read_result_csv(spark, out, res.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, res.collect()))


def test_public_api(spark):
    from ordersight import api

    raw = raw_tables_from_testdata(spark, SF001)
    mart = api.build_mart_order_fact(raw)
    counts = api.contingency_counts(
        api.delivered_reviewed(mart).where(F.col("delivery_delay_days").isNotNull())
        .withColumn("b", api.delay_bucket("delivery_delay_days")),
        "b",
        "is_low_review",
    )
    assert 0 < api.cramers_v(counts).first().cramers_v < 1
    cells = spark.createDataFrame([(2542, 6986, 9695, 76609)], "a long, b long, c long, d long")
    assert round(api.odds_ratio_2x2(cells).first().odds_ratio, 3) == 2.875
    samples = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 2), ("y", 3)], "g string, v int")
    assert abs(api.cliff_delta(samples, "v", "g", "x", "y").first().cliffs_delta + 2 / 3) < 1e-12


def test_workspace_table_materialisation(spark):
    from ordersight.plans.context import workspace

    a = workspace(spark, SF001, materialize="table").mart
    b = workspace(spark, SF001).mart
    assert a.count() == b.count() == 1500
    assert sorted(map(tuple, descriptive.delay_bucket_reviews(a).collect())) == sorted(
        map(tuple, descriptive.delay_bucket_reviews(b).collect())
    )


def test_export_results(spark):
    from ordersight.plans.exports import EXPORT_FILES, export_results

    out = tempfile.mkdtemp(prefix="ordersight-export-")
    paths = export_results(spark, SF01_DIR, out, "2000-07-01")
    assert len(paths) == len(EXPORT_FILES) == 15
    first_lines = {}
    for p in paths:
        csv = [f for f in os.listdir(p) if f.endswith(".csv")]
        assert len(csv) == 1
        with open(os.path.join(p, csv[0])) as fh:
            first_lines[os.path.basename(p)] = fh.readline().strip()
    assert first_lines["delivery_review_analysis"] == "delivery_bucket,orders,avg_review_score,low_review_rate_pct"
    assert first_lines["hypothesis_test_summary"].startswith("hypothesis,question,test,statistic,p_value")


def test_release_workspace(spark):
    from ordersight.plans.context import release_workspaces, workspace

    ws = workspace(spark, SF001)
    n = descriptive.delay_bucket_reviews(ws.mart).count()
    assert n == 4 and ws.mart.is_cached
    assert release_workspaces(spark) >= 1
    again = workspace(spark, SF001)
    assert again is not ws and descriptive.delay_bucket_reviews(again.mart).count() == 4


def test_parquet_source_round_trip(spark):
    from ordersight.sources.readers import load_raw_tables
    from ordersight.sources.sinks import write_table_parquet

    raw = raw_tables_from_testdata(spark, SF001)
    out = tempfile.mkdtemp(prefix="ordersight-parquet-")
    for name, df in raw.items():
        write_table_parquet(df, os.path.join(out, name))
    back = load_raw_tables(spark, "parquet", out)
    a = descriptive.delay_bucket_reviews(build_mart(raw)).collect()
    b = descriptive.delay_bucket_reviews(build_mart(back)).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
