"""Export of the published result tables (S16): one small CSV per analysis.

File names and columns follow the published outputs; where an output came from
the pandas path, the pandas variant of the analysis is used (qcut terciles,
item and order-seller grains, interval-cut review groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordersight.plans import descriptive, freight, retention, risk, summary
from ordersight.plans.context import workspace
from ordersight.sources.sinks import write_result_csv

# Published file names, in the order the analyses are reported.
EXPORT_FILES = [
    "delivery_review_analysis",
    "category_review_analysis",
    "repeat_purchase_analysis",
    "sellers_analysis",
    "region_review_analysis",
    "region_late_stratified",
    "freight_value_review_analysis",
    "freight_ratio_late_crosstab",
    "order_complexity_analysis",
    "order_complexity_late_stratified",
    "category_on_time_risk",
    "seller_on_time_risk",
    "retention_timing_analysis",
    "retention_late_context",
    "hypothesis_test_summary",
]


def result_tables(
    spark: SparkSession,
    location: str,
    cutoff: str,
    source: str = "testdata",
    min_state_orders: int = 200,
) -> dict[str, DataFrame]:
    ws = workspace(spark, location, source)
    mart, raw = ws.mart, ws.raw
    return {
        "delivery_review_analysis": descriptive.delay_bucket_reviews(mart),
        "category_review_analysis": risk.category_risk(raw),
        "repeat_purchase_analysis": retention.repeat_purchase(mart, cutoff),
        "sellers_analysis": risk.seller_risk(raw),
        "region_review_analysis": descriptive.region_reviews(mart, min_state_orders),
        "region_late_stratified": descriptive.region_late_stratified(mart, min_state_orders),
        "freight_value_review_analysis": freight.freight_terciles(mart, "qcut"),
        "freight_ratio_late_crosstab": freight.freight_late_crosstab_pretiled(mart),
        "order_complexity_analysis": descriptive.order_complexity(mart),
        "order_complexity_late_stratified": descriptive.order_complexity_late(mart),
        "category_on_time_risk": risk.category_on_time_risk_item(raw),
        "seller_on_time_risk": risk.seller_on_time_risk_order(raw),
        "retention_timing_analysis": retention.retention_timing_elapsed(mart, cutoff),
        "retention_late_context": retention.retention_late_context_cut(mart, cutoff),
        "hypothesis_test_summary": summary.hypothesis_summary(mart, raw, cutoff, min_state_orders),
    }


def export_results(
    spark: SparkSession, location: str, out_dir: str, cutoff: str, source: str = "testdata", min_state_orders: int = 200
) -> list[str]:
    """Write every result table under ``out_dir/<name>`` (one CSV file each); returns the paths."""
    tables = result_tables(spark, location, cutoff, source, min_state_orders)
    paths = []
    for name in EXPORT_FILES:
        path = f"{out_dir.rstrip('/')}/{name}"
        write_result_csv(tables[name], path)
        paths.append(path)
    return paths
