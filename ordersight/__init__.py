"""ordersight: order-experience analytics expressed as Spark DataFrame plans.

Layout
------
- ``sources``   typed readers (Parquet / CSV / JDBC), the test-data adapter, sinks
- ``functions`` column-level helpers (labels, flags, exact rounding, day counts,
                tail probabilities)
- ``operators`` reusable DataFrame operators (order mart, grains, exact tiles,
                histogram ranks, contingency statistics, FDR, first/next order)
- ``plans``     the analyses themselves (quality checks, descriptive tables,
                hypothesis tests, summary, chart inputs)
"""

from ordersight.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
