from ordersight.functions.columns import (  # noqa: F401
    ALPHA,
    DELAY_BUCKETS,
    REVIEW_GROUPS,
    calendar_days,
    delay_bucket,
    elapsed_days,
    late_flag,
    low_review_flag,
    rate_pct,
    review_group_cut,
    review_group_sql,
    round_half_up,
    round_ratio,
)
