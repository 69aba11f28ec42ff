from ordersight.sources.readers import (  # noqa: F401
    load_raw_tables,
    normalize_empty_strings,
    read_jdbc_table,
    read_raw_csv,
    read_raw_csv_dir,
)
