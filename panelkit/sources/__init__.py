from panelkit.sources.tables import (  # noqa: F401
    read_table,
    read_variants,
    require_columns,
    require_rows,
    write_csv,
    write_json,
    write_parquet,
)
