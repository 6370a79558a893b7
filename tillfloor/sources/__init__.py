from tillfloor.sources.csv import load_fact, read_clean_sales, read_raw_sales  # noqa: F401
from tillfloor.sources.sinks import (  # noqa: F401
    add_missing_columns,
    append_by_position,
    commit_version,
    current_version,
    publish_if_valid,
    published,
    read_fact,
    replace_table,
    write_csv,
    write_fact,
)
