from .reports import (
    coerce_numeric,
    dimension_table,
    fill_zero_int,
    overwrite_parts,
    read_detailed_reports,
    read_multi_country_reports,
    read_reports,
    read_with_rejects,
    rejected_records,
    rename_map,
    rename_positional,
    trim_headers,
    write_result,
)

__all__ = [
    "coerce_numeric", "dimension_table", "fill_zero_int", "overwrite_parts", "read_detailed_reports",
    "read_multi_country_reports", "read_reports", "read_with_rejects", "rejected_records", "rename_map", "rename_positional",
    "trim_headers", "write_result",
]
