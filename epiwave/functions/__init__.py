from .scalars import (
    argmax_label,
    bucket_start,
    case_fatality,
    clip_lower,
    clip_range,
    columns,
    days_between,
    fill_zero,
    fixed_decimals,
    next_week,
    null_if_zero,
    parse_date,
    parse_number,
    quoted,
    ratio,
    round_half_even,
    scrub_nonfinite,
    week_start,
)

__all__ = [
    "argmax_label", "bucket_start", "case_fatality", "clip_lower", "clip_range", "columns", "days_between",
    "fill_zero", "fixed_decimals", "next_week", "null_if_zero", "parse_date", "parse_number", "quoted", "ratio",
    "round_half_even", "scrub_nonfinite", "week_start",
]
