from .aggregates import (
    distinct_values,
    percent_of,
    plain_mean,
    rmse,
    weighted_mean,
    weighted_mean_of_parts,
    weighted_parts,
)
from .missing import has_number, is_float, is_missing, number_or_null
from .numeric import at_most, percent_change, round_even, row_mean, to_number
from .recode import (
    band_of_cuts,
    first_match,
    level_index,
    outside,
    parity_zone,
    recode,
    sector_from_funding,
    sign_zone,
    without_text,
)
from .tdist import t_for_level
from .text import (
    composite_key,
    country_code,
    fill_text,
    fixed_decimals,
    lower_label,
    safe_int_key,
    snake_names,
    thousands,
    trim_blanks,
    truncate_label,
)

__all__ = [name for name in dir() if not name.startswith("_")]
