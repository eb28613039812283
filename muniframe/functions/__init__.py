from .dates import hour_minute, month_index, month_start, parse_date, period_of_day
from .lookup import literal_map, lookup, recode, vocabulary_frame
from .numeric import (
    any_positive, argmax_name, array_sum, cast_columns, clip, cyclic, keep_or, parse_census_number, parse_ptbr_number, pct,
    positive_ratio, rate_per, ratio, round_half_even, row_mean, row_sum, strict_long, to_number,
)
from .text import clean_text, clean_words, has_text, map_binary, map_weekday_pt, normalize_name, standard_names, standardize_category
