"""Column functions with the missing-value rules of a spreadsheet register."""

from rollbook.functions.recodes import (
    STATUS_AS_WRITTEN,
    STATUS_INTENDED,
    place_from_code,
    recode,
)
from rollbook.functions.values import (
    cell_date,
    concat_na,
    excel_date,
    if_na,
    is_positive,
    is_unread_date,
    is_value,
    is_yes,
    number_column,
    parse_numbers,
    parse_yes,
    run_date_label,
    text_date,
    to_number,
)

__all__ = [
    "STATUS_AS_WRITTEN",
    "STATUS_INTENDED",
    "cell_date",
    "concat_na",
    "excel_date",
    "if_na",
    "is_positive",
    "is_unread_date",
    "is_value",
    "is_yes",
    "number_column",
    "parse_numbers",
    "parse_yes",
    "place_from_code",
    "recode",
    "run_date_label",
    "text_date",
    "to_number",
]
