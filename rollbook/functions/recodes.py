"""Category recodes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.values import if_na

# Spellings of the status category and what each becomes.
STATUS_INTENDED = {
    "positive": "Positive",
    "negative": "Negative",
    "Unknown": "Unknown",
    "Uknown": "Unknown",
    "unknown": "Unknown",
    "Known positive": "Known Positive",
    "known Positive": "Known Positive",
    "Known Positive": "Known Positive",
}

# The same recode with the trailing blank and the misspelling that existing
# dashboards were fed with.
STATUS_AS_WRITTEN = {
    "positive": "Positive",
    "negative": "Negative",
    "Unknown": "Unknown ",
    "Uknown": "Unknown ",
    "unknown": "Unknown",
    "Known positive": "Known Positve",
    "known Positive": "Known Positve",
    "Known Positive": "Known Positve",
}

# Fixed values.
REGION_CODES = {"North Rift Region": "NRR"}
SEX_CODES = {"Male": "MALE"}
PLACE_CODES = {"05": "LAMU"}


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed spellings in one pass; other values and NULL stay."""
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return c if out is None else out.otherwise(c)


def place_from_code(code: Column, place: Column, codes: Mapping[str, str] = PLACE_CODES) -> Column:
    """Place named by the leading characters of an id, else the recorded place.

    An unknown id makes the place unknown as well (three-valued if).
    """
    out = place
    for prefix, name in codes.items():
        out = if_na(F.substring(code, 1, len(prefix)) == prefix, F.lit(name), out)
    return out
