"""Header repair. Header lists are small and handled on the driver; the data stay lazy."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ordered (pattern, replacement) rules on header text; names are lowered afterwards.
REGISTER_RULES = (
    (r" ", "_"),
    (r"-", "_"),
    (r"[<(.)/>]", ""),
)
EXPORT_RULES = (
    (r" ", "_"),
    (r"-", "_"),
    (r"[<(.)/>\\]", ""),
    (r'["\\]', ""),
)
TRACKER_RULES = (
    (r" ", "_"),
    (r"-", "_"),
    (r":", ""),
    (r"\?", ""),
    (r"[<(.)/>\\]", ""),
    (r'["\\]', ""),
)

# Repaired source headers and the names the reports use.
REGISTER_RENAMES = {
    "kp_unique_identifier\r\nsrclient_initialstypologyhotspotpe_codeclient_no": "kp_unique_identifier",
    "date_of_enrolment_ddmmyyyy": "date_of_enrolment",
    "date_of_first_contact_ddmmyyyy": "date_of_first_contact",
    "date_of_next_appointment\r\ndd_mm_yyyy_eg_02_may_201873": "date_of_next_appointment73",
    "date_of_next_appointment\r\ndd_mm_yyyy_eg_02_may_2018126": "date_of_next_appointment126",
}
# The same headers in snake case.
SNAKE_RENAMES = {
    "kp_unique_identifier_sr_client_initials_typology_hotspot_pe_code_client_no": "kp_unique_identifier",
    "date_of_enrolment_dd_mm_yyyy": "date_of_enrolment",
    "date_of_first_contact_dd_mm_yyyy": "date_of_first_contact",
}
EXPORT_RENAMES = {
    "kp_unique_identifier\r\nsrclient_initialstypologyhotspotpe_codeclient_no": "kp_unique_identifier",
    "date_of_next_appointment\r\ndd_mm_yyyy_eg_02_may_2018126": "date_of_next_appointment",
    "kp's_name3_names_&_nickname": "kp_name",
    "date_of_first_contact_ddmmyyyy": "date_of_first_contact",
    "date_of_enrolment_ddmmyyyy": "date_of_enrollment",
}
TRACKER_RENAMES = {
    "completed_all_sessions_status_completenot_complete": "complete_sessions",
}


def unique_by_position(headers: Sequence[str | None]) -> list[str]:
    """Append the 1-based column position to every blank or repeated header."""
    stems = [re.sub(r"(\.\.\.\d+)+$", "", h or "") for h in headers]
    seen = Counter(stems)
    return [
        f"{stem}...{position}" if not stem or seen[stem] > 1 else stem
        for position, stem in enumerate(stems, start=1)
    ]


def snake_case(header: str) -> str:
    """One header as ASCII snake case."""
    text = header.replace("'", "").replace('"', "")
    text = text.replace("%", "_percent_").replace("#", "_number_")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return text if text and not text[0].isdigit() else f"x{text}"


def clean_headers(headers: Sequence[str]) -> list[str]:
    """Snake-case headers; a repeated result gets ``_2``, ``_3`` and so on."""
    taken: set[str] = set()
    out = []
    for header in headers:
        stem = name = snake_case(header)
        copy = 1
        while name in taken:
            copy += 1
            name = f"{stem}_{copy}"
        taken.add(name)
        out.append(name)
    return out


def apply_rules(headers: Sequence[str], rules: Sequence[tuple[str, str]]) -> list[str]:
    """Run the ordered replacement rules over each header, then lower it."""
    out = []
    for header in headers:
        for pattern, replacement in rules:
            header = re.sub(pattern, replacement, header)
        out.append(header.lower())
    return out


def _set_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    repeated = [n for n, k in Counter(n.lower() for n in names).items() if k > 1]
    if repeated:
        raise ValueError(f"headers are not unique after repair: {repeated}")
    return df.toDF(*names)


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case all column names."""
    return _set_names(df, clean_headers(df.columns))


def unique_names(df: DataFrame) -> DataFrame:
    """Append the column position to blank and repeated column names."""
    return _set_names(df, unique_by_position(df.columns))


def repair_names(df: DataFrame, rules: Sequence[tuple[str, str]] = REGISTER_RULES) -> DataFrame:
    """Apply a rule chain to all column names."""
    return _set_names(df, apply_rules(df.columns, rules))


def _line_breaks(name: str) -> str:
    return name.replace("\r\n", "\n")


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename by name. A missing old name is an error; CR/LF and LF in names are the same."""
    actual = {_line_breaks(c): c for c in df.columns}
    missing = [old for old in renames if _line_breaks(old) not in actual]
    if missing:
        raise ValueError(f"columns to rename are absent: {missing}")
    by_column = {actual[_line_breaks(old)]: new for old, new in renames.items()}
    return _set_names(df, [by_column.get(c, c) for c in df.columns])


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give the columns another table's names, in order. The counts must agree."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns cannot take {len(names)} names")
    return _set_names(df, names)


def names_missing_from(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Names on the left that the right lacks, in left order."""
    known = set(right)
    return [name for name in left if name not in known]


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of ``left`` that ``right`` lacks, with the values that would be lost in each."""
    only = names_missing_from(left.columns, right.columns)
    if not only:
        return left.sparkSession.createDataFrame([], "column_name string, n_values bigint")
    counted = left.agg(*[F.count(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(only)])
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("n_values"))
        for i, c in enumerate(only)
    ]
    return counted.select(F.inline(F.array(*cells)))
