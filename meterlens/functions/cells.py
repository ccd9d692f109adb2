"""Text cells: header parsing, numeric coercion, value classes, natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMPORT = "consumption_import"
EXPORT = "injection_export"

# A plain decimal literal, optionally signed and with an exponent. Type suffixes ("12d"),
# digit separators ("1_000"), "nan" and "inf" do not count as numbers.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_TWO_WAY = r"(?s)^(.*) - (A[+-])$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_prosumer_sheet(sheet: Column, match: str) -> Column:
    return F.contains(F.lower(sheet), F.lit(match.lower()))


def header_meter(raw: Column, prosumer: Column) -> Column:
    header = stripped(raw)
    return F.when(prosumer & header.rlike(_TWO_WAY), F.regexp_extract(header, _TWO_WAY, 1)).otherwise(header)


def header_flow(raw: Column, prosumer: Column) -> Column:
    exported = prosumer & stripped(raw).rlike(r"(?s)^.* - A-$")
    return F.when(exported, F.lit(EXPORT)).otherwise(F.lit(IMPORT))


def number_or_null(raw: Column) -> Column:
    return F.when(raw.rlike(NUMBER), raw.try_cast("double"))


def is_blank(raw: Column) -> Column:
    return raw.isNull() | (stripped(raw) == "")


def value_kind(raw: Column) -> Column:
    number = number_or_null(raw)
    return (
        F.when(is_blank(raw), "missing")
        .when(number.isNull(), "non_numeric")
        .when(number < 0, "negative")
        .when(number == 0, "zero")
        .otherwise("positive")
    )


def trailing_number(identifier: Column) -> Column:
    """Sort key: the integer after the last space, or 10^9 when there is none."""
    tail = F.substring_index(identifier, " ", -1)
    return F.when(
        identifier.contains(" ") & tail.rlike(r"^\s*[+-]?\d+\s*$"),
        F.coalesce(tail.try_cast("bigint"), F.lit(10**9)),
    ).otherwise(F.lit(10**9))


def joined_names(names: Column) -> Column:
    """Distinct non-blank names, sorted and joined with '; '; NULL when none remain. An aggregate."""
    kept = F.collect_set(F.when(stripped(names) != "", names))
    return F.nullif(F.array_join(F.array_sort(kept), "; "), F.lit(""))


def joined_pair(left: Column, right: Column) -> Column:
    """Row-wise form of ``joined_names`` for two columns."""
    kept = F.array_sort(F.array_distinct(F.array_compact(F.array(left, right))))
    return F.nullif(F.array_join(kept, "; "), F.lit(""))
