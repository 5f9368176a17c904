"""Detecting and hiding personal data before rows leave the executors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

# The shapes of e-mail addresses, social security numbers and bank accounts.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
}
CARD = r"\b(?:[0-9][ -]?){12,18}[0-9]\b"
# Names of columns that hold personal data unless others are given.
NAMES = (
    r"(?i)email",
    r"(?i)phone",
    r"(?i)\bssn\b|social_security",
    r"(?i)address",
    r"(?i)(first|last|full)_?name",
    r"(?i)birth|\bdob\b",
    r"(?i)passport|driver_?license",
    r"(?i)\bip_?address\b",
)
HIDDEN = "[hidden]"


def count_matches(column: Column, kind: str) -> Column:
    return F.size(F.regexp_extract_all(column, F.lit(PATTERNS[kind]), F.lit(0))).cast("long")


def card_numbers(column: Column) -> Column:
    """Digits of what looks like card numbers and passes their check digit."""
    found = F.transform(F.regexp_extract_all(column, F.lit(CARD), F.lit(0)), lambda x: F.regexp_replace(x, "[ -]", ""))
    return F.filter(found, lambda x: F.call_function("luhn_check", x))


def hide(column: Column) -> Column:
    """The text with every match replaced."""
    for pattern in PATTERNS.values():
        column = F.regexp_replace(column, pattern, HIDDEN)
    return column


def has_card(column: Column) -> Column:
    return F.size(card_numbers(column)) > 0


def hide_all(column: Column) -> Column:
    """hide(), and nothing at all of a text with a number that passes the check digit of payment cards."""
    return F.when(has_card(column), F.lit(HIDDEN)).otherwise(hide(column))


def _shown(column: Column, kind: DataType, name: str, names: Sequence[str]) -> Column:
    """The value with personal data hidden, however deep it lies. A field with a telling name is hidden whole: as text, or else as null."""
    if any(re.search(p, name) for p in names):
        return F.when(column.isNotNull(), F.lit(HIDDEN)) if isinstance(kind, StringType) else F.lit(None).cast(kind)
    if isinstance(kind, StringType):
        return hide_all(column)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: _shown(x, kind.elementType, "", names))
    if isinstance(kind, StructType):
        fields = [_shown(column.getField(f.name), f.dataType, f.name, names).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(_shown(e["key"], kind.keyType, "", names).alias("key"), _shown(e["value"], kind.valueType, "", names).alias("value")))
        return entries  # two keys may read the same once hidden, so a map is shown as its entries
    if isinstance(kind, (BinaryType, VariantType)):
        return F.when(column.isNotNull(), F.lit(HIDDEN))
    return column


def safe_sample(df: DataFrame, cap: int, names: Sequence[str] = NAMES, aggregate_only: bool = False) -> DataFrame:
    """At most cap rows to show as evidence: columns with telling names hidden, other text by content, in nested columns too."""
    columns = [_shown(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType, f.name, names).alias(f.name) for f in df.schema]
    return df.select(*columns).limit(0 if aggregate_only else cap)
