"""Column expressions for the loose typing of feed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Currency codes recognised inside price text.
CURRENCY_CODES = (
    "EUR", "USD", "GBP", "CHF", "AED", "SAR", "EGP", "JPY", "CNY", "INR", "AUD", "CAD", "SEK", "NOK", "DKK",
    "PLN", "CZK", "HUF", "RON", "BGN", "HRK", "TRY", "BRL", "MXN", "KRW",
)
CODE_PATTERN = rf"(?i)\b({'|'.join(CURRENCY_CODES)})\b"
SIGN_PATTERN = "[€$£¥₹]"
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
LEADING_PATTERN = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def non_empty(c: Column) -> Column:
    """Null unless the value counts as filled: null, '' and '0' are empty."""
    text = c.cast("string")
    return F.when(text.isNotNull() & (text != "") & (text != "0"), c)


def present(c: Column) -> Column:
    """Null unless the value is there: only null and '' are absent, '0' is present."""
    return F.nullif(c.cast("string"), F.lit(""))


def is_number(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(NUMBER_PATTERN), F.lit(False))


def leading_number(c: Column) -> Column:
    """The number that a text begins with; 0 if none."""
    found = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), LEADING_PATTERN, 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def first_of(df: DataFrame, names: list[str] | tuple[str, ...], test=non_empty) -> Column:
    """The first listed column that exists and passes ``test``; null if none."""
    there = [test(column(df, n)) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and colons included; of a list, its first element."""
    c = F.col(f"`{name}`")
    return F.get(c, F.lit(0)) if dict(df.dtypes)[name].startswith("array") else c


def price_number(c: Column) -> Column:
    """Price text to a number: signs and codes go, '2,00' has a decimal comma, first number; else 0."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, SIGN_PATTERN, ""), CODE_PATTERN, ""))
    point = F.regexp_replace(bare, r"^(\d+),(\d{2})$", "$1.$2")  # one use of the text before: a branch would make it anew
    number = F.nullif(F.regexp_extract(point, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    return F.when(is_number(text), F.trim(text).try_cast("double")).otherwise(F.coalesce(number, F.lit(0.0)))


def price_number_no_commas(c: Column) -> Column:
    """The second rule for price text: commas and spaces go first, so '2,00' is 200."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, r"[€$£¥₹,\s]", ""), CODE_PATTERN, "")
    number = F.nullif(F.regexp_extract(bare, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    return F.when(is_number(text), F.trim(text).try_cast("double")).otherwise(F.coalesce(number, F.lit(0.0)))


def price_number_locale(c: Column) -> Column:
    """Price text where the last of '.' and ',' is the decimal mark and the other one groups."""
    digits = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9.,]", "")
    comma_last = F.instr(F.reverse(digits), ",").between(1, 3) & ((F.instr(F.reverse(digits), ".") == 0) | (F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), ".")))
    plain = F.when(comma_last, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def blank(c: Column) -> Column:
    """Null or ''."""
    return c.isNull() | (c == "")


def zero(c: Column) -> Column:
    """Null or 0."""
    return c.isNull() | (c == 0)
