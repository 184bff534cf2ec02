"""Text columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class used for word counts, the same characters that
# Python's str.split() separates on.
WORD_BREAK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
IN_WORD = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"

# Fixed value: shape of a generated drill run identifier.
RUN_ID_SHAPE = r"^v5-[a-z0-9-]+-\d{8}T\d{6}Z-[0-9a-f]{8}$"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def cleaned(value: str | Column) -> Column:
    return F.trim(col(value))


def code(value: str | Column) -> Column:
    """Upper-cased, trimmed code such as a status or a currency."""
    return F.upper(cleaned(value))


def present(value: str | Column) -> Column:
    """Not null and not blank; never null itself."""
    return F.coalesce(cleaned(value) != "", F.lit(False))


def words(value: str | Column) -> Column:
    """Non-empty whitespace-separated words of a whole text."""
    return F.filter(F.split(col(value), WORD_BREAK), lambda word: word != "")


def has_words(value: str | Column, least: int) -> Column:
    """Whether a text has at least that many words; reading stops as soon as it does."""
    more = f"(?:{WORD_BREAK}{IN_WORD}++)" + "{" + str(least - 1) + "}" if least > 1 else ""
    return col(value).rlike(f"{IN_WORD}++{more}")


def is_run_id(value: str | Column) -> Column:
    return F.coalesce(col(value).rlike(RUN_ID_SHAPE), F.lit(False))


def run_id(scenario: str, instant: str | Column, suffix: str | Column) -> Column:
    """``v5-<scenario>-<UTC>-<8 hex>`` for one instant; the suffix is supplied, so it replays."""
    slug = F.regexp_replace(F.lower(F.lit(scenario)), "[^a-z0-9-]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.concat(F.lit("v5-"), slug, F.lit("-"),
                    F.date_format(col(instant), "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), col(suffix))


def decoded_key(value: str | Column) -> Column:
    """Object key with ``%xx`` and ``+`` escapes resolved."""
    return F.url_decode(col(value))


def is_object_uri(value: str | Column) -> Column:
    return F.coalesce(cleaned(value).startswith("s3://"), F.lit(False))


def names_where(conditions: Iterable[tuple[Column, str]]) -> Column:
    """Distinct names whose condition is true, in the given order.

    Built from set functions that compile, not from lambda functions, which would take every
    condition out of the generated code.
    """
    found = F.array(*[F.when(condition, F.lit(name)) for condition, name in conditions])
    return F.array_except(found, F.array(F.lit(None).cast("string")))
