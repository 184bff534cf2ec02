"""SHA-256 content identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilake.functions.text import col

SEPARATOR = "||"
NULL_TOKEN = "<NULL>"


def row_hash(columns: Sequence[str | Column], null_token: str | None = NULL_TOKEN) -> Column:
    """Hash of the columns' text in order.

    With a null token, (a, NULL, b) and (a, b, NULL) differ. ``null_token=None`` skips NULLs
    instead, which is the compatible form for tables hashed that way earlier.
    """
    parts = [col(c).cast("string") for c in columns]
    if null_token is not None:
        parts = [F.coalesce(part, F.lit(null_token)) for part in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def change_id(table: str, key: str, operation: str, order: str, source_columns: Sequence[str]) -> Column:
    """Identity of one source change: table, key, operation, order and every source column.

    Run metadata is left out, so a replay gets the same identity.
    """
    return row_hash([F.lit(table), key, operation, order, *source_columns])


def content_hash(content: str | Column) -> Column:
    return F.sha2(col(content), 256)
