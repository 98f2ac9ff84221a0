"""Offset and keyset paging over an ordered result."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Envelope:
    """What a search response says beside its rows."""

    total: int
    page: int
    total_pages: int
    next_cursor: str | None


def order_columns(sort: str | None, order: str | None, score: str = "score", date: str = "last_indexed", key: str = "url") -> list[Column]:
    """Relevance: score descending, key ascending (``order`` is ignored). Date: descending unless exactly
    ``asc``, key ascending. An unknown ``sort`` is relevance."""
    if sort == "date":
        return [F.col(date).asc_nulls_last() if order == "asc" else F.col(date).desc_nulls_last(), F.col(key).asc()]
    return [F.col(score).desc(), F.col(key).asc()]


def offset_page(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """Page ``page`` (from 1) of ``limit`` rows; a distributed top-k, nothing is sorted whole."""
    if page < 1 or limit < 0:
        raise ValueError("page counts from 1 and limit must not be negative")
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def after_cursor(df: DataFrame, sort: str | None, order: str | None, cursor: str, score: str = "score", date: str = "last_indexed", key: str = "url") -> DataFrame:
    """Rows after a cursor: the JSON array of the last row's sort values."""
    value, last = json.loads(cursor)
    column = F.col(date) if sort == "date" else F.col(score)
    at = F.lit(value).cast(df.schema[date if sort == "date" else score].dataType)
    beyond = column > at if sort == "date" and order == "asc" else column < at
    return df.where(beyond | ((column == at) & (F.col(key) > F.lit(last))))


def keyset_page(df: DataFrame, sort: str | None, order: str | None, cursor: str | None, limit: int, **names: str) -> DataFrame:
    """The next ``limit`` + 1 rows after ``cursor`` (all from the start without one); the extra row tells that more follow."""
    rest = after_cursor(df, sort, order, cursor, **names) if cursor else df
    return rest.orderBy(*order_columns(sort, order, **names)).limit(limit + 1)


def cursor_of(row: dict, sort: str | None, score: str = "score", date: str = "last_indexed", key: str = "url") -> str:
    """Cursor of a row; scores keep full double precision, dates their ISO form."""
    value = row[date] if sort == "date" else row[score]
    return json.dumps([value if isinstance(value, (int, float)) or value is None else value.isoformat(sep=" "), row[key]])


def envelope(total: int, page: int, limit: int, last_row: dict | None, sort: str | None, keyset: bool = False, more: bool | None = None, **names: str) -> Envelope:
    """Totals and next cursor. Keyset pages report page 1 of 0; offset pages have a cursor while rows remain."""
    more = page * limit < total if more is None else more
    cursor = cursor_of(last_row, sort, **names) if more and last_row else None
    return Envelope(total, 1 if keyset else page, 0 if keyset else math.ceil(total / limit) if limit else 0, cursor)
