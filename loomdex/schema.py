"""Explicit schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_A = T.ArrayType(_S)

CONTENT = T.StructType([*[T.StructField(f"h{i}", _A) for i in range(1, 7)], T.StructField("paragraphs", _A), T.StructField("full_text", _S)])

PAGE = T.StructType([
    T.StructField("url", _S, False), T.StructField("domain", _S, False), T.StructField("title", _S), T.StructField("title_autocomplete", _S),
    T.StructField("content", CONTENT), T.StructField("meta_description", _S), T.StructField("meta_keywords", _A),
    T.StructField("og_title", _S), T.StructField("og_description", _S), T.StructField("og_image", _S),
    T.StructField("depth", T.IntegerType()), T.StructField("content_type", _S), T.StructField("word_count", T.IntegerType()), T.StructField("language", _S),
    T.StructField("first_indexed", T.TimestampNTZType()), T.StructField("last_indexed", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("content_hash", _S),
])

CRAWL_JOB = T.StructType([
    T.StructField("url", _S), T.StructField("depth", T.IntegerType()), T.StructField("source", _S), T.StructField("enqueued_at", T.LongType()),
    T.StructField("attempt", T.IntegerType()), T.StructField("max_attempts", T.IntegerType()),
])

FETCHED = T.StructType([
    T.StructField("url", _S), T.StructField("html", _S), T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.MapType(_S, _S)), T.StructField("content_type", _S),
])
