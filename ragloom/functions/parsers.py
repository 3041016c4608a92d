"""Small parsers of model output, as column expressions."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ragloom.functions.text import squeeze_ends


def rating(text: Column) -> Column:
    """The first number after ``Total rating:``, in tenths; null without one."""
    found = F.regexp_extract(text, r"Total rating:\D*(\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double") / 10.0)


def candidates(text: Column) -> Column:
    """The texts after ``(a)``, ``(b)`` and so on, each up to the line's end, without commas."""
    found = F.regexp_extract_all(text, F.lit(r"\(\w+\)\s*([^()]+)"), F.lit(1))
    return F.transform(found, lambda c: squeeze_ends(F.replace(F.substring_index(c, "\n", 1), F.lit(","), F.lit(""))))


def says_true(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("true")).cast("int")


def preferred_passage(text: Column) -> Column:
    """1 for the first passage, 0 for the second, 0.5 for neither."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("passage 1")), 1.0).when(F.contains(low, F.lit("passage 2")), 0.0).otherwise(0.5)


def subquery(text: Column) -> Column:
    """A query without quotes around it and without its number."""
    bare = squeeze_ends(text)
    bare = F.when(F.startswith(bare, F.lit('"')) & F.endswith(bare, F.lit('"')) & (F.length(bare) > 1), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    return F.regexp_replace(bare, r"^Intermediate query \d+: ", "")


def action(text: Column) -> Column:
    """The last ``Action:`` of an agent's output as struct<name, argument>, from ``name[argument]`` or a fenced block; null without one."""
    last = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(r"(?s)Action:\s*(.*?)(?=\n(?:Thought|Action|Observation):|$)"), F.lit(1))), -1)
    name, argument = F.regexp_extract(last, r"(?s)^(\w+)\[(.*)\]\s*$", 1), F.regexp_extract(last, r"(?s)^(\w+)\[(.*)\]\s*$", 2)
    fenced = squeeze_ends(F.regexp_extract(last, r"(?s)```(?:\w+\n)?(.*?)```", 1))
    return F.when(last.isNotNull(), F.struct(F.when(name != "", name).alias("name"), F.when(name != "", argument).when(fenced != "", fenced).otherwise(squeeze_ends(last)).alias("argument")))


def prefixed(text: Column, is_query: bool) -> Column:
    """A text with the instruction that asymmetric encoders were trained with."""
    return F.concat(F.lit("query: " if is_query else "passage: "), text)


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u4e00-\\u9fff]"), F.lit(False))


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    return F.floor(F.length(text) / chars_per_token)


def content_key(value: Column) -> Column:
    """Equal for equal values; only equality means anything."""
    return F.sha2(value.cast("string"), 256)


def mean_confidence(logprobs: Column) -> Column:
    """Mean chance of the tokens; null without any."""
    return F.when(F.size(logprobs) > 0, F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + F.exp(x)) / F.size(logprobs))


@F.arrow_udf(DoubleType())
def compression_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Normalised compression distance of two texts."""

    def size(text: str) -> int:
        return len(zlib.compress(text.encode(), 9))

    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        x, y = x or "", y or ""
        p, q = size(x), size(y)
        out.append((size(x + y) - min(p, q)) / max(p, q))
    return pa.array(out, pa.float64())
