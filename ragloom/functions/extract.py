"""Answer extractors for the output formats of several prompting styles, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.metrics import let
from ragloom.functions.text import squeeze_ends

# What stands before an answer.
SELF_ASK, CHAIN = "So the final answer is: ", "So the answer is:"
ANSWER_LINE = r"(?i)^(answer|final answer)\s*[:：]\s*"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), squeeze_ends), lambda x: x != "")


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def self_ask(text: Column) -> Column:
    """What follows the mark on its line; empty without it."""
    hit = _first(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(SELF_ASK))))
    return F.coalesce(squeeze_ends(F.get(F.split(hit, SELF_ASK), F.lit(1))), F.lit(""))


def chain_of_thought(text: Column) -> Column:
    """What follows the mark; the whole text without it."""
    return F.when(F.contains(text, F.lit(CHAIN)), squeeze_ends(F.get(F.split(text, CHAIN), F.lit(1)))).otherwise(text)


def first_line(text: Column) -> Column:
    return squeeze_ends(F.substring_index(text, "\n", 1))


def content_line(text: Column) -> Column:
    """The first line of over three characters that isn't a question or answer label; else the first line."""
    fits = lambda x: ~F.startswith(x, F.lit("Question:")) & ~F.startswith(x, F.lit("Answer:")) & (F.length(x) > 3)
    return let(lambda lines: F.coalesce(_first(F.filter(lines, fits)), _first(lines), F.lit("")), _lines(text))


def tagged(text: Column) -> Column:
    """The first ``<answer>``, else the first line labelled as answer, else the last line."""
    tag = F.regexp_extract(text, r"(?is)<answer>\s*(.*?)\s*</answer>", 1)
    has = F.rlike(text, F.lit(r"(?is)<answer>.*?</answer>"))

    def by_line(lines: Column) -> Column:
        labelled = _first(F.filter(lines, lambda x: F.rlike(x, F.lit(ANSWER_LINE))))
        return F.coalesce(squeeze_ends(F.regexp_replace(labelled, ANSWER_LINE, "")), F.try_element_at(lines, F.lit(-1)), F.lit(""))

    return F.when(has, squeeze_ends(tag)).otherwise(let(by_line, _lines(text)))


def last_choice(text: Column) -> Column:
    """The last capital letter from A to D; empty without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit("[A-D]"), F.lit(0)), F.lit(-1)), F.lit(""))
