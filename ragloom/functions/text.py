"""Text functions on columns.

Word boundaries and white space are those of Unicode (``(?U)``), as in Python's ``re``; functions whose pattern is ASCII say so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, English articles, words and patterns of the answer extractors.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?U)\b(a|an|the)\b"
LEAD_IN = r"(?i)^(the\s+answer\s+is|answer\s*:|final\s+answer\s*:|it\s+is|this\s+is)\s+"
CLAUSE = r"[,;(]| because | which | that | was | is "
MENTION = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"
MENTION_STOP = "what which who whom whose when where why how is are was were do does did can could should would will the a an".split()
ENTITY = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4})\b"
ENTITY_STOP = (
    "which what where when who whom whose why how are is was were been the this that these those first second last same both each every all some "
    "does did name year years many more most"
).split()
NEGATION = r"\b(not|never|no|cannot)\b"
SENTENCE_END = r"(?<=[.!?])\s+"


def squeeze(text: Column) -> Column:
    """White space trimmed, and inside made one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_core(text: Column) -> Column:
    """Lower case, articles out, then punctuation out, squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(text), ARTICLES, " "), PUNCTUATION, ""))


def norm_toolkit(text: Column) -> Column:
    """Lower case, punctuation out, then articles out, squeezed. The order makes a difference: "a-n"."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), ARTICLES, " "))


def words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def ascii_terms(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case: the search tokenizer."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def clean_final_answer(text: Column) -> Column:
    """The first line without its lead-in, up to the first clause, without full stops at the ends."""
    line = squeeze_ends(F.element_at(F.split(squeeze_ends(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), 1))
    line = squeeze_ends(F.regexp_replace(line, LEAD_IN, ""))
    part = squeeze_ends(F.element_at(F.split(line, CLAUSE), 1))
    return squeeze_ends(F.regexp_replace(part, r"^\.+|\.+$", ""))


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def mentions(text: Column, most: int | None = None) -> Column:
    """Capitalised phrases of one to four ASCII words, at least three letters, each once in order; ``most`` of them."""
    found = F.filter(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)), lambda m: ~F.lower(m).isin(*MENTION_STOP) & (F.length(m) >= 3))
    found = F.array_distinct(found)
    return found if most is None else F.slice(found, 1, most)


def question_entities(text: Column) -> Column:
    """Capitalised phrases of two to five ASCII words, each once by lower case, in order."""
    found = F.filter(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)), lambda m: ~F.lower(m).isin(*ENTITY_STOP))
    lowered = F.transform(found, lambda m: F.lower(m))
    return F.filter(found, lambda m, i: F.array_position(lowered, F.lower(m)) == i + 1)


def question_id(text: Column, dataset: str = "") -> Column:
    digest = F.substring(F.sha2(F.lower(squeeze_ends(text)), 256), 1, 12)
    return F.concat(F.lit(f"{dataset}_"), digest) if dataset else digest


def title_of(contents: Column) -> Column:
    return F.substring_index(contents, "\n", 1)


def body_of(contents: Column) -> Column:
    """What follows the first line."""
    return F.substring(contents, F.length(title_of(contents)) + 2, F.length(contents))


def strip_html(text: Column) -> Column:
    """Tags out, white space squeezed."""
    return squeeze(F.regexp_replace(text, "<[^>]+>", " "))


def sentences(text: Column, least: int = 6) -> Column:
    """Sentences of at least ``least`` characters."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.length(s) >= least)


def head_and_tail(text: Column, most: int) -> Column:
    """A text cut to ``most`` characters by taking out its middle."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.right(text, F.lit(half))))


def final_answer(text: Column) -> Column:
    """What follows ``[Final Answer]``, on its line or the next; null without the mark."""
    found = F.regexp_extract(text, r"\[Final Answer\][ \t]*\n?[ \t]*([^\n]*)", 1)
    return F.when(F.contains(text, F.lit("[Final Answer]")), squeeze_ends(found))


def last_tag(text: Column, tag: str) -> Column:
    """The text of the last ``<tag>``; null without one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) > 0, squeeze_ends(F.element_at(found, -1)))


def steps(text: Column) -> Column:
    """Reasoning steps as array of (index, body): headers ``[Step n]``, ``### Step n`` and ``Step n:`` at the start of a line.

    A step's body runs to the next header or the final answer.
    """
    header = r"(?m)^(?:\[Step (\d+)\]|#+ *Step (\d+):?|Step (\d+):)"
    indexes = F.regexp_extract_all(text, F.lit(header), F.lit(0))
    bodies = F.split(F.element_at(F.split(text, r"\[Final Answer\]"), 1), header)
    numbered = F.transform(indexes, lambda h: F.regexp_extract(h, r"(\d+)", 1).cast("int"))
    return F.filter(
        F.transform(numbered, lambda n, i: F.struct(n.alias("index"), squeeze_ends(F.get(bodies, i + 1)).alias("body"))), lambda s: s["body"].isNotNull()
    )


def cited_triples(text: Column) -> Column:
    """``(h, r, t)`` citations as array of (h, r, t)."""
    found = F.regexp_extract_all(text, F.lit(r"\(([^(),]+),([^(),]+),([^(),]+)\)"), F.lit(0))
    inner = lambda m: F.split(F.regexp_replace(m, r"^\(|\)$", ""), ",")
    return F.transform(found, lambda m: F.struct(*[F.trim(F.get(inner(m), F.lit(i))).alias(n) for i, n in enumerate("hrt")]))


def angle_triples(text: Column) -> Column:
    """``<h; r; t>`` triples; the head may itself hold semicolons."""
    found = F.regexp_extract_all(text, F.lit(r"<([^<>]*;[^<>]*;[^<>]*)>"), F.lit(1))
    part = lambda m, i: F.trim(F.regexp_extract(m, r"^(.*);([^;]*);([^;]*)$", i))
    return F.transform(found, lambda m: F.struct(part(m, 1).alias("h"), part(m, 2).alias("r"), part(m, 3).alias("t")))
