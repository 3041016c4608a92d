"""Secret scanning with an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its content. The ledger has a row for each blob that a run
scanned: the rule versions applied, and the findings, each with the rule version that made it. A run scans only the pairs of blob and
rule version that the ledger doesn't have, appends its rows, and joins findings back to all paths (rows)
that hold the blob. Copies are thus scanned once, in one run or over many. A report takes the findings of the rule versions it is asked
for alone, so those of older versions and of removed rules stay in the ledger without being counted, and the order of the rules doesn't matter to it.

Offsets are code points, end exclusive. Matches are leftmost and non-overlapping for each rule.

Edge cases: a null text is the empty text; repeated rows and equal texts are one blob and each gets a row in the
report; an empty table gives an empty result; only the id and text columns are read, so other
columns cannot clash. A rule's failing matches (too short) still consume their text, as the base rules ask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.session import fresh, scratch_path


@dataclass(frozen=True)
class Rule:
    """``kind`` and ``version`` name the rule in the ledger; ``pattern`` is matched from the left.

    A match is a finding if its group ``group`` has at least ``least`` characters. ``hint`` is a
    literal that every match contains, to pass over most texts quickly; empty for none.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which spans at one start are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
# Further rules of the method, listed after the base rules.
MORE_RULES = (
    # A private key to its END line, or its header alone where there is none; version 1 took the header of every key.
    Rule("pem", 3, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[^-]*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----)?", 0, 1, "-----BEGIN "),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
)
RULES = BASE_RULES + MORE_RULES

# A private key: from BEGIN to END, or else to the last line of base64, after header fields if there are any. Line breaks may be written as escapes, as in JSON.
_BREAK = r"""(?:[\s"'+,>|]|\\[nrt])"""
PEM = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[^-]*+(?:-{1,4}+[^-]++)*+-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:(?:{_BREAK}*+[A-Za-z][A-Za-z-]*+: [^\n\\]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{32,}}+={{0,2}}+)++"
    rf"""(?:{_BREAK}++=?[A-Za-z0-9+/]{{1,63}}+={{0,2}}+(?=\s*(?:[\n"'\\]|$)))*+)?)"""
)
#: The rules of redaction. Their pem goes on to the last line of base64 where the END line is missing, which patterns without possessive parts and lookahead (those of the scan's SQL) can't say.
CURRENT_RULES = BASE_RULES + tuple(Rule("pem", 2, PEM, 0, 1, "-----BEGIN ") if r.kind == "pem" else r for r in MORE_RULES)

LEDGER = "blob string, scanned array<string>, findings array<struct<start:bigint,rule:string,stop:bigint>>"
#: Findings as reported: ``kind_no`` is the rule's place among those asked for.
FINDINGS = "array<struct<start:bigint,kind_no:int,stop:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """An array with, for each match, the gap before it, its length and whether it is a finding."""

    def entry(piece: Column, i: Column) -> Column:
        match = piece["m"]
        value = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        return F.struct(
            F.lit(number).alias("kind_no"),
            i.cast("int").alias("i"),
            F.length(piece["gap"]).cast("long").alias("gap"),
            F.length(match).cast("long").alias("len"),
            (F.length(value) >= rule.least).alias("ok"),
        )

    pieces = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m"),
    )
    return F.transform(F.filter(pieces, lambda p: p["m"].isNotNull()), entry)


def scan(versions: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that a run over ``versions`` adds; schema ``LEDGER``."""
    texts = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blobs = texts.dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("seen", F.expr("cast(array() as array<string>)"))
    else:
        seen = ledger.select("blob", F.explode("scanned").alias("s")).groupBy("blob").agg(F.collect_set("s").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.expr("cast(array() as array<string>)")))
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = blobs.withColumn("scanned", F.array_except(keys, "seen")).where(F.size("scanned") > 0)
    none = F.expr("cast(array() as array<struct<kind_no:int,i:int,gap:bigint,len:bigint,ok:boolean>>)")
    per_rule = []
    for number, rule in enumerate(rules):
        todo = F.array_contains("scanned", rule.key)
        if rule.hint:
            todo = todo & F.contains("text", F.lit(rule.hint))
        todo = todo & F.col("text").rlike(rule.pattern)
        per_rule.append(F.when(todo, _matches(F.col("text"), rule, number)).otherwise(none))
    # One row for each match, and one for a blob without any; offsets are running sums of gaps and lengths.
    matches = blobs.select("blob", "scanned", F.explode_outer(F.concat(*per_rule)).alias("x")).select("blob", "scanned", "x.*")
    before = Window.partitionBy("blob", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = matches.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(before))
    rule_key = F.element_at(keys, F.col("kind_no") + 1).alias("rule")
    finding = F.when(F.col("ok"), F.struct((F.col("stop") - F.col("len")).alias("start"), rule_key, "stop"))
    return placed.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.array_sort(F.collect_list(finding)).alias("findings"))


def report(versions: DataFrame, ledger: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols``, ``blob`` and all ``findings`` of ``known_findings``, for every row of ``versions``."""
    known = ledger.select("blob", "findings")
    paths = versions.select(*id_cols, blob_id(F.col(text_col)).alias("blob"))
    return paths.join(known, "blob", "left").select(*id_cols, "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings"))


def known_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES, one_row_each: bool = False) -> DataFrame:
    """``blob`` and its ``findings`` under the given rule versions, in order of start and rule; ``one_row_each`` if the ledger has one row for a blob."""
    if not one_row_each:
        ledger = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    asked = F.filter("findings", lambda f: F.array_contains(keys, f["rule"]))
    placed = F.transform(asked, lambda f: F.struct(f["start"].alias("start"), (F.array_position(keys, f["rule"]) - 1).cast("int").alias("kind_no"), f["stop"].alias("stop")))
    return ledger.select("blob", F.array_sort(placed).alias("findings"))


def scanned_ledger(versions: DataFrame, text_col: str = "text", ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it there, and return one row for each blob, as ``known_findings``.

    Without a path the ledger starts empty, in the shared folder. Pairs that two runs have scanned at a time count once.
    """
    spark = versions.sparkSession
    if ledger_path is None:
        path, old = scratch_path(spark, "ledger"), None
    else:
        path = ledger_path
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
        old = spark.read.schema(LEDGER).parquet(path)
    scan(versions, text_col, old, rules).write.mode("append").parquet(path)
    return known_findings(spark.read.schema(LEDGER).parquet(path), rules, one_row_each=old is None)


def _rendered(findings: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(findings, lambda f: F.concat(F.element_at(kinds, f["kind_no"] + 1), F.lit(":"), f["start"].cast("string"), F.lit(":"), f["stop"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest and spans for each row of ``docs``: the base rules must come first in ``rules``."""
    found = report(docs, scanned_ledger(docs, "text", ledger_path, rules), ["doc_id"])
    base = F.filter("findings", lambda f: f["kind_no"] < len(BASE_RULES))

    def count(number: int) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind_no"] == number)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(_rendered(base, rules), 256).alias("base_sha256"), _rendered(F.col("findings"), rules).alias("spans"))


def redact(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = CURRENT_RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; overlapping findings become one mark.

    No row goes. A text without findings is unchanged, a null text stays null.
    """
    blob, pieces, tail = fresh("blob", docs), fresh("pieces", docs), fresh("tail", docs)
    found = scanned_ledger(docs, "text", ledger_path, rules).select("blob", F.explode("findings").alias("f")).select("blob", "f.*")
    # A finding that starts after all before it have ended begins a mark; the text before the mark starts where the last of those ended.
    before = Window.partitionBy("blob").orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("at", F.coalesce(F.max("stop").over(before), F.lit(0)))
    piece = F.when(F.col("start") >= F.col("at"), F.struct("start", "at"))
    marks = placed.groupBy("blob").agg(F.array_sort(F.collect_list(piece)).alias(pieces), F.max("stop").alias(tail)).withColumnRenamed("blob", blob)
    rows = docs.withColumn(blob, blob_id(F.col("text"))).join(marks, blob, "left")
    kept = F.transform(pieces, lambda p: F.substring(F.col("text"), p["at"] + 1, p["start"] - p["at"]))
    rebuilt = F.array_join(F.concat(kept, F.array(F.substring(F.col("text"), F.col(tail) + 1, F.length("text")))), mark)
    text = F.when(F.col(pieces).isNull() | F.col("text").isNull(), F.col("text")).otherwise(rebuilt)
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
