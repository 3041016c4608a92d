"""Queries of prompt budgets, training rows and replay, with their SQL: conversations are the questions with their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators import budget as B
from ragloom.operators import replay as P
from ragloom.tables import table

#: Sentences with the white space after them: the pieces make up the text again.
PIECES = r"[^.!?]*[.!?]+[ \t\n\r\f]*|[^.!?]+"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("i"), F.coalesce("text", F.lit("")).alias("text"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("key", "i", F.floor(F.length("text") / 4).alias("tokens"), ((F.col("i") * 7 + F.col("key")) % 5).alias("value"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the turns are forced in; the best stand at both ends."""
    out = B.context_budget(_contexts(spark, sf_dir), 60, forced=(F.col("key") + F.col("i")) % 5 == 0, order="two_stage", ratio=0.5)
    return out.select("key", "i", "out", F.round("ratio", 9).alias("ratio"))


def context_budget_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No context that exceeds the budget, in the order of the conversation."""
    return B.context_budget(_contexts(spark, sf_dir), 150, slack=0, strict=True).select("key", "i", "out")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select("key", "i", F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("s", "sentence"))
    return rows.withColumn("tokens", F.length("sentence")).withColumn("value", ((F.col("tokens") * 7 + F.col("s") + F.col("i")) % 13).cast("double"))


def sentence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = B.sentence_budget(_sentences(spark, sf_dir), 200, keep_first=1, keep_last=1, keep_each=1)
    return B.joined_sentences(kept).select("key", "i", F.sha2("compressed", 256).alias("compressed_sha256"))


def two_level_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under a strict budget of tokens, then their sentences under a strict one of characters, with the first and the last kept."""
    turns = context_budget_strict(spark, sf_dir).select("key", "i")
    kept = B.sentence_budget(_sentences(spark, sf_dir).join(turns, ["key", "i"], "left_semi"), 300, keep_first=1, keep_last=1, share=1.0, strict=True)
    return B.joined_sentences(kept).select("key", "i", F.sha2("compressed", 256).alias("compressed_sha256"), F.length("compressed").cast("long").alias("n_chars"))


def code_points(text: Column) -> Column:
    """A tokenizer that SQL has too: a token for each character."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns in order."""
    return _turns(spark, sf_dir).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("turns"))


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn is the question, the last the answer, those between are passages."""
    rows = _conversations(spark, sf_dir)
    items = rows.select("key", F.lit("Passages:\n").alias("head"), F.concat(F.lit("\nQuestion: "), F.element_at("turns", 1), F.lit("\n")).alias("tail"), F.element_at("turns", -1).alias("answer"))
    passages = rows.select("key", F.posexplode("turns").alias("rank", "text"), F.size("turns").alias("n")).where("rank > 0 and rank < n - 1").select("key", "rank", "text")
    out = B.sft_rows(items, passages, code_points, 1000)
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256)
    return out.select("key", digest("input_ids").alias("ids_sha256"), digest("labels").alias("labels_sha256"), F.size("input_ids").alias("n_ids"), "prompt_length", "n_passages", "n_dropped")


def anchor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _conversations(spark, sf_dir).select("key", F.element_at("turns", 1).alias("prompt"), F.element_at("turns", -1).alias("answer"))
    out = B.anchor_rows(items, code_points, 100, 200)
    return out.select("key", F.size("input_ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x == B.IGNORED)).alias("n_ignored"), F.sha2(F.array_join(F.transform("labels", lambda x: x.cast("string")), ","), 256).alias("labels_sha256"))


def replay_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    explore = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    return P.replay_mix(explore, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key")), batches=200, size=32, ratio=0.3, seed=5)


def with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws from the parts as there are parts."""
    rows = table(spark, sf_dir, "part")
    return P.drawn(rows.select("p_partkey", "p_name"), rows.count(), 9, "p_partkey")


QUERIES = {f.__name__: f for f in (context_budget, context_budget_strict, sentence_budget, two_level_budget, sft_rows, anchor_rows, replay_mix, with_replacement)}

_TURNS = "turns as (select conv_id as key, turn as i, coalesce(text, '') as text from conversations)"
_SENTENCES = rf"""
pieces as (select key, i, regexp_extract_all(text, '{PIECES}') as p from turns),
sentences as (select key, i, sentence, s - 1 as s, length(sentence) as tokens, ((length(sentence) * 7 + s - 1 + i) % 13)::double as value
  from (select key, i, unnest(p) as sentence, unnest(range(1, len(p) + 1)) as s from pieces))"""
_STRICT = """
strict as (select key, i, row_number() over (partition by key order by i)::int as out from (
  select key, i, sum(length(text) // 4) over (partition by key order by (i * 7 + key) % 5, i) as spent from turns) where spent <= 150)"""
_IDS = "list_transform(list_filter(string_split({}, ''), lambda c: c <> ''), lambda c: unicode(c))"
_LISTED = "listed as (select key, list(text order by i) as t from turns group by key)"


def _draw(seed: int, *parts: str) -> str:
    joined = " || ':' || ".join(f"({p})::varchar" for p in parts)
    return f"('0x' || sha256('{seed}:' || {joined})[1:15])::bigint"


ORACLE_SQL = {
    "context_budget": f"""
with {_TURNS},
ranked as (select key, i, length(text) // 4 as tokens, (i * 7 + key) % 5 as value, (key + i) % 5 = 0 as forced from turns),
spent as (select *, coalesce(sum(tokens) over (partition by key order by value, i rows between unbounded preceding and 1 preceding), 0) as before from ranked),
used as (select *, row_number() over (partition by key order by not forced, case when forced then i end, value, i) - 1 as p, count(*) over (partition by key) - 1 as l from spent where before <= 160 or forced)
select key, i, row_number() over (partition by key order by p % 2, case when p % 2 = 0 then p else -p end)::int as out, round(case when l > 0 then (l - 2 * p) * 0.5::double / l else 0.0 end, 9) as ratio from used""",
    "context_budget_strict": f"with {_TURNS}, {_STRICT} select key, i, out from strict",
    "sentence_budget": f"""
with {_TURNS}, {_SENTENCES},
placed as (select *, row_number() over (partition by key order by i, s) as nr, count(*) over (partition by key) as n from sentences),
ends as (select *, value + case when nr = 1 then 100.0 else 0.0 end + case when nr = n then 100.0 else 0.0 end as worth from placed),
each as (select *, worth + case when row_number() over (partition by key, i order by worth, nr) = 1 then 100.0 else 0.0 end as w from ends),
spent as (select *, coalesce(sum(tokens) over (partition by key order by w desc, nr rows between unbounded preceding and 1 preceding), 0) as before from each)
select key, i, sha256(string_agg(sentence, '' order by s)) as compressed_sha256 from spent where before <= 200 * 1.4::double or n = 1 group by key, i""",
    "two_level_budget": f"""
with {_TURNS}, {_SENTENCES}, {_STRICT},
placed as (select s.*, row_number() over (partition by key order by i, s.s) as nr, count(*) over (partition by key) as n from sentences s semi join strict using (key, i)),
ends as (select *, value + case when nr = 1 then 100.0 else 0.0 end + case when nr = n then 100.0 else 0.0 end as worth from placed),
spent as (select *, sum(tokens) over (partition by key order by worth desc, nr) as upto from ends)
select key, i, sha256(string_agg(sentence, '' order by s)) as compressed_sha256, sum(tokens)::bigint as n_chars from spent where upto <= 300 or n = 1 or nr = 1 or nr = n group by key, i""",
    "sft_rows": f"""
with {_TURNS}, {_LISTED},
items as (select key, t, 'Passages:' || chr(10) as head, chr(10) || 'Question: ' || t[1] || chr(10) as tail, t[-1] as answer from listed where len(t[-1]) > 0),
room as (select *, 1000 - len(head) - len(tail) - len(answer) as room from items),
passages as (select key, unnest(t[2:len(t) - 1]) as text, unnest(range(1, greatest(len(t) - 1, 1))) as rank from listed where len(t) > 2),
summed as (select key, rank, text, sum(length(text)) over (partition by key order by rank) as s from passages where rank <= 15),
kept as (select r.key, count(s.rank) as found, count(s.rank) filter (s.s <= room) as fits, coalesce(string_agg(s.text, '' order by s.rank) filter (s.s <= room), '') as body from room r left join summed s using (key) where room >= 0 group by r.key),
prompts as (select key, head || body || tail as prompt, answer, found, fits from kept join room using (key))
select key, sha256(array_to_string({_IDS.format("prompt || answer")}, ',')) as ids_sha256,
  sha256(array_to_string(list_concat(list_transform({_IDS.format("prompt")}, lambda x: -100), {_IDS.format("answer")}), ',')) as labels_sha256,
  (length(prompt) + length(answer))::int as n_ids, length(prompt)::int as prompt_length, fits::int as n_passages, (found - fits)::int as n_dropped from prompts""",
    "anchor_rows": f"""
with {_TURNS}, {_LISTED},
cut as (select key, t[1] as prompt, (t[1] || t[-1])[1:300] as whole from listed where trim(t[-1]) <> '')
select key, length(whole)::int as n_ids, least(length(prompt), 100)::int as n_ignored,
  sha256(array_to_string(list_concat(list_transform(range(least(length(prompt), 100)), lambda x: -100), {_IDS.format("whole[least(length(prompt), 100) + 1:]")}), ',')) as labels_sha256 from cut""",
    "replay_mix": f"""
with slots as (select (id // 32)::bigint as batch, (id % 32)::bigint as slot, case when id % 32 < 23 then 'explore' else 'replay' end as kind from range(6400) as r(id)),
new as (select doc_id as key, row_number() over (order by doc_id) - 1 as number from documents), old as (select item_id as key, row_number() over (order by item_id) - 1 as number from benchmark),
drawn as (select *, {_draw(5, "kind", "batch", "slot")} % (case kind when 'explore' then (select count(*) from documents) else (select count(*) from benchmark) end) as number from slots)
select batch, slot, kind, key from drawn join new using (number) where kind = 'explore' union all select batch, slot, kind, key from drawn join old using (number) where kind = 'replay'""",
    "with_replacement": f"""
with hits as (select {_draw(9, "id")} % (select count(*) from part) as number, count(*) as copies from (select unnest(range((select count(*) from part))) as id) group by 1)
select p_partkey, p_name, copies from hits join (select p_partkey, p_name, row_number() over (order by p_partkey) - 1 as number from part) using (number)""",
}
