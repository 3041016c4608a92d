"""Text and answer-metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.functions import metrics as M
from ragloom.functions import text as X
from ragloom.operators.ranks import ranked
from ragloom.tables import table


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id``, ``turn``, ``pred``, ``gold``: each assistant text, and the text of the turn before it."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("gold", F.lag("text").over(turns))
    return rows.where("role = 'assistant' and gold is not null").select("conv_id", "turn", F.col("text").alias("pred"), "gold")


def norm_answer_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", spread=True).select("doc_id", F.sha2(X.norm_core(F.col("text")), 256).alias("norm_sha256"))


def norm_answer_toolkit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.norm_toolkit(F.col("text")).alias("norm"))


def em_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = F.array("gold", F.substring_index("pred", " ", 3))
    return answer_pairs(spark, sf_dir).select(
        "conv_id", "turn", M.em(F.col("pred"), golds).alias("em"), F.round(M.f1(F.col("pred"), F.array("gold")), 9).alias("f1"), M.sub_em(F.col("pred"), golds).alias("acc")
    )


def toolkit_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.toolkit_scores(F.col("pred"), F.array("gold", F.substring_index("pred", " ", 5)))
    rows = answer_pairs(spark, sf_dir).select("conv_id", "turn", s.alias("s"))
    return rows.select("conv_id", "turn", *[F.round(f"s.{k}", 9).alias(k) for k in ("precision", "recall", "f1")])


def metric_registry_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus means of the registered metrics, against the turn before."""
    rows = answer_pairs(spark, sf_dir).select("pred", F.array("gold").alias("golden_answers"))
    out = M.evaluate(rows, ["em", "f1", "acc"])
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def answer_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer_pairs(spark, sf_dir)
    return rows.select("conv_id", "turn", F.round(M.answer_match(F.col("pred"), F.col("gold")), 9).alias("to_gold"), F.round(M.answer_match(F.col("pred"), F.substring_index("pred", " ", 2)), 9).alias("to_own"))


def rouge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answer_pairs(spark, sf_dir)
    return rows.select("conv_id", "turn", *[F.round(M.rouge_n(F.col("pred"), F.col("gold"), n), 9).alias(f"rouge{n}") for n in (1, 2)])


def mention_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.mentions(F.col("text"), 5), "|").alias("mentions"))


def mention_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.explode(X.mentions(F.col("text"))).alias("mention"))
    return found.groupBy("mention").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "mention").limit(50)


def question_entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(X.question_entities(F.col("text")), "|").alias("entities"))


def question_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.question_id(F.col("text"), "bench").alias("question_id"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.strip_html(F.col("html")), 256).alias("clean_sha256"))


def corpus_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages: title (first line, quotes off), contents = title, line feed, body; without an id they go."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    title, body = F.regexp_replace(X.title_of(F.col("text")), '^"+|"+$', ""), X.body_of(F.col("text"))
    return docs.select(F.col("doc_id").cast("string").alias("id"), title.alias("title"), F.sha2(F.concat(title, F.lit("\n"), body), 256).alias("contents_sha256"))


def passage_pool_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the benchmark as passages, each once (the first counts), with new ids in order of first sight."""
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.sentences(F.col("text"), 1)).alias("pos", "passage"))
    first = lines.groupBy("passage").agg(F.min(F.struct("item_id", "pos")).alias("at"))
    placed = ranked(first.select(F.lit(0).alias("all"), "passage", "at.item_id", "at.pos"), "all", [F.col("item_id").asc(), F.col("pos").asc()], "number")
    return placed.select((F.col("number") - 1).alias("id"), "passage")


def step_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reasoning traces: a ``[Step n]`` header for each turn, parsed back to rows."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    made = F.concat(F.lit("[Step "), (F.col("turn") + 1).cast("string"), F.lit("]\n"), F.col("text"), F.lit("\n"))
    traces = rows.select("conv_id", F.struct("turn", made.alias("s")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    trace = F.concat(F.array_join(F.transform("x", lambda x: x["s"]), ""), F.lit("[Final Answer] done\n"))
    found = traces.select("conv_id", F.explode(X.steps(trace)).alias("step"))
    return found.select("conv_id", F.col("step.index").cast("long").alias("step_index"), F.sha2("step.body", 256).alias("body_sha256"))


def trace_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of traces with a step header, with a final answer and with both, by role."""
    rows = table(spark, sf_dir, "conversations").withColumn("trace", F.concat(F.when(F.col("turn") % 2 == 0, "[Step 1]\n").otherwise(""), F.col("text"), F.when(F.col("turn") % 3 == 0, "\n[Final Answer] x").otherwise("")))
    has_step, has_final = F.size(X.steps(F.col("trace"))) > 0, X.final_answer(F.col("trace")).isNotNull()
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    return rows.groupBy("role").agg(rate(has_step).alias("step_rate"), rate(has_final).alias("final_rate"), rate(has_step & has_final).alias("both_rate"))


def prior_state_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn, how many earlier texts there are and the digest of them all, the state a step's label is decided on."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").where("text <> ''").withColumn("prior", F.collect_list("text").over(before))
    return rows.select("conv_id", "turn", F.size("prior").cast("long").alias("n_prior"), F.sha2(F.array_join("prior", "\n"), 256).alias("prior_sha256"))


def sentence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest sentences of each document, in the order of the text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", r"[.!?]\s+"), lambda s: F.length(s) > 5)).alias("pos", "sentence"))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("sentence").desc(), "pos"))).where("rank <= 3")
    return best.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " "), 256).alias("extract_sha256"))


def prompt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.head_and_tail(F.col("text"), 600), 256).alias("prompt_sha256"))


def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-typed JSON read with a path: how often each key occurs."""
    keys = table(spark, sf_dir, "events").select(F.explode(F.expr("json_object_keys(props)")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_answer_core, norm_answer_toolkit, em_f1_pairs, toolkit_pair_scores, metric_registry_means, answer_match_pairs, rouge_pairs, mention_extract, mention_freq, question_entity_extract,
        question_id_hash, html_clean, corpus_convert, passage_pool_dedup, step_parse, trace_rates, prior_state_window, sentence_topk, prompt_truncate, event_props_json,
    )
}

_WORD = r"[\p{L}\p{M}\p{N}_]"
_PUNCT = r"[!-/:-@\[-`{-~]"


def _squeeze(e: str) -> str:
    return rf"trim(regexp_replace({e}, '[\s\x0b\x1c-\x1f\x85\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+', ' ', 'g'))"


def _articles(e: str) -> str:
    one = rf"(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{M}}\p{{N}}_]|$)"
    return rf"regexp_replace(regexp_replace({e}, '{one}', '\1 \2', 'g'), '{one}', '\1 \2', 'g')"


def _core(e: str) -> str:
    return _squeeze(f"regexp_replace({_articles(f'lower({e})')}, '{_PUNCT}', '', 'g')")


def _toolkit(e: str) -> str:
    return _squeeze(_articles(f"regexp_replace(lower({e}), '{_PUNCT}', '', 'g')"))


def _tokens(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: w <> '')"


_PAIRS = """pairs as (
  select conv_id, turn, text as pred, gold from (
    select *, lag(text) over (partition by conv_id order by turn) as gold from conversations) where role = 'assistant' and gold is not null)"""
_MACROS_SAME = "list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w)))))"
_F1 = f"""case when coalesce({_MACROS_SAME}, 0) = 0 then 0.0::double else
  2 * ({_MACROS_SAME}::double / len(p)) * ({_MACROS_SAME}::double / len(g)) / ({_MACROS_SAME}::double / len(p) + {_MACROS_SAME}::double / len(g)) end"""
_FIRST = lambda n: f"array_to_string(string_split(pred, ' ')[1:{n}], ' ')"
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
_MENTIONS = rf"list_filter(regexp_extract_all({_ASCII}, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,3}})\b', 1), lambda m: lower(m) not in ({', '.join(repr(w) for w in X.MENTION_STOP)}) and length(m) >= 3)"
_DISTINCT = lambda e: f"list_filter({e}, lambda m, i: list_position({e}, m) = i)"

ORACLE_SQL = {
    "passage_pool_dedup": r"""
with p as (select item_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as p from benchmark),
s as (select item_id, unnest(range(len(p))) as pos, unnest(p) as passage from p),
f as (select passage, min((item_id, pos)) as place from s where length(passage) >= 1 group by passage)
select row_number() over (order by place) - 1 as id, passage from f""",

    "norm_answer_core": f"select doc_id, sha256({_core('text')}) as norm_sha256 from documents",
    "norm_answer_toolkit": f"select item_id, {_toolkit('text')} as norm from benchmark",
    "em_f1_pairs": f"""with {_PAIRS},
n as (select conv_id, turn, {_core('pred')} as np, {_core('gold')} as ng, {_core(_FIRST(3))} as n3, {_toolkit('pred')} as tp, {_toolkit('gold')} as tg, {_toolkit(_FIRST(3))} as t3 from pairs),
t as (select *, {_tokens('np')} as p, {_tokens('ng')} as g from n)
select conv_id, turn, (np = ng or np = n3)::int::double as em, round({_F1}, 9) as f1, (contains(tp, tg) or contains(tp, t3))::int::double as acc from t""",
    "toolkit_pair_scores": f"""with {_PAIRS},
golds as (select conv_id, turn, {_toolkit('pred')} as np, {_toolkit('gold')} as ng from pairs union all select conv_id, turn, {_toolkit('pred')}, {_toolkit(_FIRST(5))} from pairs),
t as (select *, {_tokens('np')} as p, {_tokens('ng')} as g from golds),
s as (select *, case when (np in ('yes', 'no', 'noanswer') or ng in ('yes', 'no', 'noanswer')) and np <> ng then 0 else coalesce({_MACROS_SAME}, 0) end::double as same from t)
select conv_id, turn, round(max(case when same = 0 then 0.0::double else same / len(p) end), 9) as precision, round(max(case when same = 0 then 0.0::double else same / len(g) end), 9) as recall,
  round(max(case when same = 0 then 0.0::double else 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) end), 9) as f1
from s group by conv_id, turn""",
    "metric_registry_means": f"""with {_PAIRS},
n as (select {_core('pred')} as np, {_core('gold')} as ng, {_toolkit('pred')} as tp, {_toolkit('gold')} as tg from pairs),
t as (select *, {_tokens('np')} as p, {_tokens('ng')} as g from n)
select round(avg((np = ng)::int::double), 9) as em, round(avg({_F1}), 9) as f1, round(avg(contains(tp, tg)::int::double), 9) as acc from t""",
    "rouge_pairs": f"""with {_PAIRS},
w as (select conv_id, turn, regexp_extract_all(lower(pred), '[a-z0-9]+') as a, regexp_extract_all(lower(gold), '[a-z0-9]+') as b from pairs),
g1 as (select conv_id, turn, a as p, b as g from w),
g2 as (select conv_id, turn, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) as p, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) as g from w),
s1 as (select conv_id, turn, case when coalesce({_MACROS_SAME}, 0) = 0 then 0.0::double else 2 * {_MACROS_SAME}::double / (len(p) + len(g)) end as s from g1),
s2 as (select conv_id, turn, case when coalesce({_MACROS_SAME}, 0) = 0 then 0.0::double else 2 * {_MACROS_SAME}::double / (len(p) + len(g)) end as s from g2)
select conv_id, turn, round(s1.s, 9) as rouge1, round(s2.s, 9) as rouge2 from s1 join s2 using (conv_id, turn)""",
    "mention_extract": f"select doc_id, array_to_string(({_DISTINCT(_MENTIONS)})[1:5], '|') as mentions from documents",
    "mention_freq": f"select mention, count(*) as n from (select unnest(list_distinct({_MENTIONS})) as mention from documents) group by mention order by n desc, mention limit 50",
    "question_entity_extract": rf"""
with e as (select conv_id, turn, list_filter(regexp_extract_all({_ASCII}, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,4}})\b', 1), lambda m: lower(m) not in ({', '.join(repr(w) for w in X.ENTITY_STOP)})) as x
  from conversations where role = 'user')
select conv_id, turn, array_to_string(list_filter(x, lambda m, i: list_position(list_transform(x, lambda y: lower(y)), lower(m)) = i), '|') as entities from e""",
    "question_id_hash": r"select item_id, 'bench_' || sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')))[1:12] as question_id from benchmark",
    "html_clean": f"select page_id, sha256({_squeeze(chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))}) as clean_sha256 from pages",
    "corpus_convert": """
with t as (select doc_id, text, string_split(text, chr(10))[1] as first from documents where doc_id is not null and text is not null),
u as (select *, regexp_replace(first, '^"+|"+$', '', 'g') as title, text[length(first) + 2:] as body from t)
select doc_id::varchar as id, title, sha256(title || chr(10) || body) as contents_sha256 from u""",
    "step_parse": r"""
with t as (select conv_id, string_agg('[Step ' || (turn + 1) || ']' || chr(10) || text || chr(10), '' order by turn) || '[Final Answer] done' || chr(10) as trace from conversations where text is not null group by conv_id),
s as (select conv_id, unnest(regexp_extract_all(trace, '\[Step (\d+)\]', 1)) as step_index, unnest((string_split_regex(string_split(trace, '[Final Answer]')[1], '\[Step \d+\]'))[2:]) as body from t)
select conv_id, step_index::bigint as step_index, sha256(regexp_replace(body, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) as body_sha256 from s""",
    "trace_rates": """
select role, round(avg((turn % 2 = 0)::int::double), 9) as step_rate, round(avg((turn % 3 = 0)::int::double), 9) as final_rate, round(avg((turn % 6 = 0)::int::double), 9) as both_rate
from conversations where text is not null group by role""",
    "prior_state_window": """
select conv_id, turn, coalesce(len(prior), 0) as n_prior, sha256(coalesce(array_to_string(prior, chr(10)), '')) as prior_sha256
from (select conv_id, turn, list(text) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as prior from conversations where text <> '')""",
    "sentence_topk": r"""
with s as (select doc_id, unnest(x) as sentence, unnest(range(len(x))) as pos from (select doc_id, list_filter(string_split_regex(text, '[.!?]\s+'), lambda s: length(s) > 5) as x from documents)),
r as (select *, row_number() over (partition by doc_id order by length(sentence) desc, pos) as rank from s)
select doc_id, sha256(string_agg(sentence, ' ' order by pos)) as extract_sha256 from r where rank <= 3 group by doc_id""",
    "prompt_truncate": "select doc_id, sha256(case when length(text) <= 600 then text else text[1:300] || text[-300:] end) as prompt_sha256 from documents",
    "event_props_json": "select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key",
}
