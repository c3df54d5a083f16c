"""Registered queries of reading and of what is written and read back, over conversations, documents and embeddings."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..functions import text as tx
from ..operators import asked, benchmark, evalset, factbase, reader, thresholds
from ..operators.settle import settle, shared_dir
from ..sources import store
from . import sql
from .calibration_queries import S, scored
from .registry import register


def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _answered(turns):
    """A turn as a reference, the next turn of the conversation as an answer to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("said", F.lead("text").over(w)).where("said IS NOT NULL")


# ---- key facts ---------------------------------------------------------------

_EDGE = "[^\\p{L}\\p{N}@\\-\\s]"


def facts_sql(text: str) -> str:
    """Key facts of a text, for texts whose numbers stand alone between white space and punctuation."""
    return rf"""list_distinct(list_concat(
  list_transform(list_filter(regexp_split_to_array({text}, '[^\w@.%\-]+'), lambda x: regexp_full_match(x, '[0-9]+(\.[0-9]+)?(e-?[0-9]+)?%?\.*')), lambda x: rtrim(x, '.')),
  list_filter(list_transform(list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^{_EDGE}+', ''), '{_EDGE}+$', '')),
    lambda x: x <> '' AND (regexp_matches(x, '^.+\p{{Lu}}') OR contains(x, '@') OR (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}') AND length(x) > 1)))))"""


# turns hold no numbers: a remark made from the ids of each is put behind it
_NOTED = "text || ' (' || turn || '.5 of ' || conv_id || '%, by pts@' || turn || ') at NASA, nr' || turn || ', ' || conv_id || 'e-' || turn || '.'"


def _noted(spark, sf_dir):
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    return conversations(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" ("), turn, F.lit(".5 of "), conv, F.lit("%, by pts@"), turn, F.lit(") at NASA, nr"), turn, F.lit(", "), conv, F.lit("e-"), turn, F.lit(".")))


@register("key_facts", f"SELECT conv_id, turn, len(f)::INT AS n, md5(array_to_string(list_sort(f), '|')) AS digest FROM (SELECT conv_id, turn, {facts_sql('text')} AS f FROM (SELECT conv_id, turn, {_NOTED} AS text FROM conversations))")
def key_facts(spark, sf_dir):
    """Numbers and entity-like tokens of every turn and of a remark with its ids."""
    rows = _noted(spark, sf_dir).select("conv_id", "turn", tx.key_facts(F.col("text")).alias("f"))
    return rows.select("conv_id", "turn", F.size("f").alias("n"), F.md5(F.array_join(F.array_sort("f"), "|")).alias("digest"))


_TOKENS = lambda c: f"list_filter(string_split({sql.answer(c)}, ' '), lambda x: x <> '')"


@register(
    "correct_answers",
    f"""WITH noted AS (SELECT conv_id, turn, {_NOTED} AS text FROM conversations), t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM noted),
cases AS (SELECT conv_id, turn, 'next turn' AS kind, said, text FROM t WHERE said IS NOT NULL UNION ALL SELECT conv_id, turn, 'itself', text, text FROM t UNION ALL SELECT conv_id, turn, 'its second half', substr(text, length(text) // 2 + 1), text FROM t),
a AS (SELECT *, {_TOKENS('said')} AS p, {_TOKENS('text')} AS r, {facts_sql('text')} AS f FROM cases),
pc AS (SELECT conv_id, turn, kind, w, count(*) AS c FROM (SELECT *, unnest(p) AS w FROM a) GROUP BY ALL), rc AS (SELECT conv_id, turn, kind, w, count(*) AS c FROM (SELECT *, unnest(r) AS w FROM a) GROUP BY ALL),
m AS (SELECT conv_id, turn, kind, sum(least(pc.c, rc.c)) AS k FROM pc JOIN rc USING (conv_id, turn, kind, w) GROUP BY ALL),
missing AS (SELECT DISTINCT conv_id, turn, kind FROM (SELECT conv_id, turn, kind, p, unnest(f) AS fact FROM a) WHERE NOT list_has_all(p, {_TOKENS('fact')}))
SELECT conv_id, turn, kind, (CASE WHEN len(p) = 0 OR len(r) = 0 THEN len(p) = len(r) ELSE 2.0::DOUBLE * coalesce(k, 0) / (len(p) + len(r)) >= 0.5 END) AND gone IS NULL AS correct
FROM a LEFT JOIN m USING (conv_id, turn, kind) LEFT JOIN (SELECT conv_id, turn, kind, true AS gone FROM missing) USING (conv_id, turn, kind)""",
)
def correct_answers(spark, sf_dir):
    """Whether the next turn, the turn itself, and its second half answer a turn: half the tokens by F1, and every key fact."""
    c = _noted(spark, sf_dir)
    half = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.length("text"))
    rows = _answered(c).select("conv_id", "turn", F.lit("next turn").alias("kind"), "said", "text")
    rows = rows.unionByName(c.select("conv_id", "turn", F.lit("itself").alias("kind"), F.col("text").alias("said"), "text"))
    rows = rows.unionByName(c.select("conv_id", "turn", F.lit("its second half").alias("kind"), half.alias("said"), "text"))
    return rows.select("conv_id", "turn", "kind", tx.is_correct(F.col("said"), F.col("text")).alias("correct"))


# ---- the reader --------------------------------------------------------------

_CORE = "trim(w, ',;:()')"


def _span_sql(pairs: str, key: str) -> str:
    """CTEs that end in `typed` (key, span): typed answers from sentences, for a table of key, question, sentence."""
    return f"""bare AS (SELECT {key}, {sql.tokens('question')} AS asked, rtrim(sentence, '.!?') AS bare FROM {pairs}),
word AS (SELECT {key}, asked, w, i, list_filter(regexp_split_to_array(bare, '\\s+'), lambda x: x <> '') AS every FROM (SELECT *, list_filter(regexp_split_to_array(bare, '\\s+'), lambda x: x <> '') AS ws FROM bare), unnest(ws) WITH ORDINALITY AS u(w, i)),
core AS (SELECT {key}, asked, every, i, {_CORE} AS core, list_intersect({sql.tokens('w')}, asked) AS terms FROM word),
term AS (SELECT {key}, i AS at, unnest(terms) AS term FROM core),
kinds AS (SELECT *, regexp_full_match(core, '[0-9]+(\\.[0-9]+)?(e-?[0-9]+)?%?') AS number,
  (regexp_matches(core, '^.+\\p{{Lu}}') OR (regexp_matches(core, '\\p{{Lu}}') AND (i > 1 OR (length(core) > 1 AND NOT regexp_matches(core, '\\p{{Ll}}'))))) AND len(list_intersect({sql.tokens('core')}, asked)) = 0 AS name FROM core),
near AS (SELECT k.{key}, k.i, k.core, k.every, k.number, count(DISTINCT t.term) AS shared FROM kinds k LEFT JOIN term t ON t.{key} = k.{key} AND t.at BETWEEN k.i - 4 AND k.i + 3 WHERE number OR name GROUP BY ALL),
first AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY shared DESC, number DESC, i) = 1),
typed AS (SELECT b.{key}, CASE WHEN f.i IS NULL THEN bare WHEN number THEN trim(array_to_string(every[greatest(1, f.i - 3) : f.i + 2], ' '), ',;:()') ELSE core END AS span FROM bare b LEFT JOIN first f USING ({key}))"""


_PARTS = r"""list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '[\x01\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"""
_READ = f"""WITH top AS (SELECT conv_id AS query_id, arg_max(text, turn) AS query, max(turn) AS last FROM conversations GROUP BY conv_id),
sents AS (SELECT conv_id AS query_id, conv_id * 1000000 + turn * 1000 + i AS pos, conv_id || '/' || turn AS chunk_id, s AS sentence FROM (SELECT conv_id, turn, {_PARTS} AS ss FROM conversations c WHERE turn < (SELECT last FROM top WHERE query_id = c.conv_id)), unnest(ss) WITH ORDINALITY AS u(s, i)),
qt AS (SELECT query_id, {sql.tokens('query')} AS t FROM top WHERE trim(query) <> ''), dt AS (SELECT pos, {sql.tokens('sentence')} AS t FROM sents), fused AS (SELECT query_id, pos, 1 AS rank FROM sents),
{sql.FEATURES},
best AS (SELECT r.query_id, s.chunk_id, s.sentence FROM scored r JOIN sents s USING (query_id, pos) QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY round(logit, 12) DESC, pos) = 1),
asks AS (SELECT query_id, term, idf FROM idf WHERE NOT list_contains([{', '.join(f"'{w}'" for w in tx.QUESTION_ONLY)}], term)),
has AS (SELECT DISTINCT query_id, unnest({sql.tokens('sentence')}) AS word FROM best),
met AS (SELECT a.query_id, a.term, max(CASE WHEN a.term = h.word THEN 1 WHEN c.sim >= 0.5 THEN c.sim ELSE 0 END) AS sim FROM asks a JOIN has h USING (query_id) LEFT JOIN close c ON c.term = a.term AND c.other = h.word GROUP BY ALL),
cover AS (SELECT query_id, coalesce(sum(idf * coalesce(sim, 0)) / nullif(sum(idf), 0), 0) AS coverage FROM best LEFT JOIN asks USING (query_id) LEFT JOIN met USING (query_id, term) GROUP BY query_id),
qs AS (SELECT query_id, query AS question, sentence FROM best JOIN top USING (query_id)),
{_span_sql('qs', 'query_id')},
modes AS (SELECT unnest([false, true]) AS forced),
says AS (SELECT t.query_id, forced, b.query_id IS NOT NULL AND (forced OR coverage >= 0.35) AS says, b.query_id IS NOT NULL AS found, chunk_id, sentence, span, coverage FROM top t CROSS JOIN modes LEFT JOIN best b USING (query_id) LEFT JOIN cover USING (query_id) LEFT JOIN typed USING (query_id))"""


@register(
    "read_conversations",
    f"""{_READ} SELECT query_id AS conv_id, forced, NOT says AND NOT forced AS abstain, md5(CASE WHEN says THEN span WHEN forced THEN '' ELSE '{tx.ABSTENTION.replace("'", "''")}' END) AS answer, CASE WHEN says THEN chunk_id ELSE '' END AS citation, md5(CASE WHEN says THEN sentence ELSE '' END) AS quote,
CASE WHEN NOT found THEN 'no_context' WHEN NOT says THEN printf('low_support(coverage=%.2f)', coverage) END AS reason FROM says""",
)
def read_conversations(spark, sf_dir):
    """The last turn of every conversation asked of the turns before it: best sentence, span, or an abstention; free and forced."""
    c = conversations(spark, sf_dir)
    asks = settle(c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("last")))
    q = asks.select(F.col("conv_id").alias("query_id"), "text")
    context = settle(c.join(asks.select("conv_id", "last"), "conv_id").where("turn < last").select(F.col("conv_id").alias("query_id"), F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.col("turn").cast("int").alias("rank"), "text"))
    both = reader.extractive(context, q, forced=None)
    only = lambda values: F.coalesce(F.get(values, 0), F.lit(""))
    return both.select(F.col("query_id").alias("conv_id"), "forced", "abstain", F.md5("answer").alias("answer"), only(F.col("citations")).alias("citation"), F.md5(only(F.col("evidence_quotes"))).alias("quote"), "reason")


_QA = f"pairs AS (SELECT conv_id * 1000 + turn AS id, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS sentence FROM (SELECT conv_id, turn, {_NOTED} AS text FROM conversations))"


@register("typed_spans", f"WITH {_QA}, said AS (SELECT * FROM pairs WHERE sentence IS NOT NULL), {_span_sql('said', 'id')} SELECT id, md5(span) AS span FROM typed")
def typed_spans(spark, sf_dir):
    """The span of every turn that answers the turn before it: words around a number, or a name, by what they share with the question."""
    rows = _answered(_noted(spark, sf_dir)).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.col("said").alias("sentence"))
    return rows.select("id", F.md5(reader.span_of(F.col("question"), F.col("sentence"))).alias("span"))


# ---- replies -----------------------------------------------------------------


@register("json_replies", "SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN NULL ELSE md5(text) END AS answer FROM conversations")
def json_replies(spark, sf_dir):
    """The first JSON object in free text: turns as fields of replies, among prose, other values and broken objects."""

    @F.pandas_udf(StringType())
    def answer(replies: pd.Series) -> pd.Series:
        def one(t):
            try:
                return reader.first_json(t).get("answer")
            except ValueError:
                return None

        return replies.map(one)

    own = F.to_json(F.struct(F.col("text").alias("answer"), "turn"))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure: "), own, F.lit(' and {"answer": "another"}'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('[1, 2] {"x": } '), own)).otherwise(F.lit("none at all {"))
    return conversations(spark, sf_dir).select("conv_id", "turn", F.md5(answer(reply)).alias("answer"))


@register("reply_schemas", "SELECT conv_id, turn, turn % 4 IN (0, 1, 2) AND (turn % 4 < 2 OR conv_id % 2 = 0) AS sound FROM conversations")
def reply_schemas(spark, sf_dir):
    """Replies made of turns against the fields their kind must have: whole ones, a list that is text, a field that lacks."""

    @F.pandas_udf(BooleanType())
    def sound(kinds: pd.Series, replies: pd.Series) -> pd.Series:
        def one(kind, t):
            try:
                return bool(asked.parsed(t, kind))
            except ValueError:
                return False

        return pd.Series([one(k, t) for k, t in zip(kinds, replies, strict=True)])

    t, k = F.col("text"), F.col("turn") % 4
    quotes = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(t.alias("question"), t.alias("answer"), F.array(t, t).alias("evidence_quotes")))).otherwise(F.to_json(F.struct(t.alias("question"), t.alias("answer"), t.alias("evidence_quotes"))))
    reply = F.when(k == 0, F.to_json(F.struct(t.alias("question"), t.alias("answer"), t.alias("evidence_quote")))).when(k == 1, F.to_json(F.struct(F.lit(True).alias("answerable"), t.alias("rationale")))).when(k == 2, quotes).otherwise(F.to_json(F.struct(t.alias("contradicted_claim"))))
    kind = F.get(F.array(*map(F.lit, ["factoid", "judgement", "reasoning", "question"])), k.cast("int"))
    return conversations(spark, sf_dir).select("conv_id", "turn", sound(kind, reply).alias("sound"))


# ---- made-up reports, one for each document ------------------------------------


def _pick(n: int, *slot: str) -> str:
    return f"(('0x' || substr(md5('42/' || {' || chr(47) || '.join(slot)}), 1, 8))::BIGINT % {n})"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FACT_ROWS = f"""r AS (SELECT doc_id AS d FROM documents),
b AS (SELECT d, printf('report-%04d', d) AS doc_id, {_list(factbase.HEADS)}[{_pick(len(factbase.HEADS), 'd', "'head'")} + 1] || {_list(factbase.TAILS)}[{_pick(len(factbase.TAILS), 'd', "'tail'")} + 1] || '-' || d AS name FROM r),
k AS (SELECT b.*, k, {_list(factbase.BASINS)}[({_pick(len(factbase.BASINS), 'd', "'first'")} + k * ({_pick(len(factbase.BASINS) - 1, 'd', "'step'")} + 1)) % {len(factbase.BASINS)} + 1] AS basin, {_pick(470, 'd', "'ours'", 'k')} + 450 AS ours, {_pick(83, 'd', "'gap'", 'k')} + 12 AS gap,
  {_list(factbase.RIVALS)}[{_pick(len(factbase.RIVALS), 'd', "'rival'", 'k')} + 1] AS rival, {_list(factbase.UNITS)}[{_pick(len(factbase.UNITS), 'd', "'unit'")} + 1] AS unit FROM b, (SELECT unnest(generate_series(0, {factbase.N_BASINS - 1})) AS k))"""


def facts(spark, sf_dir):
    return factbase.fact_table(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


@register("report_facts", f"WITH {FACT_ROWS} SELECT doc_id, name, (3 + 3 * k)::INT AS fact, basin, unit, ours::INT AS value FROM k")
def report_facts(spark, sf_dir):
    """The results in the table that a report on every document is written from."""
    return facts(spark, sf_dir).where("kind = 'result'").select("doc_id", "name", "fact", "basin", "unit", "value")


@register("report_gaps", f"WITH {FACT_ROWS} SELECT doc_id, basin, rival, ours::INT AS ours, (ours - gap)::INT AS theirs FROM k")
def report_gaps(spark, sf_dir):
    """Results beside the baseline of the same report and basin."""
    return factbase.gaps(facts(spark, sf_dir)).select("doc_id", "basin", "rival", "ours", "theirs")


@register("report_spans", f"WITH {FACT_ROWS} SELECT doc_id, {3 + 3 * factbase.N_BASINS}::INT AS n, true AS exact FROM b")
def report_spans(spark, sf_dir):
    """Every fact's sentence stands in the text of its report exactly where its span says."""
    table = facts(spark, sf_dir)
    at = factbase.reports(table).select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", "text", "s.*")
    same = at.join(table.select("doc_id", "fact", "sentence"), ["doc_id", "fact"]).withColumn("same", F.substring("text", F.col("a") + 1, F.col("z") - F.col("a")) == F.col("sentence"))
    return same.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.bool_and("same").alias("exact"))


# ---- files -------------------------------------------------------------------


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("stored_vectors", "SELECT vec_id AS pos, len(embedding)::INT AS dims, md5(array_to_string(list_transform(embedding, lambda x: printf('%.6f', x)), ',')) AS digest FROM embeddings")
def stored_vectors(spark, sf_dir):
    """Vectors through the index file and back, with their number and dimension held against what was written."""
    path = _place(spark, "vectors")
    store.write_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vec")), path)
    # single-precision numbers times a million are exact, so halves go to the even digit, as C rounds them; Java alone rounds them up
    digits = F.transform("vec", lambda x: F.format_string("%.6f", F.rint(x.cast("double") * 1e6) / 1e6))
    return store.read_vectors(spark, path).select("pos", F.size("vec").alias("dims"), F.md5(F.array_join(digits, ",")).alias("digest"))


@register(
    "saved_policy",
    f"""WITH {S}, t AS (SELECT score AS threshold, sum(n) OVER w AS n_answered, sum(e) OVER w AS n_errors FROM (SELECT score, count(*) AS n, sum(1 - y) AS e FROM s GROUP BY ALL) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
tau AS (SELECT min(threshold) FILTER (n_errors / n_answered <= 0.14 + 1e-12) AS tau FROM t)
SELECT item, round(1 / (1 + exp(-(2 * (score - 0.5) / 0.25 - 0.5))), 6) AS confidence, score >= tau AS answer, 'erm' AS method, NULL::VARCHAR AS guarantee FROM s, tau""",
)
def saved_policy(spark, sf_dir):
    """Decisions on every labelled document by a policy that was saved as a file and loaded again."""
    rows = scored(spark, sf_dir)
    found = thresholds.erm_threshold(rows, 0.14).first()
    model = benchmark.Calibrator(["score"], 1.0, [0.5], [0.25], [2.0], -0.5)
    # confidence grows with the score: the score's threshold is a confidence as well
    at = spark.createDataFrame([(found["tau"],)], "score double").select(model.probability().alias("p")).first()["p"]
    path = f"{_place(spark, 'policy')}/policy.json"
    store.save_policy(spark, benchmark.Policy(model, at, {"method": "erm", "alpha": 0.14, "guarantee": "not for erm"}), path)
    policy = store.load_policy(spark, path)
    said = policy.summary()
    return policy.decide(rows).select("item", F.round("confidence", 6).alias("confidence"), (F.col("confidence") >= F.col("tau") - 1e-12).alias("answer"), F.lit(said["method"]).alias("method"), F.lit(said["guarantee"]).cast("string").alias("guarantee"))


@register("saved_eval_set", "SELECT md5(text) AS question, item_id % 2 = 0 AS is_answerable, CASE WHEN item_id % 2 = 0 THEN 'in_domain_factoid' ELSE 'unsupported_fact' END AS category, CASE WHEN item_id % 2 = 0 THEN 'c::' || item_id ELSE '' END AS gold, 'made' AS generator FROM benchmark")
def saved_eval_set(spark, sf_dir):
    """Benchmark items as an evaluation set, assembled, checked, saved as a file and read again."""
    even = F.col("item_id") % 2 == 0
    id_ = F.concat(F.lit("c::"), F.col("item_id").cast("string"))
    drafts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.when(even, "in_domain_factoid").otherwise("unsupported_fact").alias("category"), F.col("text").alias("question"), F.when(even, F.array(id_)).otherwise(F.array().cast("array<string>")).alias("gold"),
        F.when(even, "an answer").otherwise(tx.ABSTENTION).alias("answer"), F.lit("t").alias("template"), F.lit("easy").alias("difficulty"),
    )
    path = f"{_place(spark, 'eval')}/set.json"
    made = evalset.assemble(drafts, {"path": sf_dir, "num_chunks": 0, "sha256": ""}, "made", 3)
    made.check(spark)
    store.write_text(spark, made.to_json(), path)
    back = evalset.EvalSet.from_json(store.read_text(spark, path))
    back.check(spark)
    return back.frame(spark).select(F.md5("question").alias("question"), "is_answerable", "category", F.array_join("ground_truth_chunk_ids", " ").alias("gold"), F.col("metadata")["generator"].alias("generator"))


@register("saved_report", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, 'inf' AS most, NULL::VARCHAR AS none FROM documents GROUP BY lang")
def saved_report(spark, sf_dir):
    """Figures per language through a report: strict JSON, infinities as text, what isn't a number as null, and a table beside it."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.lit(float("inf")).alias("most"), F.lit(float("nan")).alias("none"))
    path = f"{_place(spark, 'report')}/languages"
    store.write_report(spark, {"languages": [r.asDict() for r in rows.collect()]}, path, "Languages | documents")
    back = json.loads(store.read_text(spark, f"{path}.json"))["languages"]
    assert all(f"| {r['lang']} |" in store.read_text(spark, f"{path}.md") for r in back)
    return spark.createDataFrame([(r["lang"], r["n"], r["mean"], r["most"], r["none"]) for r in back], "lang string, n long, mean double, most string, none string").withColumn("mean", F.round("mean", 6))
