"""Evaluation questions written by a language model, kept only where their evidence holds and a judge agrees.

Attempts, replies, verdicts and rejections are tables: what an attempt rests on
follows from keyed hashes, requests run in a bounded number of partitions, and
evidence is held against passages in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as tx
from .evalset import ANSWERABLE, CATEGORIES, QUOTAS
from .reader import Client, Refusal, first_json
from .settle import settle

SYSTEM = "You write questions for testing a system that answers from documents. Reply with one JSON object and nothing else."
PROMPTS = {
    "factoid": 'Ask for one detail that this passage states. Fields: question, answer, evidence_quote (copied from the passage).\n\n"{title}"\n{a}',
    "reasoning": 'Ask something that takes both passages to answer. Fields: question, answer, evidence_quotes (a list of two: one copied from each, in order).\n\n"{title}"\nFirst passage:\n{a}\n\nSecond passage:\n{b}',
    "unsupported": 'Ask for a likely detail that a reader of this passage might want and that it does not give. Field: question.\n\n"{title}"\n{a}',
    "conflict": 'Ask a question that takes for granted something this passage contradicts. Fields: question, contradicted_claim.\n\n"{title}"\n{a}',
    "foreign": "Ask one factual question about {topic}. Field: question.",
    "judge": "Do these passages state what it takes to answer the question? A question that rests on a wrong premise can't be answered. Fields: answerable (true or false), chunk_id (or null), rationale.\n\nQuestion: {question}\n\n{passages}",
}
TOPICS = ["glassblowing", "lighthouse keeping", "tram timetables", "cheese ageing", "mountain rescue", "stamp printing", "choir seating", "bee plants", "bridge painting", "fencing rules"]
# fixed values: fields of replies, with their kinds; a question mark: may be missing or null
REPLIES = {
    "factoid": {"question": str, "answer": str, "evidence_quote": str},
    "reasoning": {"question": str, "answer": str, "evidence_quotes": list},
    "question": {"question": str, "contradicted_claim?": str},
    "judgement": {"answerable": bool, "chunk_id?": str, "rationale?": str},
}
#: Shorter chunks are asked about only where there are no others.
LEAST_CHARS = 200


def worth_asking(chunks: DataFrame) -> DataFrame:
    """Chunks of LEAST_CHARS characters or more; all of them where there are none."""
    long = chunks.where(F.length("text") >= LEAST_CHARS)
    return chunks if long.isEmpty() else long


def parsed(reply: str, kind: str) -> dict:
    """The JSON object of a reply, checked against REPLIES; ValueError says what is wrong with it."""
    value = first_json(reply)
    out = {}
    for name, want in REPLIES[kind].items():
        field = name.rstrip("?")
        got = value.get(field)
        if got is None and name.endswith("?"):
            continue
        if not isinstance(got, want) or (want is list and not all(isinstance(x, str) for x in got)):
            raise ValueError(f"{field} must be {want.__name__}")
        out[field] = got
    return out


@dataclass
class Written:
    """Questions that were kept, and every attempt with what became of it.

    drafts: category, question, gold, answer, template, difficulty, as
    evalset.assemble takes them. attempts: category, attempt, passages (chunk
    ids), reply, question, answer, reason; reason is null where it held.
    """

    drafts: DataFrame
    attempts: DataFrame

    def tallies(self) -> dict[str, int]:
        counts = self.attempts.where("reason IS NOT NULL").groupBy("reason").count()
        return {r["reason"]: r["count"] for r in counts.collect()}


# fixed values: the kind of prompt, the kind of reply, the template's name and the difficulty of each category
KINDS = {
    "in_domain_factoid": ("factoid", "factoid", "written_factoid", "medium"),
    "in_domain_reasoning": ("reasoning", "reasoning", "written_reasoning", "hard"),
    "out_of_domain": ("foreign", "question", "written_foreign", "easy"),
    "unsupported_fact": ("unsupported", "question", "written_unsupported", "hard"),
    "subtle_conflict": ("conflict", "question", "written_conflict", "hard"),
}
_BASIS = "category string, attempt int, passages array<struct<chunk_id:string,title:string,text:string>>"


def bases(chunks: DataFrame, category: str, n: int, seed: int) -> DataFrame:
    """What each of n attempts at a category rests on: category, attempt, passages.

    Chunks, or for reasoning pairs of neighbours within a document, stand in the
    order of a keyed hash, and attempt k takes the k-th of them, from the front
    again where they run out. Questions of other domains rest on nothing.
    """
    spark = chunks.sparkSession
    numbers = spark.range(n).select(F.col("id").cast("int").alias("attempt"))
    if category == "out_of_domain":
        return numbers.select(F.lit(category).alias("category"), "attempt", F.array().cast("array<struct<chunk_id:string,title:string,text:string>>").alias("passages"))
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(category), F.col("chunk_id").cast("string")))
    one = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("title").cast("string").alias("title"), "text")
    keyed = worth_asking(chunks).select("doc_id", key.alias("key"), one.alias("one"))
    if category == "in_domain_reasoning":
        w = Window.partitionBy("doc_id").orderBy("key")
        keyed = keyed.withColumn("two", F.lead("one").over(w)).where("two IS NOT NULL").select("key", F.array("one", "two").alias("passages"))
    else:
        keyed = keyed.select("key", F.array("one").alias("passages"))
    first = settle(keyed.orderBy("key").limit(n))
    place = F.row_number().over(Window.orderBy("key")) - 1  # of at most n rows
    some = first.count()
    if not some:
        return spark.createDataFrame([], _BASIS)
    return numbers.withColumn("place", F.col("attempt") % some).join(first.withColumn("place", place), "place").select(F.lit(category).alias("category"), "attempt", "passages")


def _prompts(rows: DataFrame) -> DataFrame:
    """rows of bases with their prompt."""
    text = lambda i: F.coalesce(F.get("passages", F.lit(i))["text"], F.lit(""))
    topic = F.get(F.array(*map(F.lit, TOPICS)), F.col("attempt") % len(TOPICS))
    filled = F.lit(None).cast("string")
    for category, (kind, *_) in KINDS.items():
        # the passages are put in last, so that braces of theirs stay what they are
        parts = re.split(r"(\{\w+\})", PROMPTS[kind])
        values = {"{title}": F.coalesce(F.get("passages", F.lit(0))["title"], F.lit("")), "{a}": text(0), "{b}": text(1), "{topic}": topic}
        filled = F.when(F.col("category") == category, F.concat(*[values.get(p, F.lit(p)) for p in parts if p])).otherwise(filled)
    return rows.withColumn("prompt", filled)


def ask(rows: DataFrame, client: Client, temperature: float, max_tokens: int, partitions: int) -> DataFrame:
    """rows (with prompt) and reply, problem: one request per row, as many at once as partitions; stored, so that none is asked twice.

    A refusal or a client's ValueError is a row with the problem; other errors end the run.
    """
    schema = StructType([*rows.schema.fields, StructField("reply", StringType()), StructField("problem", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for prompt in batch["prompt"]:
                try:
                    said.append((client.complete(SYSTEM, prompt, temperature=temperature, max_tokens=max_tokens), None))
                except (ValueError, Refusal) as e:
                    said.append((None, type(e).__name__))
            yield batch.assign(reply=[r for r, _ in said], problem=[p for _, p in said])

    return settle(rows.repartition(partitions).mapInPandas(run, schema))


def read_reply(kind: Column, reply: str) -> Column:
    """Fields of replies by their kind (see REPLIES), or what is wrong with them."""

    @F.pandas_udf("struct<question:string,answer:string,quotes:array<string>,answerable:boolean,problem:string>")
    def read(kinds: pd.Series, replies: pd.Series) -> pd.DataFrame:
        out = []
        for kind, reply in zip(kinds, replies, strict=True):
            try:
                got = parsed(reply or "", kind)
                quotes = got.get("evidence_quotes", [got["evidence_quote"]] if "evidence_quote" in got else [])
                out.append((got.get("question"), got.get("answer"), quotes, got.get("answerable"), None))
            except ValueError as e:
                out.append((None, None, [], None, type(e).__name__))
        return pd.DataFrame(out, columns=["question", "answer", "quotes", "answerable", "problem"])

    return read(kind, reply)


def _flat(c):
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def _holds() -> Column:
    """Whether every passage holds its own quote, white space and case aside, and none is missing."""
    pairs = F.zip_with("passages", "quotes", lambda p, q: F.coalesce((F.trim(q) != "") & F.contains(_flat(p["text"]), _flat(q)), F.lit(False)))
    return (F.size("passages") == F.size("quotes")) & F.forall(pairs, lambda ok: ok)


def judged(drafts: DataFrame, client: Client, search: Callable[[DataFrame, int], DataFrame], max_tokens: int, partitions: int) -> DataFrame:
    """category, attempt, answerable, problem: whether a judge finds the answer in the five passages that a search gives.

    search takes (query_id, text) and gives query_id, rank, chunk_id, text.
    """
    asked = settle(drafts.select("category", "attempt", F.xxhash64("category", "attempt").alias("query_id"), F.col("question").alias("text")))
    found = search(asked.select("query_id", "text"), 5)
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.col("text"))
    shown = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("passages"))
    head, middle, tail = re.split(r"\{question\}|\{passages\}", PROMPTS["judge"])
    rows = asked.join(shown, "query_id", "left").select("category", "attempt", F.concat(F.lit(head), "text", F.lit(middle), F.coalesce("passages", F.lit("")), F.lit(tail)).alias("prompt"))
    said = ask(rows, client, 0.0, max_tokens, partitions)
    read = said.withColumn("x", read_reply(F.lit("judgement"), "reply"))
    return read.select("category", "attempt", "x.answerable", F.coalesce("problem", "x.problem").alias("problem"))


def _round(rows: DataFrame, client: Client, search, temperature: float, max_tokens: int, partitions: int) -> DataFrame:
    """Attempts of a round, asked, read and held against their evidence and the judge."""
    kind = F.element_at(F.create_map(*[F.lit(x) for c, k in KINDS.items() for x in (c, k[1])]), F.col("category"))
    said = ask(_prompts(rows), client, temperature, max_tokens, partitions).withColumn("x", read_reply(kind, "reply"))
    fields = settle(said.select("category", "attempt", "passages", "reply", "x.question", "x.answer", "x.quotes", F.coalesce("problem", "x.problem").alias("problem")))
    stated = F.col("category").isin(ANSWERABLE)
    first = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.trim("question") == "", "no_question").when(stated & ((F.trim("answer") == "") | ~_holds()), "quote_not_in_passage")
    checked = fields.withColumn("reason", first)
    if search is not None:
        open_ = checked.where(~stated & F.col("reason").isNull())
        verdicts = judged(open_, client, search, max_tokens, partitions)
        why = F.when(F.col("verdict"), "judged_answerable").otherwise(F.col("trouble"))
        checked = checked.join(verdicts.select("category", "attempt", F.col("answerable").alias("verdict"), F.col("problem").alias("trouble")), ["category", "attempt"], "left").withColumn("reason", F.coalesce("reason", why)).drop("verdict", "trouble")
    return settle(checked.select("category", "attempt", F.transform("passages", lambda p: p["chunk_id"]).alias("passages"), "reply", "question", "answer", "reason"))


def write_questions(chunks: DataFrame, client: Client, quotas: dict[str, int] | None = None, seed: int = 0, search: Callable[[DataFrame, int], DataFrame] | None = None, temperature: float = 0.7, attempts: int = 4, max_tokens: int = 1024, partitions: int = 4, progress: Callable[[int, int], None] | None = None) -> Written:
    """Questions of every category from chunks (chunk_id, doc_id, title, text) by a language model.

    Each round asks once for as many questions as the quotas of the categories
    that still lack some; there are as many rounds as attempts. A question is
    kept if its evidence stands in its passages word for word, if, with a
    search, a judge finds no answer to one that should have none, and if none
    before it (by round, category and attempt) is the same but for case and outer
    white space. RuntimeError with the tallies of reasons if a quota stays
    unfilled. progress is told (kept, wanted) after each round.
    """
    quotas = {c: n for c, n in (quotas or QUOTAS).items() if n}
    place = {c: i for i, c in enumerate(CATEGORIES)}
    rank = F.element_at(F.create_map(*[F.lit(x) for c, i in place.items() for x in (c, i)]), F.col("category"))
    based = {c: settle(bases(chunks, c, n * attempts, seed)) for c, n in quotas.items()}
    every, have = None, dict.fromkeys(quotas, 0)
    for k in range(attempts):
        rows = None
        for c, n in quotas.items():
            if have[c] < n:
                part = based[c].where(F.col("attempt").between(k * n, (k + 1) * n - 1))
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            break
        done = _round(rows, client, search, temperature, max_tokens, partitions).withColumn("round", F.lit(k))
        every = done if every is None else every.unionByName(done)
        # of equal questions the first is kept; of what is kept, each category's first up to its quota
        same = Window.partitionBy(F.lower(F.trim("question"))).orderBy("round", rank, "attempt")
        fresh = every.where("reason IS NULL").withColumn("again", F.row_number().over(same) > 1)
        marked = every.where("reason IS NOT NULL").unionByName(fresh.withColumn("reason", F.when(F.col("again"), "asked_before")).drop("again"))
        good = marked.where("reason IS NULL").withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy("attempt")))
        have |= {r["category"]: min(r["count"], quotas[r["category"]]) for r in good.groupBy("category").count().collect()}
        if progress:
            progress(sum(have.values()), sum(quotas.values()))
    tried = settle(marked.drop("round"))
    template, difficulty = (F.element_at(F.create_map(*[F.lit(x) for c, kind in KINDS.items() for x in (c, kind[i])]), F.col("category")) for i in (2, 3))
    limit = F.element_at(F.create_map(*[F.lit(x) for c, n in quotas.items() for x in (c, n)]), F.col("category"))
    stated = F.col("category").isin(ANSWERABLE)
    kept = tried.where("reason IS NULL").withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy("attempt"))).where(F.col("nth") <= limit)
    out = Written(
        kept.select("category", "question", F.when(stated, F.col("passages")).otherwise(F.array().cast("array<string>")).alias("gold"), F.when(stated, F.col("answer")).otherwise(F.lit(tx.ABSTENTION)).alias("answer"), template.alias("template"), difficulty.alias("difficulty")),
        tried,
    )
    short = {c: f"{have[c]} of {n}" for c, n in quotas.items() if have[c] < n}
    if short:
        raise RuntimeError(f"questions found: {short}; rejected: {out.tallies()}")
    return out
