"""Evaluation sets: their rules, their file form, and an extractive generator over any corpus."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# fixed values: the categories, and those that have an answer
CATEGORIES = ["in_domain_factoid", "in_domain_reasoning", "out_of_domain", "unsupported_fact", "subtle_conflict"]
ANSWERABLE = ["in_domain_factoid", "in_domain_reasoning"]
# fixed values: questions per category by default
QUOTAS = {"in_domain_factoid": 50, "in_domain_reasoning": 20, "out_of_domain": 10, "unsupported_fact": 10, "subtle_conflict": 10}
ITEM = "id string, question string, is_answerable boolean, category string, ground_truth_chunk_ids array<string>, reference_answer string, metadata map<string,string>"


def blank(c: str) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) == 0


def problem() -> Column:
    """What is wrong with an item (columns of ITEM), or null."""
    gold = F.coalesce("ground_truth_chunk_ids", F.array().cast("array<string>"))
    abstains = F.col("reference_answer") == tx.ABSTENTION
    return (
        F.when(~F.col("id").rlike(r"^eval_\d{3,}$"), "id must look like eval_001")
        .when(blank("question") | blank("reference_answer"), "blank question or answer")
        .when(~F.col("category").isin(CATEGORIES), "unknown category")
        .when(F.col("is_answerable") != F.col("category").isin(ANSWERABLE), "answerable doesn't fit the category")
        .when(F.col("is_answerable") & (F.size(gold) == 0), "an answerable item needs gold chunks")
        .when(F.size(F.array_distinct(gold)) != F.size(gold), "gold chunks must be unique")
        .when(F.col("is_answerable") & abstains, "an answerable item needs a real answer")
        .when(~F.col("is_answerable") & (F.size(gold) > 0), "an unanswerable item has no gold chunks")
        .when(~F.col("is_answerable") & ~abstains, "an unanswerable item needs the abstention answer")
    )


def category_counts(items: DataFrame, column: str = "category", values: list[str] | None = None) -> DataFrame:
    """category, n over all values, 0 where there are none."""
    every = items.sparkSession.createDataFrame([(v,) for v in (values or CATEGORIES)], "category string")
    have = items.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return every.join(have, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def missing_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold ids that the corpus doesn't have."""
    cited = items.select(F.explode("ground_truth_chunk_ids").alias("chunk_id")).distinct()
    return cited.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


@dataclass
class EvalSet:
    items: list[dict]
    generator: str
    seed: int
    corpus: dict
    counts: dict[str, int] = field(default_factory=dict)
    schema_version: str = "1.0"

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=2, sort_keys=True, ensure_ascii=False) + "\n"

    @staticmethod
    def from_json(text: str) -> EvalSet:
        return EvalSet(**json.loads(text))

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in ITEM.split(", ")]
        rows = [tuple({k: json.dumps(v) if not isinstance(v, str) else v for k, v in i["metadata"].items()} if n == "metadata" else i[n] for n in names) for i in self.items]
        return spark.createDataFrame(rows, ITEM)

    def check(self, spark: SparkSession) -> None:
        """Raise ValueError unless every item is sound, ids are unique and sorted, and counts agree."""
        rows = self.frame(spark)
        bad = rows.withColumn("p", problem()).where("p IS NOT NULL").select("id", "p").limit(5).collect()
        if bad:
            raise ValueError(f"bad items: {[tuple(r) for r in bad]}")
        ids = [i["id"] for i in self.items]
        if len(set(ids)) != len(ids) or ids != sorted(ids):
            raise ValueError("ids must be unique and sorted")
        counts = {r["category"]: r["n"] for r in category_counts(rows).collect()}
        if counts != self.counts:
            raise ValueError("counts don't match the items")

    def summary(self) -> str:
        lines = [f"{c:<22}{self.counts.get(c, 0):>5}" for c in CATEGORIES]
        return "\n".join([*lines, f"{'total':<22}{len(self.items):>5}", f"corpus: {self.corpus.get('path')} ({self.corpus.get('num_chunks')} chunks)"])


def numeric_sentences(chunks: DataFrame) -> DataFrame:
    """chunk_id, doc_id, title, sentence, number, unit, before, after: sentences of 60 to 260 characters with a number and six tokens."""
    each = chunks.select("chunk_id", "doc_id", "title", F.explode(tx.sentences(F.col("text"), tx.SENTENCE_END_LETTER)).alias("raw"))
    s = each.select("chunk_id", "doc_id", "title", tx.collapse(F.col("raw")).alias("sentence")).where(F.length("sentence").between(60, 260))
    found = s.withColumn("number", F.regexp_extract("sentence", tx.CLOZE_NUMBER, 1)).withColumn("unit", F.regexp_extract("sentence", tx.CLOZE_NUMBER, 2)).where("number <> ''")
    found = found.where(F.size(tx.tokenize(F.col("sentence"))) >= 6)
    place = F.length(F.regexp_extract("sentence", r"(?s)^(.*?)" + tx.CLOZE_NUMBER.removeprefix("(?U)"), 1))
    return found.withColumn("before", F.substring("sentence", F.lit(1), place)).withColumn("after", F.substring("sentence", place + F.length("number") + F.length("unit") + 1, F.length("sentence")))


def gold_chunks(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """sentence and the chunks of its document that hold it (white space collapsed), its own if none does."""
    flat = chunks.select("doc_id", F.col("chunk_id").alias("other"), tx.collapse(F.col("text")).alias("flat"))
    hits = sentences.select("doc_id", "chunk_id", "sentence").join(flat, "doc_id").where(F.contains("flat", "sentence")).groupBy("chunk_id", "sentence").agg(F.array_sort(F.collect_set("other")).alias("gold"))
    return sentences.join(hits, ["chunk_id", "sentence"], "left").withColumn("gold", F.coalesce("gold", F.array("chunk_id")))


def _shuffled(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def invented_names(spark: SparkSession, vocabulary: DataFrame, n: int, seed: int = 0) -> list[str]:
    """Names of which no token is in the corpus."""
    heads, tails = ["Zorbi", "Quaxa", "Veltri", "Ombrel", "Krynn", "Yuvast", "Jexol", "Phlox", "Wyntar", "Drovik"], ["Net", "Former", "RAG"]
    names = spark.createDataFrame([(h + t,) for h in heads for t in tails], "name string")
    tokens = names.select("name", F.explode(tx.tokenize(F.col("name"))).alias("token"))
    known = tokens.join(vocabulary, "token", "left_semi").select("name").distinct()
    out = [r["name"] for r in names.join(known, "name", "left_anti").orderBy(_shuffled(seed, "name")).limit(n).collect()]
    if len(out) < n:
        raise ValueError(f"only {len(out)} invented names are outside the corpus")
    return out


# fixed values: questions of other domains
FOREIGN = [
    "How long should sourdough proof before baking?",
    "Which offside rule applies at a throw-in?",
    "What soil acidity do blueberries prefer?",
    "How is a bowline knot tied?",
    "When was the Suez Canal opened to shipping?",
    "How many strings does a viola have?",
    "What temperature melts dark chocolate?",
    "Which vaccines do kittens need first?",
    "How do glaciers carve fjords?",
    "What is the capital gains allowance for gardeners?",
    "How are kimono sleeves sewn?",
    "Which gear suits a steep cycling climb?",
]


def extractive_items(chunks: DataFrame, quotas: dict[str, int] | None = None, seed: int = 0, vocabulary: DataFrame | None = None) -> DataFrame:
    """Drafts of all categories: category, question, gold, answer, template, difficulty; at most the quota of each, no question twice.

    Cloze questions and comparisons come from numeric sentences, conflicts from
    the same with an altered value, the rest from invented names and other
    domains. The order is by seeded hashes, so a seed gives one set.
    """
    spark = chunks.sparkSession
    quotas = quotas or QUOTAS
    s = gold_chunks(numeric_sentences(chunks), chunks).withColumn("value", F.expr("try_cast(number AS double)"))
    masked = F.concat("before", F.lit("___"), "after")
    none = F.array().cast("array<string>")
    draft = lambda df, cat, q, gold, answer, template, level, key: df.select(F.lit(cat).alias("category"), q.alias("question"), gold.alias("gold"), answer.alias("answer"), F.lit(template).alias("template"), F.lit(level).alias("difficulty"), key.alias("key"))
    key = _shuffled(seed, "chunk_id", "sentence")
    title = F.concat(F.lit('"'), "title", F.lit('"'))
    factoid = draft(s, CATEGORIES[0], F.concat(F.lit("According to "), title, F.lit(', what value fills the blank: "'), masked, F.lit('"?')), F.col("gold"), F.concat("number", "unit"), "extractive_cloze", "medium", key)
    altered = F.concat("before", F.format_string("%.1f", F.col("value") * 1.7 + 3), "unit", "after")
    conflict = draft(s.where("value IS NOT NULL"), CATEGORIES[4], F.concat(F.lit("The paper "), title, F.lit(' states: "'), altered, F.lit('" What explains this result?')), none, F.lit(tx.ABSTENTION), "extractive_wrong_value", "hard", key)
    w = Window.partitionBy("doc_id").orderBy(key, "chunk_id", "sentence")
    order = s.withColumn("masked", masked).withColumn("rn", F.row_number().over(w))
    nxt = lambda c: F.lead(c).over(w).alias(f"{c}2")
    pairs = order.select("*", nxt("masked"), nxt("value"), nxt("number"), nxt("unit"), nxt("gold")).where("rn % 2 = 1 AND value2 IS NOT NULL AND value <> value2")
    larger = F.when(F.col("value") > F.col("value2"), "the first").otherwise("the second")
    reasoning = draft(
        pairs,
        CATEGORIES[1],
        F.concat(F.lit("In "), title, F.lit(', which blank holds the larger value: (1) "'), "masked", F.lit('" or (2) "'), "masked2", F.lit('"?')),
        F.array_distinct(F.concat("gold", "gold2")),
        F.concat(larger, F.lit(" ("), "number", "unit", F.lit(" vs "), "number2", "unit2", F.lit(")")),
        "extractive_compare",
        "hard",
        key,
    )
    if vocabulary is None:
        vocabulary = corpus_vocabulary(chunks)
    names = spark.createDataFrame([(n, i) for i, n in enumerate(invented_names(spark, vocabulary, max(1, min(30, quotas[CATEGORIES[3]])), seed))], "name string, i int")
    titles = chunks.select("title").distinct().orderBy(_shuffled(seed, "title")).limit(max(1, quotas[CATEGORIES[3]])).withColumn("j", F.row_number().over(Window.orderBy(_shuffled(seed, "title"))) - 1)
    fake = names.join(titles, F.col("i") % F.lit(titles.count()) == F.col("j"))
    unsupported = draft(fake, CATEGORIES[3], F.concat(F.lit("What results does "), title, F.lit(" report for "), "name", F.lit("?")), none, F.lit(tx.ABSTENTION), "extractive_hallucinated_entity", "medium", F.col("i").cast("long"))
    foreign = spark.createDataFrame([(q, i) for i, q in enumerate(FOREIGN)], "q string, i long")
    hit = foreign.select("q", F.explode(tx.tokenize(F.col("q"))).alias("token")).join(vocabulary, "token", "left_semi").select("q").distinct()
    ood = draft(foreign.join(hit, "q", "left_anti"), CATEGORIES[2], F.col("q"), none, F.lit(tx.ABSTENTION), "out_of_domain", "easy", F.col("i"))
    every = factoid.union(reasoning).union(ood).union(unsupported).union(conflict)
    once = Window.partitionBy(F.lower(F.trim("question"))).orderBy(F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")), "key")
    limits = F.create_map(*[F.lit(x) for c, n in quotas.items() for x in (c, n)])
    pick = Window.partitionBy("category").orderBy("key", "question")
    rows = every.withColumn("d", F.row_number().over(once)).where("d = 1").withColumn("rn", F.row_number().over(pick))
    return rows.where(F.col("rn") <= F.element_at(limits, F.col("category"))).drop("d", "rn")


def corpus_vocabulary(chunks: DataFrame) -> DataFrame:
    """Distinct tokens of texts and titles."""
    return chunks.select(F.explode(F.array_union(tx.tokenize(F.col("text")), tx.tokenize(F.col("title")))).alias("token")).distinct()


def assemble(drafts: DataFrame, corpus: dict, generator: str, seed: int) -> EvalSet:
    """Number the drafts in seeded order; the set is small by its quotas and leaves Spark here."""
    rows = drafts.orderBy(_shuffled(seed, "question"), "question").collect()
    items = [
        {
            "id": f"eval_{i:03d}",
            "question": r["question"],
            "is_answerable": r["category"] in ANSWERABLE,
            "category": r["category"],
            "ground_truth_chunk_ids": list(r["gold"]),
            "reference_answer": r["answer"],
            "metadata": {"template": r["template"], "difficulty": r["difficulty"], "generator": generator},
        }
        for i, r in enumerate(rows, 1)
    ]
    counts = {c: sum(i["category"] == c for i in items) for c in CATEGORIES}
    return EvalSet(items, generator, seed, corpus, counts)
