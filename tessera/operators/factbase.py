"""A made-up corpus whose every number is a known fact, and questions from its table of facts.

Reports describe invented gauges tested on basins. Everything is picked by MD5
of the seed, the report and the slot, so the table is the same on any machine,
at any number of reports, and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .evalset import CATEGORIES, FOREIGN, QUOTAS, corpus_vocabulary
from .intervals import contained

HEADS = ["Tarn", "Weir", "Brook", "Firth", "Mere", "Sluice", "Delta", "Fjord", "Rill", "Marsh", "Lagoon", "Ebb", "Spate"]
TAILS = ["Scope", "Meter", "Sonde", "Gauge", "Probe", "Watch", "Line"]
BASINS = ["Aldermoor", "Briskfell", "Coldwater", "Dunhollow", "Eastmere", "Farrowby", "Glenrush", "Harrowgate", "Ivorybeck", "Kestrelford", "Larkspur"]
RIVALS = ["PegStaff", "FloatBox", "RadarOne", "BubbleLine", "StillWell", "PressureCell", "SonicArm"]
UNITS = ["percent", "points", "marks"]
SENSORS = ["ultrasonic", "radar", "pressure", "optical", "capacitive"]
FILLER = ["Field crews kept the instruments clean.", "Weather was mild for most of the season.", "Readings were sent once an hour.", "Nothing else was changed between runs.", "Maps of the sites are in the appendix."]
N_BASINS = 3


def pick(n: int, seed: int, *slot: Column | str) -> Column:
    """A number below n that follows from the seed and the slot."""
    parts = [F.lit(str(seed)), *[s.cast("string") if isinstance(s, Column) else F.lit(s) for s in slot]]
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("long") % n).cast("int")


def _choice(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def fact_table(spark: SparkSession, reports: int | DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, name, fact (its number in the report), kind, basin, rival, unit, value (tenths), sentence.

    Kinds: sensor, layers, weeks; for each basin result, baseline, and trial,
    which is no fact but a number of the same things that misleads. reports:
    how many there are, or a table whose first column numbers them.
    """
    d = spark.range(1, reports + 1).toDF("d") if isinstance(reports, int) else reports.select(F.col(reports.columns[0]).cast("long").alias("d"))
    one = lambda n, *slot: pick(n, seed, F.col("d"), *slot)
    name = F.concat(_choice(HEADS, one(len(HEADS), "head")), _choice(TAILS, one(len(TAILS), "tail")), F.lit("-"), F.col("d").cast("string"))
    base = d.select("d", F.format_string("report-%04d", "d").alias("doc_id"), name.alias("name"), one(len(BASINS), "first").alias("first"), (one(len(BASINS) - 1, "step") + 1).alias("step"), _choice(UNITS, one(len(UNITS), "unit")).alias("unit"))
    setup = base.select(
        "d", "doc_id", "name", "unit",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("fact"), F.lit("sensor").alias("kind"), one(len(SENSORS), "sensor").alias("value"), F.concat(F.lit("The "), "name", F.lit(" relies on a "), _choice(SENSORS, one(len(SENSORS), "sensor")), F.lit(" sensor.")).alias("sentence")),
                F.struct(F.lit(1).alias("fact"), F.lit("layers").alias("kind"), ((one(9, "layers") + 2) * 10).alias("value"), F.concat(F.lit("Its housing has "), (one(9, "layers") + 2).cast("string"), F.lit(" layers of resin.")).alias("sentence")),
                F.struct(F.lit(2).alias("fact"), F.lit("weeks").alias("kind"), ((one(40, "weeks") + 3) * 10).alias("value"), F.concat(F.lit("We ran "), "name", F.lit(" for "), (one(40, "weeks") + 3).cast("string"), F.lit(" weeks.")).alias("sentence")),
            )
        ).alias("f"),
    ).select("d", "doc_id", "name", F.col("f.fact").alias("fact"), F.col("f.kind").alias("kind"), F.lit(None).cast("string").alias("basin"), F.lit(None).cast("string").alias("rival"), "unit", F.col("f.value").alias("value"), F.col("f.sentence").alias("sentence"))
    k = F.col("k")
    per = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(N_BASINS - 1)))).withColumn("basin", _choice(BASINS, (F.col("first") + k * F.col("step")) % len(BASINS)))
    per = per.withColumns({"ours": one(470, "ours", k) + 450, "gap": one(83, "gap", k) + 12, "rival": _choice(RIVALS, one(len(RIVALS), "rival", k)), "way": one(2, "way", k), "off": one(29, "off", k) + 6})
    tenths = lambda v: F.format_string("%.1f", v / 10.0)
    ours = F.when(F.col("way") == 0, F.concat(F.lit("At "), "basin", F.lit(" the full "), "name", F.lit(" scores "), tenths(F.col("ours")), F.lit(" "), "unit", F.lit("."))).otherwise(F.concat(F.lit("The full "), "name", F.lit(" reaches "), tenths(F.col("ours")), F.lit(" "), "unit", F.lit(" at "), "basin", F.lit(".")))
    theirs = F.concat(F.lit("The older "), "rival", F.lit(" manages "), tenths(F.col("ours") - F.col("gap")), F.lit(" "), "unit", F.lit(" at "), "basin", F.lit("."))
    trial = F.concat(F.lit("In a dry trial at "), "basin", F.lit(", "), "name", F.lit(" showed "), tenths(F.col("ours") + F.col("off")), F.lit(" "), "unit", F.lit("."))
    each = F.array(
        F.struct(F.lit(0).alias("i"), F.lit("result").alias("kind"), F.col("ours").alias("value"), ours.alias("sentence")),
        F.struct(F.lit(1).alias("i"), F.lit("baseline").alias("kind"), (F.col("ours") - F.col("gap")).alias("value"), theirs.alias("sentence")),
        F.struct(F.lit(2).alias("i"), F.lit("trial").alias("kind"), (F.col("ours") + F.col("off")).alias("value"), trial.alias("sentence")),
    )
    results = per.select("d", "doc_id", "name", "basin", "rival", "unit", "k", F.explode(each).alias("f")).select("d", "doc_id", "name", (F.lit(3) + 3 * F.col("k") + F.col("f.i")).alias("fact"), F.col("f.kind").alias("kind"), "basin", F.when(F.col("f.kind") == "baseline", F.col("rival")).alias("rival"), "unit", F.col("f.value").alias("value"), F.col("f.sentence").alias("sentence"))
    return setup.unionByName(results).drop("d")


def reports(facts: DataFrame) -> DataFrame:
    """doc_id, title, text, spans (fact, a, z): the facts' sentences in order, with filler and headings between them."""
    rows = facts.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("fact", "kind", "sentence"))).alias("f"))
    filler = lambda x: _choice(FILLER, pick(len(FILLER), 7, F.col("doc_id"), x["fact"]))
    lines = lambda keep: F.array_join(F.transform(F.filter("f", keep), lambda x: F.concat(x["sentence"], F.lit(" "), filler(x))), " ")
    text = F.concat("name", F.lit(": notes from the field\n\n1 Build. "), lines(lambda x: x["fact"] < 3), F.lit("\n\n2 Results. "), lines(lambda x: x["fact"] >= 3))
    # sentences are found from where the last one ended
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<fact:int,a:int,z:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = F.call_function("locate", x["sentence"], F.col("text"), acc["at"] + 1) - 1
        z = a + F.length(x["sentence"])
        return F.struct(z.alias("at"), F.concat(acc["out"], F.array(F.struct(x["fact"].alias("fact"), a.alias("a"), z.alias("z")))).alias("out"))

    made = rows.withColumn("text", text)
    return made.select("doc_id", F.col("name").alias("title"), "text", F.aggregate("f", start, step, lambda acc: acc["out"]).alias("spans"))


def linked(facts: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """facts with chunks: the ids of the chunks of their report that hold the whole sentence."""
    at = docs.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    inside = contained(at, chunks.select("doc_id", "chunk_id", "char_start", "char_end"), ["doc_id"], window=("char_start", "char_end"))
    held = inside.groupBy("doc_id", "fact").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunks"))
    return facts.join(held, ["doc_id", "fact"], "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def gaps(facts: DataFrame) -> DataFrame:
    """Results beside the baseline of the same report and basin; those without one are left out."""
    own = facts.where("kind = 'result'").select("doc_id", "name", "basin", "unit", F.col("value").alias("ours"), *[F.col(c).alias(f"{c}1") for c in ("chunks",) if c in facts.columns])
    base = facts.where("kind = 'baseline'").select("doc_id", "basin", "rival", F.col("value").alias("theirs"), *[F.col(c).alias(f"{c}2") for c in ("chunks",) if c in facts.columns])
    return own.join(base, ["doc_id", "basin"])


def template_items(facts: DataFrame, chunks: DataFrame, quotas: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """Drafts as evalset.extractive_items gives them, from linked facts: answers and evidence are exact by construction.

    Facts that no chunk holds whole make no answerable question. The order is
    by seeded hashes; no question stands twice.
    """
    spark, quotas = facts.sparkSession, quotas or QUOTAS
    none = F.array().cast("array<string>")
    tenths = lambda v: F.format_string("%.1f", v / 10.0)
    key = lambda *c: F.xxhash64(F.lit(seed), *c)
    draft = lambda df, cat, q, gold, answer, template, level, k: df.select(F.lit(cat).alias("category"), q.alias("question"), gold.alias("gold"), answer.alias("answer"), F.lit(template).alias("template"), F.lit(level).alias("difficulty"), k.alias("key"))
    held = facts.where(F.size("chunks") > 0)
    s = F.concat
    ask = (
        F.when(F.col("kind") == "result", s(F.lit("What does the full "), "name", F.lit(" score at "), "basin", F.lit("?")))
        .when(F.col("kind") == "baseline", s(F.lit("In the report on "), "name", F.lit(", what does "), "rival", F.lit(" manage at "), "basin", F.lit("?")))
        .when(F.col("kind") == "sensor", s(F.lit("What kind of sensor does "), "name", F.lit(" rely on?")))
        .when(F.col("kind") == "layers", s(F.lit("How many layers of resin does the housing of "), "name", F.lit(" have?")))
        .otherwise(s(F.lit("For how many weeks was "), "name", F.lit(" run?")))
    )
    said = F.when(F.col("kind").isin("result", "baseline"), s(tenths(F.col("value")), F.lit(" "), "unit")).when(F.col("kind") == "sensor", _choice(SENSORS, F.col("value"))).otherwise((F.col("value") / 10).cast("int").cast("string"))
    every = draft(held.where("kind <> 'trial'"), CATEGORIES[0], ask, F.col("chunks"), said, "fact", "easy", key("doc_id", "fact"))
    g = gaps(held)
    every = every.union(draft(g, CATEGORIES[1], s(F.lit("By how much does "), "name", F.lit(" beat "), "rival", F.lit(" at "), "basin", F.lit("?")), F.array_union("chunks1", "chunks2"), s(tenths(F.col("ours") - F.col("theirs")), F.lit(" "), "unit"), "gap", "hard", key("doc_id", "basin")))
    r = held.where("kind = 'result'")
    two = r.alias("a").join(r.alias("b"), F.col("a.doc_id") == F.col("b.doc_id")).where("a.fact < b.fact AND a.value <> b.value")
    pair = two.select(F.col("a.doc_id").alias("doc_id"), F.col("a.name").alias("name"), F.col("a.basin").alias("x"), F.col("b.basin").alias("y"), (F.col("a.value") > F.col("b.value")).alias("first"), F.array_union("a.chunks", "b.chunks").alias("gold"))
    every = every.union(draft(pair, CATEGORIES[1], s(F.lit("Does the full "), "name", F.lit(" score higher at "), "x", F.lit(" or at "), "y", F.lit("?")), F.col("gold"), F.when(F.col("first"), F.col("x")).otherwise(F.col("y")), "compare", "hard", key("doc_id", "x", "y")))
    seen = facts.where("kind = 'result'").groupBy("doc_id", "name").agg(F.collect_set("basin").alias("seen"), F.min(F.struct("fact", "basin", "value", "unit")).alias("f"))
    missing = seen.withColumn("basin", F.explode(F.array_except(F.array(*[F.lit(b) for b in BASINS]), "seen")))
    every = every.union(draft(missing, CATEGORIES[3], s(F.lit("What does the full "), "name", F.lit(" score at "), "basin", F.lit("?")), none, F.lit(tx.ABSTENTION), "absent_basin", "hard", key("doc_id", "basin")))
    every = every.union(draft(seen, CATEGORIES[4], s(F.lit("Why does "), "name", F.lit(" reach only "), tenths(F.col("f.value") - 111), F.lit(" "), "f.unit", F.lit(" at "), "f.basin", F.lit("?")), none, F.lit(tx.ABSTENTION), "altered_value", "hard", key("doc_id")))
    foreign = spark.createDataFrame([(q, i) for i, q in enumerate(FOREIGN)], "q string, i long")
    hit = foreign.select("q", F.explode(tx.tokenize(F.col("q"))).alias("token")).join(corpus_vocabulary(chunks), "token", "left_semi").select("q").distinct()
    every = every.union(draft(foreign.join(hit, "q", "left_anti"), CATEGORIES[2], F.col("q"), none, F.lit(tx.ABSTENTION), "out_of_domain", "easy", F.col("i")))
    once = Window.partitionBy(F.lower(F.trim("question"))).orderBy("key", "category")
    limits = F.create_map(*[F.lit(x) for c, n in quotas.items() for x in (c, n)])
    rows = every.withColumn("d", F.row_number().over(once)).where("d = 1").withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("key", "question")))
    return rows.where(F.col("rn") <= F.element_at(limits, F.col("category"))).drop("d", "rn")


