"""Registered queries for the text functions, joins, windows, sets and checks of the engine, each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numeric import allocate, encode_double
from ..operators import chunks, evalset, metrics
from ..operators.settle import settle
from ..sources import documents as sources
from ..sources import store
from . import sql
from .registry import register
from .retrieval_queries import corpus, gold, GOLD, holding, index, questions


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text functions -------------------------------------------------------


@register("normal_answers", f"SELECT conv_id, turn, md5({sql.answer('text')}) AS digest FROM conversations")
def normal_answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(tx.normalize_answer(F.col("text"))).alias("digest"))


def _turns(spark, sf_dir):
    """A turn as a prediction, the next turn of the conversation as its reference."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("reference", F.lead("text").over(w)).where("reference IS NOT NULL")


_TURNS = "t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations)"


@register(
    "answer_f1",
    f"""WITH {_TURNS}, a AS (SELECT conv_id, turn, list_filter(string_split({sql.answer('text')}, ' '), lambda x: x <> '') AS p, list_filter(string_split({sql.answer('reference')}, ' '), lambda x: x <> '') AS r FROM t WHERE reference IS NOT NULL),
pc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS w FROM a) GROUP BY ALL), rc AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(r) AS w FROM a) GROUP BY ALL),
m AS (SELECT conv_id, turn, sum(least(pc.c, rc.c)) AS k FROM pc JOIN rc USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN p = r THEN 1.0::DOUBLE ELSE 0 END AS em, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN CASE WHEN len(p) = len(r) THEN 1 ELSE 0 END ELSE 2.0::DOUBLE * coalesce(k, 0) / (len(p) + len(r)) END, 6) AS f1 FROM a LEFT JOIN m USING (conv_id, turn)""",
)
def answer_f1(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return t.select("conv_id", "turn", tx.exact_match(F.col("text"), F.col("reference")).alias("em"), F.round(tx.token_f1(F.col("text"), F.col("reference")), 6).alias("f1"))


@register("sentence_counts", r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '[\x01\n]'), lambda s: regexp_matches(s, '[^\s]')))::INT AS n_sentences FROM documents""")
def sentence_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


@register(
    "clean_pages",
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, length(x)::INT AS n_chars, md5(x) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS x FROM h)""",
)
def clean_pages(spark, sf_dir):
    x = sources.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", x.alias("x")).select("page_id", F.length("x").alias("n_chars"), F.md5("x").alias("digest"))


@register(
    "clean_text",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
)
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("digest"))


@register("vocabulary_trigrams", f"WITH {sql.CORPUS}, v AS (SELECT DISTINCT token FROM qtok) SELECT token, len(g)::INT AS n, md5(array_to_string(list_sort(g), ',')) AS digest FROM (SELECT token, {sql.GRAMS.format('token')} AS g FROM v)")
def vocabulary_trigrams(spark, sf_dir):
    v = questions(spark, sf_dir).select(F.explode(tx.tokenize(F.col("text"))).alias("token")).distinct().withColumn("g", tx.char_trigrams(F.col("token")))
    return v.select("token", F.size("g").alias("n"), F.md5(F.array_join(F.array_sort("g"), ",")).alias("digest"))


@register("bigram_counts", f"WITH {sql.CORPUS} SELECT query_id, len(b)::INT AS n, len(list_distinct(b))::INT AS n_distinct FROM (SELECT query_id, CASE WHEN len(t) > 1 THEN list_zip(t[:-2], t[2:]) ELSE [] END AS b FROM qt)")
def bigram_counts(spark, sf_dir):
    b = tx.bigrams(tx.tokenize(F.col("text")))
    return questions(spark, sf_dir).select("query_id", F.size(b).alias("n"), F.size(F.array_distinct(b)).alias("n_distinct"))


@register("identifiers", "SELECT doc_id, printf('%s::%04d', doc_id::VARCHAR, doc_id % 7) AS chunk_id, printf('eval_%03d', doc_id) AS item_id, replace(source || '/' || doc_id, '/', '_') || '.pdf' AS file, sha256('[\"' || doc_id || '\",\"' || lang || '\"]') AS cache_key FROM documents")
def identifiers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.chunk_id(F.col("doc_id"), F.col("doc_id") % 7).alias("chunk_id"), tx.item_id(F.col("doc_id")).alias("item_id"), tx.file_name(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("file"), tx.cache_key(F.col("doc_id"), F.col("lang")).alias("cache_key"))


@register("encoded_doubles", "SELECT event_id, CASE WHEN value > 30 THEN 'inf' WHEN value < 5 THEN '-inf' WHEN event_id % 3 = 0 THEN NULL ELSE 'finite' END AS v FROM events")
def encoded_doubles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = F.when(F.col("value") > 30, float("inf")).when(F.col("value") < 5, float("-inf")).when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value"))
    t = encode_double(x)
    return e.select("event_id", F.when(t.isin("inf", "-inf") | t.isNull(), t).otherwise("finite").alias("v"))


@register(
    "prompt_context",
    """SELECT source, md5(string_agg('[' || doc_id || '] (from "' || lang || '")' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY source""",
)
def prompt_context(spark, sf_dir):
    from ..operators.reader import prompt_context as build

    d = table(spark, sf_dir, "documents")
    top = d.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rank <= 3")
    rows = top.select(F.col("source").alias("query_id"), "rank", F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("title"), "text")
    return build(rows).select(F.col("query_id").alias("source"), F.md5("context").alias("digest"))


@register(
    "numeric_sentences",
    r"""WITH s AS (SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '[\x01\n]')), '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, count(*) AS n FROM s WHERE length(s) BETWEEN 60 AND 260 AND regexp_matches(s, '(^|[^\p{L}\p{N}_.])[0-9]+(\.[0-9]+)?%?($|[^\p{L}\p{N}_.%]|\.($|[^0-9])|%($|[^\p{L}\p{N}_.]|\.($|[^0-9])))') AND len(""" + sql.tokens("s") + r""") >= 6 GROUP BY doc_id""",
)
def numeric_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", F.col("source").alias("title"), "text")
    return evalset.numeric_sentences(d).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("allocation", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), f AS (SELECT lang, n, i, floor(n * fr + 1e-9) AS fl, n * fr - floor(n * fr + 1e-9) AS rem FROM n, (SELECT unnest([0, 1, 2]) AS i, unnest([0.4::DOUBLE, 0.3, 0.3]) AS fr)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(rem, 9) DESC, i) AS rn, n - sum(fl) OVER (PARTITION BY lang) AS extra FROM f) SELECT lang, i::INT AS fold, (fl + CASE WHEN rn <= extra THEN 1 ELSE 0 END)::BIGINT AS n FROM r")
def allocation(spark, sf_dir):
    """Largest remainders: the groups are a handful of languages, the shares are dealt out on the driver."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").count().collect()
    rows = [(r["lang"], i, n) for r in counts for i, n in enumerate(allocate(r["count"], [0.4, 0.3, 0.3]))]
    return spark.createDataFrame(rows, "lang string, fold int, n long")


# ---- joins ----------------------------------------------------------------


@register("unlabelled_documents", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@register("labels_outside_english", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def labels_outside_english(spark, sf_dir):
    """Cited ids that a corpus lacks: left anti join."""
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id").join(english, "doc_id", "left_anti")


@register("gold_in_context", f"WITH {GOLD} SELECT DISTINCT query_id FROM gold SEMI JOIN (SELECT doc_id AS pos FROM labels WHERE quality = 1) USING (pos)")
def gold_in_context(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("pos"))
    return gold(spark, sf_dir).join(good, "pos", "left_semi").select("query_id").distinct()


@register("customers_with_default", "SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(first_status, 'none') AS first_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS first_status FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def customers_with_default(spark, sf_dir):
    """Left outer join with defaults."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("s"))
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("s", F.lit("none")).alias("first_status"))


@register("nation_pairs", "SELECT a.n_name AS first, b.n_name AS second, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name JOIN region ON r_regionkey = a.n_regionkey")
def nation_pairs(spark, sf_dir):
    """Self join with an inequality: each pair of one group once."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = n.select("n_regionkey", F.col("n_name").alias("first"))
    b = n.select("n_regionkey", F.col("n_name").alias("second"))
    return a.join(b, "n_regionkey").where("first < second").join(r, F.col("n_regionkey") == r.r_regionkey).select("first", "second", "r_name")


@register("order_pairs", "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT a.o_custkey, a.o_orderkey AS first_key, b.o_orderkey AS second_key, CASE WHEN a.o_totalprice > b.o_totalprice THEN 'the first' ELSE 'the second' END AS larger FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1 AND a.o_totalprice <> b.o_totalprice")
def order_pairs(spark, sf_dir):
    """Consecutive pairs 1-2, 3-4, ... of a group, by lead on odd rows instead of a self join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).withColumn("second_key", F.lead("o_orderkey").over(w)).withColumn("p2", F.lead("o_totalprice").over(w))
    kept = o.where("rn % 2 = 1 AND second_key IS NOT NULL AND o_totalprice <> p2")
    return kept.select("o_custkey", F.col("o_orderkey").alias("first_key"), "second_key", F.when(F.col("o_totalprice") > F.col("p2"), "the first").otherwise("the second").alias("larger"))


@register(
    "facts_in_windows",
    """WITH p AS (SELECT d.doc_id, item_id, length(b.text) AS n, string_split(d.text, b.text) AS parts FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
f AS (SELECT doc_id, item_id, n, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * n AS a FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS k FROM p)),
w AS (SELECT doc_id, i, i * 448 AS a, least(i * 448 + 512, length(text)) AS z FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) // 448)) AS i FROM documents))
SELECT item_id, f.doc_id, f.a::INT AS at, w.i::INT AS window FROM f JOIN w ON w.doc_id = f.doc_id AND w.a <= f.a AND f.a + f.n <= w.z""",
)
def facts_in_windows(spark, sf_dir):
    """Range join: spans of facts, every occurrence, within spans of fixed windows of the same document.

    A place can lie in two windows at most, so windows are named, not searched.
    """
    d, q = table(spark, sf_dir, "documents").select("doc_id", "text"), questions(spark, sf_dir).select("query_id", F.col("text").alias("fact"))
    held = gold(spark, sf_dir).withColumnRenamed("pos", "doc_id").join(q, "query_id").join(d, "doc_id")
    parts = F.split("text", F.concat(F.lit("\\Q"), "fact", F.lit("\\E")), -1)
    n = F.length("fact")
    each = held.select("doc_id", F.col("query_id").alias("item_id"), n.alias("n"), F.length("text").alias("size"), F.transform(parts, F.length).alias("l"))
    starts = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.aggregate(F.slice("l", 1, k), F.lit(0), lambda a, x: a + x) + (k - 1) * F.col("n"))
    f = each.select("doc_id", "item_id", "n", "size", F.explode(starts).alias("at"))
    last = F.floor(F.col("at") / 448).cast("int")
    w = f.withColumn("window", F.explode(F.array(last - 1, last))).where("window >= 0")
    return w.where("window * 448 <= at AND at + n <= least(window * 448 + 512, size)").select("item_id", "doc_id", "at", "window")


@register("mentions", f"WITH {sql.CORPUS}, term AS (SELECT query_id, list_distinct(t) AS need FROM qt WHERE len(t) > 0) SELECT query_id, pos FROM (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM term JOIN dt ON list_has_all(t, need)) WHERE rn <= 5")
def mentions(spark, sf_dir):
    """Documents that hold all tokens of a term, the first five by pos: tokens meet by equality, then are counted."""
    need = questions(spark, sf_dir).select("query_id", F.array_distinct(tx.tokenize(F.col("text"))).alias("need")).where("size(need) > 0")
    need = settle(need.select("query_id", F.explode("need").alias("token"), F.size("need").alias("n")))
    hit = index(spark, sf_dir).counts.select("token", "pos").join(need, "token").groupBy("query_id", "pos", "n").agg(F.count("*").alias("c")).where("c = n")
    return hit.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where("rn <= 5").select("query_id", "pos")


@register("quotes_in_cited", "SELECT b.item_id, bool_or(contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))) AS supported FROM benchmark b CROSS JOIN (SELECT d.text FROM documents d WHERE contains(lower(d.source), 'src1')) d GROUP BY b.item_id")
def quotes_in_cited(spark, sf_dir):
    """Quotes verbatim (but for case and white space) in some document of the cited sources."""
    cited = table(spark, sf_dir, "documents").where(F.lower("source").contains("src1")).select(F.col("doc_id").alias("pos"), tx.squash(F.col("text")).alias("text"))
    q = questions(spark, sf_dir).select("query_id", tx.squash(F.col("text")).alias("text"))
    hit = holding(cited, q).select("query_id").distinct().withColumn("s", F.lit(True))
    return q.join(hit, "query_id", "left").select(F.col("query_id").alias("item_id"), F.coalesce("s", F.lit(False)).alias("supported"))


@register("top_lineitems", "SELECT l_suppkey, l_orderkey, l_linenumber, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def top_lineitems(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


# ---- aggregates, sets and checks -------------------------------------------


@register("category_counts", "SELECT c AS category, count(lang) AS n FROM (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS c) LEFT JOIN documents ON lang = c GROUP BY c")
def category_counts(spark, sf_dir):
    return evalset.category_counts(table(spark, sf_dir, "documents"), "lang", ["en", "de", "fr", "es", "it"])


@register("repeated_texts", "SELECT digest, n FROM (SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) ORDER BY digest LIMIT 5")
def repeated_texts(spark, sf_dir):
    return store.duplicate_ids(table(spark, sf_dir, "documents").select(F.md5("text").alias("digest")), "digest")


@register("vocabulary", f"WITH {sql.CORPUS} SELECT count(DISTINCT token) AS n FROM (SELECT unnest(t) AS token FROM dt)")
def vocabulary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("text", F.lit("").alias("title"))
    return evalset.corpus_vocabulary(rows).agg(F.count("*").alias("n"))


@register(
    "corpus_fingerprint",
    "WITH b AS (SELECT doc_id // 4096 AS block, sha256(string_agg(sha256(doc_id || chr(31) || text), '' ORDER BY doc_id)) AS d, count(*) AS n FROM documents GROUP BY ALL) SELECT sha256(string_agg(d, '' ORDER BY block)) AS digest, sum(n)::BIGINT AS n FROM b",
)
def corpus_fingerprint(spark, sf_dir):
    return store.fingerprint(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "text"])


@register("reason_tallies", "SELECT CASE WHEN n_chars < 300 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN quality = 0 THEN 'quality' END AS reason, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE n_chars < 300 OR lang <> 'en' OR quality = 0 GROUP BY ALL")
def reason_tallies(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    reason = F.when(F.col("n_chars") < 300, "short").when(F.col("lang") != "en", "language").when(F.col("quality") == 0, "quality")
    return d.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@register(
    "item_rules",
    """WITH i AS (SELECT printf('eval_%03d', item_id) AS id, text AS q, item_id % 2 = 0 AS ok, item_id % 5 AS c FROM benchmark)
SELECT id, CASE WHEN c = 4 THEN 'blank question or answer' WHEN ok <> (c < 2) THEN 'answerable doesn''t fit the category' WHEN ok AND c = 1 THEN 'an answerable item needs gold chunks' END AS problem FROM i""",
)
def item_rules(spark, sf_dir):
    """Rules of evaluation items over items that break some of them."""
    n = F.col("query_id")
    kind = F.element_at(F.array(*[F.lit(c) for c in evalset.CATEGORIES]), (n % 5 + 1).cast("int"))
    ok = n % 2 == 0
    items = questions(spark, sf_dir).select(
        tx.item_id(n).alias("id"),
        F.when(n % 5 == 4, " ").otherwise(F.col("text")).alias("question"),
        ok.alias("is_answerable"),
        kind.alias("category"),
        F.when(ok & (n % 5 != 1), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("ground_truth_chunk_ids"),
        F.when(ok, "a real answer").otherwise(tx.ABSTENTION).alias("reference_answer"),
    )
    return items.select("id", evalset.problem().alias("problem"))


@register("latest_turns", "SELECT conv_id, turn, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_turns(spark, sf_dir):
    """The last record of each id wins."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conv_id", "turn", F.md5("text").alias("digest"))


@register(
    "merged_records",
    "WITH u AS (SELECT doc_id, quality, 0 AS fresh FROM labels UNION ALL SELECT doc_id, 1 - quality, 1 FROM labels WHERE doc_id % 3 = 0) SELECT doc_id, quality FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fresh DESC) = 1",
)
def merged_records(spark, sf_dir):
    """Upsert: new records replace old ones of their id."""
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    new = old.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"))
    both = old.withColumn("fresh", F.lit(0)).union(new.withColumn("fresh", F.lit(1)))
    return both.groupBy("doc_id").agg(F.max_by("quality", "fresh").alias("quality"))


@register("page_offsets", "SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS page_offset FROM conversations")
def page_offsets(spark, sf_dir):
    """Turns as the pages of a document: where each starts in the joined text."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return c.select("conv_id", F.explode(F.arrays_zip(F.transform("p", lambda x: x["turn"]).alias("turn"), chunks.page_offsets(F.transform("p", lambda x: x["text"])).alias("o"))).alias("z")).select("conv_id", F.col("z.turn").alias("turn"), F.col("z.o").alias("page_offset"))


@register(
    "page_lookup",
    """WITH o AS (SELECT conv_id, turn, row_number() OVER w AS page, coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, unnest([0, 100, 250, 600]) AS at FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT p.conv_id, p.at::INT AS at, max(page)::INT AS page FROM p JOIN o ON o.conv_id = p.conv_id AND o.o <= p.at GROUP BY ALL""",
)
def page_lookup(spark, sf_dir):
    """The page of an offset: the last page that starts at or before it."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    o = c.select("conv_id", chunks.page_offsets(F.transform("p", lambda x: x["text"])).alias("o")).select("conv_id", "o", F.explode(F.array(*[F.lit(x) for x in (0, 100, 250, 600)])).alias("at"))
    return o.select("conv_id", "at", F.size(F.filter("o", lambda x: x <= F.col("at"))).alias("page"))


@register("set_operations", f"WITH {sql.CORPUS}, a AS (SELECT query_id, list_distinct(t) AS x, list_distinct(t[1:10]) AS y FROM qt) SELECT query_id, len(list_intersect(x, y))::INT AS both, len(list_distinct(x || y))::INT AS either, len(list_filter(x, lambda e: NOT list_contains(y, e)))::INT AS only_first, list_has_all(x, y) AS subset FROM a")
def set_operations(spark, sf_dir):
    t = tx.tokenize(F.col("text"))
    q = questions(spark, sf_dir).select("query_id", F.array_distinct(t).alias("x"), F.array_distinct(F.slice(t, 1, 10)).alias("y"))
    return q.select("query_id", F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_union("x", "y")).alias("either"), F.size(F.array_except("x", "y")).alias("only_first"), (F.size(F.array_except("y", "x")) == 0).alias("subset"))


@register("first_unseen", "SELECT role, digest FROM (SELECT role, md5(k) AS digest, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM (SELECT *, lower(trim(text)) AS k FROM conversations QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY conv_id, turn) = 1)) WHERE rn <= 20")
def first_unseen(spark, sf_dir):
    """The first twenty of each group whose text (lower case, trimmed) hasn't occurred before."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.lower(F.trim("text")))
    once = c.withColumn("d", F.row_number().over(Window.partitionBy("k").orderBy("conv_id", "turn"))).where("d = 1")
    return once.withColumn("rn", F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn"))).where("rn <= 20").select("role", F.md5("k").alias("digest"))


_SYSTEM = "s AS (SELECT lang, source, n_chars >= 800 AS answered, quality = 1 AS answerable, toxic = 0 AS correct, n_chars / (n_chars + 1000.0::DOUBLE) AS f1 FROM labels JOIN documents USING (doc_id))"


def _system(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", "source", (F.col("n_chars") >= 800).alias("answered"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("correct"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("f1"))


@register(
    "system_metrics",
    f"""WITH {_SYSTEM} SELECT lang, round(avg(answered::INT), 6) AS coverage, round(1 - avg(correct::INT) FILTER (answered), 6) AS selective_risk, round(avg(answered::INT) FILTER (NOT answerable), 6) AS hallucination_rate,
round(avg((answered AND NOT correct)::INT) FILTER (answerable), 6) AS wrong_answer_rate, round(avg(CASE WHEN answerable THEN answered AND correct ELSE NOT answered END::INT), 6) AS accuracy,
round(avg((NOT (answerable AND correct))::INT) FILTER (NOT answered), 6) AS abstention_precision, round(avg((NOT answered)::INT) FILTER (NOT (answerable AND correct)), 6) AS abstention_recall, round(avg(f1) FILTER (answered AND answerable), 6) AS f1 FROM s GROUP BY lang""",
)
def system_metrics(spark, sf_dir):
    m = metrics.system_metrics(_system(spark, sf_dir), ["lang"])
    return m.select("lang", *[F.round(c, 6).alias(c) for c in m.columns if c != "lang"])


@register("outcomes_by_category", f"WITH {_SYSTEM} SELECT 'free' AS reader, source AS category, count(*) AS n, count(*) FILTER (answered) AS answered, count(*) FILTER (correct) AS correct, round(avg(f1) FILTER (answered AND answerable), 6) AS mean_f1_answered FROM s GROUP BY source")
def outcomes_by_category(spark, sf_dir):
    from ..operators.benchmark import by_category

    rows = _system(spark, sf_dir).withColumn("reader", F.lit("free")).withColumnRenamed("source", "category")
    return by_category(rows).withColumn("mean_f1_answered", F.round("mean_f1_answered", 6))


@register(
    "paired_differences",
    f"WITH {_SYSTEM}, a AS (SELECT source, avg(answered::INT) AS x, avg(correct::INT) AS y FROM s GROUP BY source) SELECT round(avg(x - y), 6) AS mean, round(avg((x < y)::INT), 6) AS share_negative, count(*) AS n FROM a",
)
def paired_differences(spark, sf_dir):
    """Differences of two systems per split, their mean and the share below 0; the sources stand for splits."""
    a = _system(spark, sf_dir).groupBy("source").agg(F.avg(F.col("answered").cast("double")).alias("x"), F.avg(F.col("correct").cast("double")).alias("y"))
    return a.agg(F.round(F.avg(F.col("x") - F.col("y")), 6).alias("mean"), F.round(F.avg((F.col("x") < F.col("y")).cast("double")), 6).alias("share_negative"), F.count("*").alias("n"))


@register(
    "gate_catches",
    f"WITH {_SYSTEM} SELECT source, count(*) AS seen, count(*) FILTER (NOT answered) AS caught, round(count(*) FILTER (NOT answered)::DOUBLE / count(*), 6) AS catch_rate FROM s WHERE NOT answerable GROUP BY source",
)
def gate_catches(spark, sf_dir):
    u = _system(spark, sf_dir).where("NOT answerable").groupBy("source").agg(F.count("*").alias("seen"), F.count_if(~F.col("answered")).alias("caught"))
    return u.select("source", "seen", "caught", F.round(F.col("caught") / F.col("seen"), 6).alias("catch_rate"))


@register("gate_score_remap", f"WITH {_SYSTEM} SELECT lang, round(sum(CASE WHEN answered THEN f1 ELSE -1.0 END), 6) AS total FROM s GROUP BY lang")
def gate_score_remap(spark, sf_dir):
    from ..operators.benchmark import gate_scores

    return gate_scores(_system(spark, sf_dir).withColumn("score", F.col("f1"))).groupBy("lang").agg(F.round(F.sum("score"), 6).alias("total"))


@register("citation_precision", f"WITH {GOLD}, c AS (SELECT item_id AS query_id, [item_id, item_id + 1, 29] AS cited FROM benchmark), g AS (SELECT query_id, list(pos) AS gold FROM gold GROUP BY query_id) SELECT query_id, round(len(list_intersect(cited, gold))::DOUBLE / len(cited), 6) AS value FROM c JOIN g USING (query_id)")
def citation_precision(spark, sf_dir):
    """Distinct gold among the citations over all citations listed."""
    c = questions(spark, sf_dir).select("query_id", F.array(F.col("query_id"), F.col("query_id") + 1, F.lit(29).cast("long")).alias("cited"))
    g = gold(spark, sf_dir).groupBy("query_id").agg(F.collect_list("pos").alias("gold"))
    return c.join(g, "query_id").select("query_id", F.round(F.size(F.array_intersect("cited", "gold")) / F.size("cited"), 6).alias("value"))


# ---- files ------------------------------------------------------------------


@register("pdf_pages", "SELECT doc_id, 2 AS n_pages, md5(trim(coalesce(text, ''), chr(10))) AS first, CASE WHEN trim(coalesce(text, ''), chr(10)) = '' THEN NULL ELSE 'the end of ' || coalesce(source, '') END AS last FROM documents")
def pdf_pages(spark, sf_dir):
    """Every document set as a PDF of two pages, one line after the other in UTF-16, and read back by the extractor."""
    line = lambda x: F.concat(F.lit("<FEFF"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj"))
    shown = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), " T* ")
    part = lambda n, body: F.concat(F.lit(f"{n} 0 obj\n"), body, F.lit("\nendobj\n"))
    stream = lambda body: F.concat(F.lit("<< >>\nstream\nBT "), body, F.lit(" ET\nendstream"))
    end = F.when(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "") != "", line(F.concat(F.lit("the end of "), F.coalesce("source", F.lit(""))))).otherwise(F.lit(""))
    content = F.concat(
        F.lit("%PDF-1.4\n"),
        part(1, F.lit("<< /Type /Catalog /Pages 2 0 R >>")),
        part(2, F.lit("<< /Type /Pages /Kids [3 0 R 5 0 R] /Count 2 >>")),
        part(3, F.lit("<< /Type /Page /Contents 4 0 R >>")),
        part(4, stream(shown)),
        part(5, F.lit("<< /Type /Page /Contents 6 0 R >>")),
        part(6, stream(end)),
        F.lit("trailer << /Root 1 0 R >>\n%%EOF\n"),
    )
    read = table(spark, sf_dir, "documents").select("doc_id", sources.extracted(sources.pdf_text)(F.encode(content, "UTF-8")).alias("x"))
    pages = F.coalesce(F.col("x.pages"), F.array())
    some = F.size(pages) > 0
    return read.select("doc_id", F.when(some, F.size(pages)).otherwise(2).alias("n_pages"), F.md5(F.coalesce(F.get(pages, 0), F.lit(""))).alias("first"), F.when(some, F.get(pages, 1)).alias("last"))
