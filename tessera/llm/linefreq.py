"""Quality rules from the frequency of lines across the documents of a host.

Lines are normalised (lower case, runs of white space as one space, trimmed)
and hashed to 128 bits. For every host and hash the distinct documents are
counted, copies of a text among them; a line in more documents of its host than
the limit is boilerplate and is removed; a document that keeps too few words is
rejected. All of it is
DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, SPACE, documents, spread_join, stored, unused, weighted_join

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """How many words stand in windows of so many words that occur twice or more.

    Sorts the windows' hashes with their places, keeps places whose hash equals
    a neighbour's, and adds up how many new words each kept window covers:
    n log n in the words of one text.
    """

    def windows(w):
        places = F.sequence(F.lit(0), F.size(w) - width)
        return F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.cast("int").alias("i"))))

    def kept(s):
        near = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"]))

    def covered(d):
        return F.aggregate(
            d,
            F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    return _let(words, lambda w: F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(_let(_let(windows(w), kept), covered)))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    squeezed = F.translate(text, BLANK, "")
    filled = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    (base,) = unused(docs.columns, "_base")
    return docs.select(
        "*",
        F.struct(
            _let(words_of(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))).alias("w"),
            F.length(squeezed).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _let(filled, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        ).alias(base),
    ).select(*docs.columns, f"{base}.w.n_words", f"{base}.word_chars", f"{base}.n_symbols", f"{base}.n_dup_lines", f"{base}.w.n_repeat_words")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_line(line: Column) -> Column:
    """A to Z in lower case, runs of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), f"[{SPACE}]+", " "))


def _tally(lines: Column) -> Column:
    """Distinct values of an array with their counts, by sorting it."""

    def runs(s):
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(starts, lambda b: F.transform(b, lambda i, j: F.struct(F.get(s, i).alias("line"), (F.coalesce(F.get(b, j + 1), F.size(s)) - i).cast("long").alias("times"))))

    return _let(F.array_sort(lines), runs)


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.col(text_col)))


def host_key(host_col: str) -> Column:
    """A host as text that tells a null from all others and is not null itself."""
    return F.concat(F.when(F.col(host_col).isNull(), "0").otherwise("1"), F.coalesce(F.col(host_col).cast("string"), F.lit("")))


def with_findings(rows: DataFrame, lines: DataFrame, found: DataFrame, host_col: str, text_col: str, value: str) -> DataFrame:
    """rows with what was found for their host and text (host, text, value), null where nothing was.

    A text with very many copies on a host is looked up in a broadcast, whether
    or not anything was found for it (see spread_join). lines: the line table.
    """
    host, text = unused([*rows.columns, value], "__host", "__text")
    keyed = rows.withColumns({host: host_key(host_col), text: text_key(text_col)})
    named = found.select(host_key("host").alias(host), F.col("text").alias(text), value)
    copies = stored(lines.groupBy(host_key("host").alias(host), F.col("text").alias(text)).agg(F.max("docs").alias("docs")), "copies")
    total = copies.agg(F.sum("docs")).first()[0] or 0
    many = copies.where(F.col("docs") * HEAVY > F.lit(total)).select(host, text)
    return spread_join(keyed, named, [host, text], value, many.join(named, [host, text], "left")).drop(host, text)


def line_table(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """One row per host, distinct text and distinct normalised line: hash, words of all its occurrences, and docs.

    docs is how many documents (rows) of the host have that text, so copies are
    counted and yet share a row. Rows without text have no lines; a null host
    is a host of its own.
    """
    lines = F.filter(F.transform(F.split(text_col, "\n"), normal_line), lambda x: x != "")
    return (
        docs.select(F.col(host_col).alias("host"), text_key(text_col).alias("text"), F.explode(_tally(lines)).alias("l"))
        .select("host", "text", F.unhex(F.md5("l.line")).alias("line"), (F.size(F.split("l.line", " ")) * F.col("l.times")).alias("words"))
        .groupBy("host", "text", "line")
        .agg(F.max("words").alias("words"), F.count("*").alias("docs"))
    )


def removed_words(lines: DataFrame, most_docs: int) -> DataFrame:
    """Per host and text: words in lines that stand in more than most_docs distinct documents of the host.

    Columns host, text (MD5), removed_words, from a stored line table; texts
    that lose nothing are absent. The counts are summed before they are
    shuffled; frequent lines are joined back by host and hash.
    """
    return in_frequent_lines(lines, most_docs).groupBy("host", "text").agg(F.sum("words").alias("removed_words"))


def in_frequent_lines(lines: DataFrame, most_docs: int) -> DataFrame:
    """Rows of a stored line table whose line stands in more than most_docs documents of the host.

    Lines that hold a large share of all rows are joined by broadcast, so none
    of them lands in one task (see weighted_join).
    """
    keyed = lines.withColumn("__host", host_key("host"))
    frequent = keyed.groupBy("__host", "line").agg(F.sum("docs").alias("n_docs"), F.count("*").alias("c")).where(F.col("n_docs") > most_docs).drop("n_docs")
    return weighted_join(keyed, frequent, ["__host", "line"], "c", lines.count()).drop("__host")


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", most_docs: int = 20, most_removed: float = 0.5) -> DataFrame:
    """All columns of docs with the base counts, removed_words, base_failed and kept.

    kept is false where base_failed, or where lines above the limit hold more
    than most_removed of the words. A null text has no words and fails the
    base rules. Every row keeps a verdict of its own; equal rows get equal
    ones. Columns of docs with the names of results are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"]
    docs = docs.drop(*[c for c in made if c not in (host_col, text_col)])
    lines = stored(line_table(docs, host_col, text_col), "lines")
    found = with_findings(base_counts(docs, text_col), lines, removed_words(lines, most_docs), host_col, text_col, "removed_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        found.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= most_removed * F.col("n_words")))
    )


def without_frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", most_docs: int = 20) -> DataFrame:
    """docs with every line above the limit taken out of its text.

    Each text meets the hashes of its own frequent lines only: they are
    gathered per host and text, no more of them than the text has lines. A null
    text stays null, lines without a word stay, copies of a text lose the same
    lines, and all other columns stay, whatever their names.
    """
    lines = stored(line_table(docs, host_col, text_col), "lines")
    (gone,) = unused(docs.columns, "__out")
    out = in_frequent_lines(lines, most_docs).groupBy("host", "text").agg(F.collect_set(F.hex("line")).alias(gone))
    met = with_findings(docs, lines, out, host_col, text_col, gone)
    kept = lambda x: (normal_line(x) == "") | ~F.array_contains(gone, F.upper(F.md5(normal_line(x))))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(F.split(text_col, "\n"), kept), "\n"))
    return met.withColumn(text_col, text).select(*docs.columns)


def op2_line_frequency(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; a document's source stands for its host."""
    out = judge(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
raw AS (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d),
filled AS (SELECT *, trim(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS nl FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM filled GROUP BY r),
freq AS (SELECT source, nl FROM filled GROUP BY source, nl HAVING count(DISTINCT r) > 20),
cut AS (SELECT r, sum(len(string_split(nl, ' '))) AS n FROM filled SEMI JOIN freq ON filled.source IS NOT DISTINCT FROM freq.source AND filled.nl = freq.nl GROUP BY r),
b AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, coalesce(cut.n, 0) AS removed
  FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN cut USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed <= 0.5 * n_words AS kept
FROM b
"""
