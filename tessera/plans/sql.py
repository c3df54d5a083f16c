"""Pieces of DuckDB SQL that the oracles of several queries share."""

from __future__ import annotations

from ..functions.text import PUNCTUATION, STOP_WORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+'), lambda t: NOT list_contains({STOP}, t))"


def answer(column: str) -> str:
    """Normalised answer text."""
    quoted = PUNCTUATION.replace("'", "''")
    words = f"regexp_split_to_array(translate(lower({column}), '{quoted}', ''), '\\s+')"
    return f"array_to_string(list_filter({words}, lambda x: x NOT IN ('a', 'an', 'the', '')), ' ')"


CORPUS = f"""
corpus AS (SELECT doc_id AS pos, text FROM documents),
queries AS (SELECT item_id AS query_id, text FROM benchmark),
dt AS MATERIALIZED (SELECT pos, {tokens('text')} AS t FROM corpus),
qt AS (SELECT query_id, {tokens('text')} AS t FROM queries),
qtok AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(t) AS token FROM qt) GROUP BY ALL)
"""

BM25_INDEX = """
dl AS (SELECT pos, len(t)::BIGINT AS dl FROM dt),
tf AS MATERIALIZED (SELECT pos, token, count(*) AS tf FROM (SELECT pos, unnest(t) AS token FROM dt) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
voc0 AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, tot GROUP BY token),
voc AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM voc0) ELSE raw END AS idf FROM voc0),
post AS (SELECT token, pos, idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS weight FROM tf JOIN voc USING (token) JOIN dl USING (pos), tot)
"""


def topk(hits: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM ({hits}) QUALIFY rank <= {k}"


SPARSE = "SELECT query_id, pos, sum(times * weight) AS score FROM qtok JOIN post USING (token) GROUP BY ALL"

BAGS = """
dbag0 AS (SELECT pos, ('0x' || right(md5(token), 2))::INT AS bucket, count(*) AS c FROM (SELECT pos, unnest(t) AS token FROM dt) GROUP BY ALL),
dbag AS (SELECT pos, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY pos)) AS w FROM dbag0),
qbag0 AS (SELECT query_id, ('0x' || right(md5(token), 2))::INT AS bucket, count(*) AS c FROM (SELECT query_id, unnest(t) AS token FROM qt) GROUP BY ALL),
qbag AS (SELECT query_id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS w FROM qbag0),
near AS (SELECT query_id, pos, sum(q.w * d.w) AS score FROM qbag q JOIN dbag d USING (bucket) GROUP BY ALL)
"""
DENSE = "SELECT query_id, pos, coalesce(score, 0) AS score FROM (SELECT query_id, pos FROM queries, corpus) LEFT JOIN near USING (query_id, pos)"


def hybrid(depth: int = 50) -> str:
    """CTEs sparse, dense and fused (all rows, ranked)."""
    return f"""
sparse AS ({topk(SPARSE, depth)}),
dense AS ({topk(DENSE, depth)}),
joined AS (SELECT query_id, pos, s.rank AS bm25_rank, s.score AS bm25_score, d.rank AS dense_rank, d.score AS dense_score,
  coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) AS score FROM sparse s FULL JOIN dense d USING (query_id, pos)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, least(coalesce(bm25_rank, 1000000), coalesce(dense_rank, 1000000)), pos) AS rank FROM joined)
"""


BASE = f"WITH {CORPUS}, {BM25_INDEX}"
HYBRID = f"{BASE}, {BAGS}, {hybrid()}"

#: Lexical features of all fused candidates (query_id, pos): feats.
GRAMS = "list_distinct(list_transform(generate_series(1, length({0})), lambda i: substr('#' || {0} || '#', i, 3)))"
FEATURES = f"""
pairs AS (SELECT query_id, pos, qt.t AS q, dt.t AS d FROM fused JOIN qt USING (query_id) JOIN dt USING (pos) WHERE rank <= 50),
cnt AS (SELECT query_id, count(*) AS n, any_value(q) AS q FROM pairs GROUP BY query_id),
qterm AS (SELECT query_id, n, unnest(list_distinct(q)) AS term FROM cnt),
dterm AS (SELECT query_id, pos, unnest(list_distinct(d)) AS other FROM pairs),
dfreq AS (SELECT query_id, other AS term, count(*) AS df FROM dterm GROUP BY ALL),
idf AS (SELECT query_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM qterm LEFT JOIN dfreq USING (query_id, term)),
total AS (SELECT query_id, sum(idf) AS total, count(*) AS nq FROM idf GROUP BY query_id),
hit AS (SELECT d.query_id, d.pos, sum(i.idf) AS hit, count(*) AS m FROM dterm d JOIN idf i ON i.query_id = d.query_id AND i.term = d.other GROUP BY d.query_id, d.pos),
occ AS (SELECT query_id, pos, i, d[i] AS term FROM (SELECT query_id, pos, q, d, unnest(generate_series(1, len(d))) AS i FROM pairs) WHERE list_contains(q, d[i])),
lasts AS (SELECT a.query_id, a.pos, a.i AS e, b.term, max(b.i) AS p FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.pos = b.pos AND b.i <= a.i GROUP BY ALL),
spans AS (SELECT query_id, pos, min(width) AS span FROM (SELECT l.query_id, l.pos, e, e - min(p) + 1 AS width, count(*) AS c, any_value(m) AS m FROM lasts l JOIN hit h ON h.query_id = l.query_id AND h.pos = l.pos GROUP BY l.query_id, l.pos, e) WHERE c = m GROUP BY ALL),
qbi AS (SELECT query_id, list_distinct(list_zip(q[:-2], q[2:])) AS g FROM cnt),
bi AS (SELECT query_id, pos, CASE WHEN len(g) > 0 THEN len(list_intersect(g, list_zip(d[:-2], d[2:])))::DOUBLE / len(g) ELSE 0 END AS bigram FROM pairs JOIN qbi USING (query_id)),
qg AS (SELECT term, len(g) AS a, unnest(g) AS t FROM (SELECT term, {GRAMS.format('term')} AS g FROM (SELECT DISTINCT term FROM qterm))),
dg AS (SELECT other, len(g) AS b, unnest(g) AS t FROM (SELECT other, {GRAMS.format('other')} AS g FROM (SELECT DISTINCT other FROM dterm))),
close AS (SELECT term, other, count(*)::DOUBLE / (any_value(a) + any_value(b) - count(*)) AS sim FROM qg JOIN dg USING (t) GROUP BY ALL),
bestsim AS (SELECT q.query_id, d.pos, q.term, max(sim) AS sim FROM qterm q JOIN dterm d USING (query_id) JOIN close c ON c.term = q.term AND c.other = d.other GROUP BY ALL),
fz AS (SELECT query_id, pos, sum(sim) AS sim FROM bestsim GROUP BY ALL),
feats AS (SELECT query_id, pos,
  CASE WHEN ok THEN coalesce(hit / total, 0) ELSE 0 END AS coverage,
  CASE WHEN ok AND m >= 2 THEN (m / nq::DOUBLE) * (m / span::DOUBLE) ELSE 0 END AS proximity,
  CASE WHEN ok THEN bigram ELSE 0 END AS bigram,
  CASE WHEN ok THEN coalesce(sim, 0) / nq ELSE 0 END AS fuzzy
  FROM (SELECT *, len(q) > 0 AND len(d) > 0 AS ok FROM pairs) LEFT JOIN total USING (query_id) LEFT JOIN hit USING (query_id, pos) LEFT JOIN spans USING (query_id, pos) LEFT JOIN bi USING (query_id, pos) LEFT JOIN fz USING (query_id, pos)),
scored AS (SELECT *, -5 + 6 * coverage + 3 * proximity + 2 * bigram + fuzzy AS logit FROM feats),
reranked AS (SELECT f.*, logit, row_number() OVER (PARTITION BY f.query_id ORDER BY round(logit, 9) DESC, f.rank) AS final_rank FROM scored s JOIN fused f USING (query_id, pos))
"""
RERANKED = f"{HYBRID}, {FEATURES}"


def drawn(rows: str, by: str, times: int = 1000, seed: int = 0) -> str:
    """CTEs that end in `picked`: per resample the rows drawn from groups of one block.

    rows: a query of the columns in by, i (place from 0) and m (rows of the
    group). picked has by, r and i.
    """
    from ..operators.resample import MULTIPLIERS, block_key

    wide = lambda shift, factor: f"((xor(x, x >> {shift})::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"""numbered AS MATERIALIZED ({rows}),
sizes AS (SELECT DISTINCT {by}, m FROM numbered),
x0 AS (SELECT {by}, m, r, xor({block_key(seed, 0)}::UBIGINT, (r * 4294967296 + j)::UBIGINT) AS x FROM (SELECT *, unnest(range(m)) AS j FROM (SELECT *, unnest(range({times})) AS r FROM sizes))),
x1 AS (SELECT {by}, m, r, {wide(30, MULTIPLIERS[0])} AS x FROM x0),
x2 AS (SELECT {by}, m, r, {wide(27, MULTIPLIERS[1])} AS x FROM x1),
picked AS (SELECT {by}, r, (xor(x, x >> 31) % m::UBIGINT)::BIGINT AS i FROM x2)"""


def newton(data: str, by: str, d: int, l2: str, steps: int = 12) -> str:
    """CTEs that end in w{steps} (by, w0 ... w{d}): penalised logistic fits by Newton steps, for one or two features.

    data: a query of by, y and z0 ... z{d-1}, standardised; l2: an expression of
    the penalty.
    """
    z = [f"z{i}" for i in range(d)] + ["1"]
    logit = " + ".join(f"w{i} * {x}" for i, x in enumerate(z))
    pull = [l2] * d + ["1e-9::DOUBLE"]
    sums = ", ".join([f"sum(p * (1 - p) * {z[i]} * {z[j]}) + {pull[i] if i == j else 0} AS h{i}{j}" for i in range(d + 1) for j in range(i, d + 1)] + [f"sum((p - y) * {z[i]}) + {pull[i]} * any_value(w{i}) AS g{i}" for i in range(d + 1)] + [f"any_value(w{i}) AS w{i}" for i in range(d + 1)])
    if d == 1:
        moves = ["(g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01)", "(g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01)"]
    else:
        det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
        moves = [
            f"(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / {det}",
            f"(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / {det}",
            f"(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / {det}",
        ]
    out = [f"data AS MATERIALIZED ({data})", f"w0_ AS (SELECT DISTINCT {by}, {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(d + 1))} FROM data)"]
    for k in range(1, steps + 1):
        out.append(f"p{k}_ AS (SELECT *, 0.5 * (1 + tanh(0.5 * ({logit}))) AS p FROM data JOIN w{k - 1}_ USING ({by}))")
        out.append(f"s{k}_ AS (SELECT {by}, {sums} FROM p{k}_ GROUP BY {by})")
        out.append(f"w{k}_ AS MATERIALIZED (SELECT {by}, {', '.join(f'w{i} - {m} AS w{i}' for i, m in enumerate(moves))} FROM s{k}_)")
    return ",\n".join(out)
