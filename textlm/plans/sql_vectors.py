"""DuckDB twins of the vector and vocabulary-id queries."""

from __future__ import annotations

from textlm.operators.vectors import softmax_weights
from textlm.plans.q_vectors import MIX_GAMMA, MIX_W, N_LAYERS, N_NEIGHBORS, N_RESTRICT
from textlm.plans.sql_lm import LINES, MODEL, SQL, with_


def _sum(e: str) -> str:
    return f"list_reduce({e}, lambda a, b: a + b)"


def _dot(a: str, b: str) -> str:
    return _sum(f"list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])")


def _stats(c: str, prefix: str) -> str:
    return (f"round(0.0 + {_sum(c)}, 9) AS {prefix}_sum, "
            f"round(0.0 + {_sum(f'list_transform({c}, lambda x: x * x)')}, 9) AS {prefix}_sq, "
            f"round({c}[1], 9) AS {prefix}_first, round({c}[-1], 9) AS {prefix}_last")


def _lit(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


VEC = f"""
vt AS (
  SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, vec_id,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec
  FROM embeddings
),
vtn AS (SELECT word, vec_id, vec, sqrt(0.0 + {_sum('list_transform(vec, lambda x: x * x)')}) AS nrm FROM vt),
vu AS (
  SELECT word, vec_id, vec, nrm,
         CASE WHEN nrm > 0 THEN list_transform(vec, lambda x: x / nrm) ELSE vec END AS u
  FROM vtn
),
pm AS (SELECT count(*) AS m FROM embeddings),
pairs AS (
  SELECT 'w' || CAST(i AS VARCHAR) AS w1, 'w' || CAST(j AS VARCHAR) AS w2,
         ((i * 31 + j * 17) % 100) / CAST(10.0 AS DOUBLE) AS score
  FROM (SELECT vec_id AS i, (vec_id * 7 + 3) % (m + m // 10) AS j FROM embeddings CROSS JOIN pm)
  WHERE i <> j
),
ps AS (
  SELECT p.w1, p.w2, p.score, {_dot('a.u', 'b.u')} AS sim
  FROM pairs p JOIN vu a ON a.word = p.w1 JOIN vu b ON b.word = p.w2
),
psz AS (
  SELECT p.w1, p.w2, p.score,
         CASE WHEN a.word IS NULL OR b.word IS NULL THEN 0.0 ELSE {_dot('a.u', 'b.u')} END AS sim,
         (a.word IS NULL OR b.word IS NULL) AS missing
  FROM pairs p LEFT JOIN vu a ON a.word = p.w1 LEFT JOIN vu b ON b.word = p.w2
)
"""

SQL["unit_vectors"] = with_(VEC) + f"SELECT word, round(nrm, 9) AS norm, {_stats('u', 'u')} FROM vu"
SQL["pair_similarity"] = with_(VEC) + "SELECT w1, w2, round(sim, 9) AS sim FROM ps"
SQL["most_similar"] = with_(VEC) + f"""
SELECT query, neighbor, rank::BIGINT AS rank, round(similarity, 9) AS similarity FROM (
  SELECT query, neighbor, similarity,
         row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbor ASC) AS rank
  FROM (SELECT a.word AS query, b.word AS neighbor, {_dot('a.u', 'b.u')} AS similarity
        FROM vu a JOIN vu b ON a.word <> b.word))
WHERE rank <= {N_NEIGHBORS}
"""
SQL["missing_pairs"] = with_(VEC) + """
SELECT DISTINCT p.w1, p.w2, p.score FROM pairs p
WHERE p.w1 NOT IN (SELECT word FROM vt) OR p.w2 NOT IN (SELECT word FROM vt)
"""
SQL["restricted_vectors"] = with_(VEC) + f"""
SELECT word, vec_id, round(nrm, 9) AS norm FROM vtn ORDER BY vec_id LIMIT {N_RESTRICT}
"""
SQL["pair_scores"] = with_(VEC) + "SELECT w1, w2, score, round(sim, 9) AS sim FROM ps"
SQL["pair_scores_zero"] = with_(VEC) + "SELECT w1, w2, score, round(sim, 9) AS sim, missing FROM psz"
SQL["unknown_ratio"] = with_(VEC) + """
SELECT count(*)::BIGINT AS n_pairs, sum(CAST(missing AS INTEGER))::BIGINT AS n_missing,
       round(avg(CAST(missing AS DOUBLE)), 9) AS unknown_ratio FROM psz
"""
_T = "r * sqrt((n - 2) / (1.0 - r * r))"
SQL["pearson"] = with_(VEC) + f"""
SELECT n, round(r, 9) AS r, round(CASE WHEN n > 2 THEN {_T} END, 6) AS t
FROM (SELECT count(*)::BIGINT AS n, corr(score, sim) AS r FROM ps)
"""
SQL["spearman"] = with_(VEC) + f"""
SELECT n, round(r, 9) AS rho, round(CASE WHEN n > 2 THEN {_T} END, 6) AS t
FROM (SELECT count(*)::BIGINT AS n, corr(rx, ry) AS r FROM (
  SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 AS ry
  FROM ps))
"""

# Student's t by the power series of the incomplete beta function, 3000 terms of it
SQL["correlation_pvalues"] = with_(VEC).replace("WITH ", "WITH RECURSIVE ", 1) + f""", corrs AS (
  SELECT 'pearson' AS test, count(*)::BIGINT AS n, corr(score, sim) AS r FROM ps
  UNION ALL
  SELECT 'spearman', count(*)::BIGINT, corr(rx, ry) FROM (
    SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx,
           rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 AS ry
    FROM ps)),
ts AS (SELECT test, n, r, {_T} AS t, n - 2.0 AS dof FROM corrs),
xs AS (SELECT *, dof / (dof + t * t) < (dof / 2 + 1.0) / (dof / 2 + 2.5) AS low FROM ts),
args AS MATERIALIZED (
  SELECT *, CASE WHEN low THEN dof / 2 ELSE 0.5 END AS a, CASE WHEN low THEN 0.5 ELSE dof / 2 END AS b,
         CASE WHEN low THEN dof / (dof + t * t) ELSE t * t / (dof + t * t) END AS x FROM xs),
series AS (
  SELECT test, 0 AS k, 1.0::DOUBLE AS term, 1.0::DOUBLE AS total, a, b, x FROM args
  UNION ALL
  SELECT test, k + 1, term * (a + b + k) / (a + 1 + k) * x, total + term * (a + b + k) / (a + 1 + k) * x, a, b, x
  FROM series WHERE k < 3000),
beta AS (SELECT g.*, exp(lgamma(g.a + g.b) - lgamma(g.a) - lgamma(g.b) + g.a * ln(g.x) + g.b * ln(1.0 - g.x)) * s.total / g.a AS v
         FROM args g JOIN series s ON s.test = g.test AND s.k = 3000),
ptab AS (SELECT *, CASE WHEN low THEN v ELSE 1.0 - v END AS p FROM beta)
SELECT test, n, round(r, 9) AS r, round(t, 6) AS t, round(p, 9) AS p, round(log10(p), 5) AS log10_p FROM ptab
"""

_W = 64 // N_LAYERS


def _mix(weights: list[float], gamma: float, top_only: bool = False, src: str = "vec") -> str:
    if top_only:
        k = N_LAYERS - 1
        return f"list_transform(range(1, {_W + 1}), lambda k: {src}[{k * _W} + k] * {_lit(gamma)})"
    terms = f"{src}[k] * {_lit(weights[0])}"
    for i in range(1, N_LAYERS):
        terms = f"({terms} + {src}[{i * _W} + k] * {_lit(weights[i])})"
    return f"list_transform(range(1, {_W + 1}), lambda k: {terms} * {_lit(gamma)})"


SQL["mixed_layers"] = with_(VEC) + (
    f"SELECT word, {_stats('mixed', 'mixed')} FROM (SELECT word, {_mix(softmax_weights(MIX_W), MIX_GAMMA)} AS mixed FROM vt)"
)
SQL["mixed_layers_top"] = with_(VEC) + (
    f"SELECT word, {_stats('mixed', 'mixed')} FROM "
    f"(SELECT word, {_mix(softmax_weights(MIX_W), MIX_GAMMA, top_only=True)} AS mixed FROM vt)"
)
_LN_STATS = ",\n".join(
    f"ln{i} AS (SELECT avg(x) AS m, var_pop(x) AS v FROM (SELECT unnest(list_slice(vec, {i * _W + 1}, {(i + 1) * _W})) AS x FROM vt))"
    for i in range(N_LAYERS)
)
_LN_VEC = "list_concat(" + ", ".join(
    f"list_transform(list_slice(vec, {i * _W + 1}, {(i + 1) * _W}), lambda x: (x - ln{i}.m) / sqrt(ln{i}.v + {_lit(1e-12)}))"
    for i in range(N_LAYERS)
) + ")"
SQL["layer_norm"] = with_(VEC, _LN_STATS) + (
    f"SELECT word, {_stats('mixed', 'mixed')} FROM (SELECT word, "
    f"{_mix(softmax_weights([0.0] * N_LAYERS), 1.0, src='nv')} AS mixed FROM "
    f"(SELECT word, {_LN_VEC} AS nv FROM vt CROSS JOIN " + ", ".join(f"ln{i}" for i in range(N_LAYERS)) + "))"
)

WIDX = """
widx AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word ASC) - 1 AS id FROM vocab),
wv AS (
  SELECT w.word, w.id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS vec
  FROM widx w JOIN embeddings e ON e.vec_id = w.id
)
"""
SQL["vocab_min10"] = with_(LINES, MODEL) + "SELECT word, n::BIGINT AS n FROM vocab WHERE n >= 10"
SQL["word_index"] = with_(LINES, MODEL, WIDX) + "SELECT word, n::BIGINT AS n, id::BIGINT AS id FROM widx"
SQL["vocab_size"] = with_(LINES, MODEL) + "SELECT count(*)::BIGINT AS vocab_size FROM vocab"
SQL["test_words_in_vocab"] = with_(LINES, MODEL) + """
SELECT t.word, t.n::BIGINT AS n, (v.word IS NOT NULL) AS in_vocab
FROM (SELECT w AS word, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM test_sent) GROUP BY w) t
LEFT JOIN vocab v ON v.word = t.word
"""
SQL["token_vectors"] = with_(LINES, MODEL, WIDX) + f"""
SELECT DISTINCT w.word, round(sqrt(0.0 + {_sum('list_transform(w.vec, lambda x: x * x)')}), 9) AS norm
FROM wv w JOIN (SELECT DISTINCT unnest(tokens) AS word FROM test_sent) t ON t.word = w.word
"""
SQL["sentence_layers"] = with_(LINES, MODEL, WIDX) + f"""
, bl AS (
  SELECT item_id AS doc_id, unnest(range(len(p))) AS line, unnest(p) AS value
  FROM (SELECT item_id, CASE WHEN p0[-1] = '' THEN p0[1:len(p0) - 1] ELSE p0 END AS p
        FROM (SELECT item_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS p0 FROM benchmark))
),
bs AS (
  SELECT doc_id, line, regexp_extract_all(trim(value) || ' endofline', (SELECT '{{PAT}}'), 0) AS tokens FROM bl
),
bt AS (SELECT doc_id, line, unnest(range(len(tokens))) AS pos, unnest(tokens) AS word FROM bs),
bj AS (SELECT bt.*, {_sum('wv.vec')} AS s FROM bt JOIN wv ON wv.word = bt.word)
SELECT doc_id, line::BIGINT AS line, pos::BIGINT AS pos, word,
       round(avg(s) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS l1_sum,
       round(avg(s) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS l2_sum
FROM bj
"""
from textlm.functions.text import TOKEN_PATTERN  # noqa: E402

SQL["sentence_layers"] = SQL["sentence_layers"].replace("(SELECT '{PAT}')", f"'{TOKEN_PATTERN}'")
