"""DuckDB twins of the encoding, batching, sequence and bidirectional queries."""

from __future__ import annotations

from textlm.functions.text import WHITESPACE
from textlm.plans.q_encode import BATCH, CHAR_MAXLEN, CHUNK_ROWS, CHUNK_STEPS, MIN_COUNT, MINIBATCH, VAL_FRAC
from textlm.plans.sql_lm import LINES, MODEL, SQL, with_
from textlm.plans.sql_vectors import WIDX


def ws(v: str) -> str:
    return "list_filter(string_split_regex(" + v + ", '" + WHITESPACE + "'), lambda x: x <> '')"


SV = f"""
ws_train AS (SELECT l.doc_id, l.line, {ws('l.value')} AS toks FROM doc_lines l JOIN train_docs t ON t.doc_id = l.doc_id),
wsv AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(toks) AS w FROM ws_train) GROUP BY w),
svocab AS (
  SELECT '<S>' AS word, CAST(0 AS BIGINT) AS id UNION ALL SELECT '</S>', 1 UNION ALL SELECT '<UNK>', 2
  UNION ALL SELECT word, 2 + row_number() OVER (ORDER BY n DESC, word ASC) FROM wsv
  WHERE n >= 2 AND word NOT IN ('<S>', '</S>', '<UNK>')
),
b_lines AS (
  SELECT item_id AS doc_id, unnest(range(len(p))) AS line, unnest(p) AS value
  FROM (SELECT item_id, CASE WHEN p0[-1] = '' THEN p0[1:len(p0) - 1] ELSE p0 END AS p
        FROM (SELECT item_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS p0 FROM benchmark))
),
b_ws AS (SELECT doc_id, line, {ws('value')} AS tokens FROM b_lines),
b_tok AS (SELECT doc_id, line, unnest(range(len(tokens))) AS pos, unnest(tokens) AS word FROM b_ws),
b_rtok AS (SELECT doc_id, line, unnest(range(len(tokens))) AS pos, unnest(list_reverse(tokens)) AS word FROM b_ws),
b_enc AS (
  SELECT t.doc_id, t.line, [0] || list(coalesce(v.id, 2) ORDER BY t.pos) || [1] AS ids
  FROM b_tok t LEFT JOIN svocab v ON v.word = t.word GROUP BY t.doc_id, t.line
  UNION ALL SELECT doc_id, line, [0, 1] FROM b_ws WHERE len(tokens) = 0
),
b_renc AS (
  SELECT t.doc_id, t.line, [1] || list(coalesce(v.id, 2) ORDER BY t.pos) || [0] AS ids
  FROM b_rtok t LEFT JOIN svocab v ON v.word = t.word GROUP BY t.doc_id, t.line
  UNION ALL SELECT doc_id, line, [1, 0] FROM b_ws WHERE len(tokens) = 0
)
"""

M = CHAR_MAXLEN


def _pad(k: str, val: str = "260") -> str:
    return f"list_transform(range({k}), lambda _q: {val})"


CHARS = f"""
b_words AS (SELECT DISTINCT word FROM b_tok),
b_wc AS (
  SELECT word, CASE
    WHEN word = '<S>' THEN [258, 256, 259] || {_pad(M - 3)}
    WHEN word = '</S>' THEN [258, 257, 259] || {_pad(M - 3)}
    ELSE [258] || list_transform(range(nb), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER))
         || [259] || {_pad(f'{M - 2} - nb')} END AS cid
  FROM (SELECT word, h, CAST(least(length(h) // 2, {M - 2}) AS INTEGER) AS nb
        FROM (SELECT word, upper(hex(encode(word))) AS h FROM b_words))
),
b_chars AS (
  SELECT t.doc_id, t.line,
         [[258, 256, 259] || {_pad(M - 3)}] || list(c.cid ORDER BY t.pos) || [[258, 257, 259] || {_pad(M - 3)}] AS chars
  FROM b_tok t JOIN b_wc c ON c.word = t.word GROUP BY t.doc_id, t.line
  UNION ALL SELECT doc_id, line, [[258, 256, 259] || {_pad(M - 3)}, [258, 257, 259] || {_pad(M - 3)}]
  FROM b_ws WHERE len(tokens) = 0
)
"""

BATCHES = f"""
b_tb AS (SELECT doc_id, line, ids, (row_number() OVER (ORDER BY doc_id, line) - 1) // {BATCH} AS batch FROM b_enc),
b_tp AS (
  SELECT doc_id, line, batch,
         list_transform(ids, lambda x: x + 1) || {_pad('w - len(ids)', '0')} AS padded
  FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS w FROM b_tb)
),
b_cb AS (SELECT doc_id, line, chars, (row_number() OVER (ORDER BY doc_id, line) - 1) // {BATCH} AS batch FROM b_chars),
b_cp AS (
  SELECT doc_id, line, batch,
         list_transform(chars, lambda rw: list_transform(rw, lambda x: x + 1))
         || list_transform(range(w - len(chars)), lambda _r: {_pad(M, '0')}) AS padded
  FROM (SELECT *, max(len(chars)) OVER (PARTITION BY batch) AS w FROM b_cb)
)
"""

SQL["ws_tokens"] = with_(LINES) + (
    f"SELECT doc_id, line::BIGINT AS line, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens "
    f"FROM (SELECT doc_id, line, {ws('value')} AS t FROM doc_lines)"
)
SQL["reversed_sentences"] = with_(LINES) + (
    f"SELECT doc_id, line::BIGINT AS line, array_to_string(list_reverse(t), ' ') AS tokens "
    f"FROM (SELECT doc_id, line, {ws('value')} AS t FROM doc_lines)"
)
SQL["special_vocab"] = with_(LINES, SV) + "SELECT word, id::BIGINT AS id FROM svocab"
SQL["encoded_sentences"] = with_(LINES, SV) + "SELECT doc_id, line::BIGINT AS line, array_to_string(ids, ',') AS ids FROM b_enc"
SQL["encoded_reversed"] = with_(LINES, SV) + "SELECT doc_id, line::BIGINT AS line, array_to_string(ids, ',') AS ids FROM b_renc"
SQL["decoded_sentences"] = with_(LINES, SV) + """
SELECT e.doc_id, e.line::BIGINT AS line, array_to_string(list(v.word ORDER BY e.pos), ' ') AS text
FROM (SELECT doc_id, line, unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM b_enc) e
LEFT JOIN svocab v ON v.id = e.id GROUP BY e.doc_id, e.line
"""
SQL["word_char_ids"] = with_(LINES, SV, CHARS) + "SELECT word, array_to_string(cid, ',') AS char_ids FROM b_wc"
SQL["encoded_chars"] = with_(LINES, SV, CHARS) + (
    "SELECT doc_id, line::BIGINT AS line, len(chars)::BIGINT AS n_rows, array_to_string(flatten(chars), ',') AS chars "
    "FROM b_chars"
)
SQL["padded_batches"] = with_(LINES, SV, CHARS, BATCHES) + (
    "SELECT doc_id, line::BIGINT AS line, batch::BIGINT AS batch, array_to_string(padded, ',') AS padded FROM b_tp"
)
SQL["padded_char_batches"] = with_(LINES, SV, CHARS, BATCHES) + (
    "SELECT doc_id, line::BIGINT AS line, batch::BIGINT AS batch, len(padded)::BIGINT AS n_rows, "
    "array_to_string(flatten(padded), ',') AS padded FROM b_cp"
)
SQL["masks_lengths"] = with_(LINES, SV, CHARS, BATCHES) + """
SELECT t.doc_id, t.line::BIGINT AS line, len(list_filter(t.padded, lambda x: x > 0))::BIGINT AS length,
       (len(list_filter(t.padded, lambda x: x > 0)) - 2)::BIGINT AS length_wo_markers,
       len(list_filter(c.padded, lambda rw: len(list_filter(rw, lambda x: x > 0)) > 0))::BIGINT AS char_length
FROM b_tp t JOIN b_cp c ON c.doc_id = t.doc_id AND c.line = t.line
"""

SEQ = f"""
widx10 AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word ASC) - 1 AS id FROM vocab WHERE n >= {MIN_COUNT}),
seq AS (
  SELECT g.doc_id, g.line, g.pos, a.id AS c1, b.id AS c2, c.id AS y
  FROM train_grams g JOIN widx10 a ON a.word = g.w1 JOIN widx10 b ON b.word = g.w2 JOIN widx10 c ON c.word = g.w3
),
seq_n AS (SELECT *, row_number() OVER (ORDER BY doc_id, line, pos) - 1 AS rn, count(*) OVER () AS n_all FROM seq),
seq_split AS (
  SELECT *, CASE WHEN rn < floor(n_all * CAST('{1.0 - VAL_FRAC!r}' AS DOUBLE)) THEN 'train'
                 WHEN rn >= n_all - floor(n_all * CAST('{VAL_FRAC!r}' AS DOUBLE)) THEN 'val' END AS split
  FROM seq_n
)
"""
SEQ_OUT = "doc_id, line::BIGINT AS line, pos::BIGINT AS pos, c1::BIGINT AS c1, c2::BIGINT AS c2, y::BIGINT AS y"
SQL["training_sequences"] = with_(LINES, MODEL, SEQ) + f"SELECT {SEQ_OUT} FROM seq"
SQL["training_sequences_ext"] = with_(LINES, MODEL, WIDX, SEQ) + f"""
SELECT {SEQ_OUT} FROM (
  SELECT g.doc_id, g.line, g.pos, a.id AS c1, b.id AS c2, c.id AS y
  FROM train_grams g JOIN wv a ON a.word = g.w1 JOIN wv b ON b.word = g.w2 JOIN widx10 c ON c.word = g.w3)
"""
SQL["tail_split"] = with_(LINES, MODEL, SEQ) + (
    "SELECT doc_id, line::BIGINT AS line, pos::BIGINT AS pos, rn::BIGINT AS rn, split FROM seq_split WHERE split IS NOT NULL"
)
SQL["minibatches"] = with_(LINES, MODEL, SEQ) + f"""
SELECT doc_id, line::BIGINT AS line, pos::BIGINT AS pos, (rn // {MINIBATCH})::BIGINT AS batch
FROM seq_split WHERE split = 'train'
  AND rn // {MINIBATCH} < (SELECT count(*) FROM seq_split WHERE split = 'train') // {MINIBATCH}
"""


def _chunks(src: str, p: str) -> str:
    return f"""
{p}_num AS (SELECT ids, row_number() OVER (ORDER BY doc_id, line) - 1 AS s FROM {src}),
{p}_per AS (SELECT s, ids, s % {CHUNK_ROWS} AS row, greatest(len(ids) - 1, 0) AS np FROM {p}_num),
{p}_cum AS (
  SELECT *, coalesce(sum(np) OVER (PARTITION BY row ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM {p}_per
),
{p}_pairs AS (
  SELECT row, off + t AS k, ids[t + 1] AS x, ids[t + 2] AS y
  FROM (SELECT row, off, ids, unnest(range(np)) AS t FROM {p}_cum)
),
{p}_lim AS (SELECT min(tot // {CHUNK_STEPS}) AS nch FROM (SELECT row, sum(np) AS tot FROM {p}_per GROUP BY row)),
{p}_chunks AS (
  SELECT row, k // {CHUNK_STEPS} AS chunk, array_to_string(list(x ORDER BY k), ',') AS inputs,
         array_to_string(list(y ORDER BY k), ',') AS targets
  FROM {p}_pairs, {p}_lim WHERE k // {CHUNK_STEPS} < nch GROUP BY row, k // {CHUNK_STEPS}
)"""


SQL["next_token_chunks"] = with_(LINES, SV, _chunks("b_enc", "f")) + (
    "SELECT row::BIGINT AS row, chunk::BIGINT AS chunk, inputs, targets FROM f_chunks"
)
SQL["bidirectional_pairs"] = with_(LINES, SV, _chunks("b_enc", "f"), _chunks("b_renc", "r")) + """
SELECT f.row::BIGINT AS row, f.chunk::BIGINT AS chunk, f.inputs, f.targets,
       r.inputs AS inputs_rev, r.targets AS targets_rev
FROM f_chunks f JOIN r_chunks r ON r.row = f.row AND r.chunk = f.chunk
"""


def _model(src: str, p: str) -> str:
    return f"""
{p}_vocab AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM {src}) GROUP BY w),
{p}_csize AS (SELECT coalesce(sum(len(tokens)), 0)::BIGINT AS corpus_size FROM {src}),
{p}_uni AS (SELECT word, n / corpus_size AS p FROM {p}_vocab CROSS JOIN {p}_csize),
{p}_g AS (SELECT tokens[i - 2] AS w1, tokens[i - 1] AS w2, tokens[i] AS w3
          FROM (SELECT tokens, unnest(range(3, len(tokens) + 1)) AS i FROM {src})),
{p}_tri AS (SELECT w1, w2, w3, c / sum(c) OVER (PARTITION BY w1, w2) AS p
            FROM (SELECT w1, w2, w3, count(*) AS c FROM {p}_g GROUP BY w1, w2, w3))"""


def _loss(src: str, p: str, name: str, fwd: bool) -> str:
    return f"""
{name} AS (
  SELECT g.doc_id, g.label, {str(fwd).upper()} AS is_fwd, -ln(coalesce(t.p, u.p, 0.99::DOUBLE / m.corpus_size)) AS loss
  FROM (SELECT doc_id, label, tokens[i - 2] AS w1, tokens[i - 1] AS w2, tokens[i] AS w3
        FROM (SELECT doc_id, label, tokens, unnest(range(3, len(tokens) + 1)) AS i FROM {src})) g
  LEFT JOIN {p}_tri t ON t.w1 = g.w1 AND t.w2 = g.w2 AND t.w3 = g.w3
  LEFT JOIN {p}_uni u ON u.word = g.w3 CROSS JOIN {p}_csize m
)"""


BILM = f"""
tr_ws AS (SELECT l.doc_id, {ws('l.value')} AS w FROM doc_lines l JOIN train_docs t ON t.doc_id = l.doc_id),
tr_f AS (SELECT ['<S>', '<S>'] || w || ['</S>'] AS tokens FROM tr_ws),
tr_b AS (SELECT ['</S>', '</S>'] || list_reverse(w) || ['<S>'] AS tokens FROM tr_ws),
te_ws AS (SELECT l.doc_id, t.label, {ws('l.value')} AS w FROM doc_lines l JOIN test_docs t ON t.doc_id = l.doc_id),
te_f AS (SELECT doc_id, label, ['<S>', '<S>'] || w || ['</S>'] AS tokens FROM te_ws),
te_b AS (SELECT doc_id, label, ['</S>', '</S>'] || list_reverse(w) || ['<S>'] AS tokens FROM te_ws),
{_model('tr_f', 'mf').strip()},
{_model('tr_b', 'mb').strip()},
{_loss('te_f', 'mf', 'lf', True).strip()},
{_loss('te_b', 'mb', 'lb', False).strip()},
bilm AS (
  SELECT doc_id, label, sum(CAST(is_fwd AS INTEGER))::BIGINT AS n_steps,
         exp((avg(loss) FILTER (WHERE is_fwd) + avg(loss) FILTER (WHERE NOT is_fwd)) / 2.0) AS bidirectional,
         exp(avg(loss) FILTER (WHERE is_fwd)) AS unidirectional
  FROM (SELECT * FROM lf UNION ALL SELECT * FROM lb) GROUP BY doc_id, label
)
"""
SQL["bidirectional_perplexity"] = with_(LINES, BILM) + (
    "SELECT doc_id, label, n_steps, round(bidirectional, 4) AS perplexity FROM bilm"
)
SQL["unidirectional_perplexity"] = with_(LINES, BILM) + (
    "SELECT doc_id, label, n_steps, round(unidirectional, 4) AS perplexity FROM bilm"
)

from textlm.plans.sql_lm import GEN  # noqa: E402

SQL["validation_loss"] = with_(LINES, MODEL, SEQ, GEN) + """
, vw AS (
  SELECT g.* FROM (SELECT doc_id, line, pos FROM seq_split WHERE split = 'val') v
  JOIN train_grams g ON g.doc_id = v.doc_id AND g.line = v.line AND g.pos = v.pos
)
SELECT count(*)::BIGINT AS n, round(avg(-ln(t.p)), 9) AS loss,
       round(avg(CAST(b.next_word = vw.w3 AS DOUBLE)), 9) AS accuracy
FROM vw LEFT JOIN tri_p t ON t.w1 = vw.w1 AND t.w2 = vw.w2 AND t.w3 = vw.w3
LEFT JOIN best b ON b.w1 = vw.w1 AND b.w2 = vw.w2
"""
