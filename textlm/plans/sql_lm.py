"""DuckDB twins of the language-model queries, plus the shared SQL fragments.

Views ``documents labels benchmark embeddings conversations ...`` are
registered by the caller.  Lists are 1-based here, arrays 0-based in Spark.
Every output column is aliased and cast like its Spark twin; floats are
rounded with the same digits as ``catalog.py``.
"""

from __future__ import annotations

from textlm.functions.text import EOL_TOKEN, TOKEN_PATTERN

SQL: dict[str, str] = {}

# ----------------------------------------------------------------- fragments
LINES = r"""
doc_pieces AS (
  SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS pieces FROM documents
),
doc_lines AS (
  SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS value
  FROM (SELECT doc_id,
               CASE WHEN p0[-1] = '' THEN p0[1:len(p0) - 1] ELSE p0 END AS p
        FROM (SELECT doc_id, pieces AS p0 FROM doc_pieces))
),
sentences AS (
  SELECT doc_id, line, value,
         regexp_extract_all(trim(value) || ' __EOL__', '__PAT__', 0) AS tokens
  FROM doc_lines
),
test_docs AS (
  SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS label
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
),
train_docs AS (
  SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
),
train_sent AS (SELECT s.* FROM sentences s JOIN train_docs USING (doc_id)),
test_sent AS (SELECT s.*, t.label FROM sentences s JOIN test_docs t USING (doc_id))
""".replace("__PAT__", TOKEN_PATTERN).replace("__EOL__", EOL_TOKEN)

MODEL = r"""
vocab AS (
  SELECT w AS word, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM train_sent) GROUP BY w
),
csize AS (SELECT coalesce(sum(len(tokens)), 0)::BIGINT AS corpus_size FROM train_sent),
uni AS (SELECT word, n, n / corpus_size AS p FROM vocab CROSS JOIN csize),
train_grams AS (
  SELECT doc_id, line, i - 1 AS pos, tokens[i - 2] AS w1, tokens[i - 1] AS w2, tokens[i] AS w3
  FROM (SELECT doc_id, line, tokens, unnest(range(3, len(tokens) + 1)) AS i FROM train_sent)
),
tri_counts AS (SELECT w1, w2, w3, count(*) AS c FROM train_grams GROUP BY w1, w2, w3),
tri_p AS (SELECT w1, w2, w3, c, c / sum(c) OVER (PARTITION BY w1, w2) AS p FROM tri_counts)
"""


def _score(src: str, name: str) -> str:
    """Score the trigrams of sentence table ``src`` into CTE ``name``."""
    return f"""
{name}_grams AS (
  SELECT doc_id, label, line, i - 1 AS pos, tokens[i - 2] AS w1, tokens[i - 1] AS w2, tokens[i] AS w3
  FROM (SELECT doc_id, label, line, tokens, unnest(range(3, len(tokens) + 1)) AS i FROM {src})
),
{name} AS (
  SELECT g.*, coalesce(t.p, u.p, 0.99::DOUBLE / m.corpus_size) AS p,
         CASE WHEN t.p IS NULL AND u.p IS NULL THEN 1 ELSE 0 END AS oov,
         CASE WHEN t.p IS NULL AND u.p IS NOT NULL THEN 1 ELSE 0 END AS in_vocab
  FROM {name}_grams g
  LEFT JOIN tri_p t ON t.w1 = g.w1 AND t.w2 = g.w2 AND t.w3 = g.w3
  LEFT JOIN uni u ON u.word = g.w3
  CROSS JOIN csize m
)"""


def _sent(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT doc_id, label, line, count(*) AS n_scored,
         avg(pow(2, -log2(p))) AS ppl0, pow(2, avg(-log2(p))) AS ppl1, pow(2, avg(-p * log2(p))) AS ppl2,
         sum(oov) AS oov, sum(in_vocab) AS in_vocab
  FROM {src} GROUP BY doc_id, label, line
)"""


def _texts(docs: str, sents: str, sent_ppl: str, name: str, policy: str) -> str:
    ok = "(n_short = 0 AND n_sentences > 0)" if policy == "propagate" else "(ppl0 IS NOT NULL)"
    return f"""
{name}_ds AS (
  SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (WHERE len(tokens) <= 2) AS n_short
  FROM {sents} GROUP BY doc_id
),
{name}_dp AS (
  SELECT doc_id, sum(n_scored) AS n_tokens, sum(oov) AS oov, sum(in_vocab) AS in_vocab,
         avg(ppl0) AS ppl0, avg(ppl1) AS ppl1, avg(ppl2) AS ppl2
  FROM {sent_ppl} GROUP BY doc_id
),
{name}_b AS (
  SELECT t.doc_id, t.label, coalesce(s.n_sentences, 0) AS n_sentences, coalesce(s.n_short, 0) AS n_short,
         coalesce(p.n_tokens, 0) AS n_tokens, coalesce(p.oov, 0) AS oov, coalesce(p.in_vocab, 0) AS in_vocab,
         p.ppl0, p.ppl1, p.ppl2
  FROM {docs} t LEFT JOIN {name}_ds s ON s.doc_id = t.doc_id LEFT JOIN {name}_dp p ON p.doc_id = t.doc_id
),
{name} AS (
  SELECT doc_id, label, n_sentences::BIGINT AS n_sentences, (n_sentences - n_short)::BIGINT AS n_scored_sentences,
         n_tokens::BIGINT AS n_tokens, oov::BIGINT AS oov, in_vocab::BIGINT AS in_vocab,
         CASE WHEN {ok} THEN ppl0 END AS ppl0, CASE WHEN {ok} THEN ppl1 END AS ppl1,
         CASE WHEN {ok} THEN ppl2 END AS ppl2, NOT {ok} AS is_nan
  FROM {name}_b
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


PPL_OUT = "round(ppl0, 4) AS ppl0, round(ppl1, 4) AS ppl1, round(ppl2, 6) AS ppl2"
AVG_PPL_OUT = "round(avg(ppl0), 4) AS ppl0, round(avg(ppl1), 4) AS ppl1, round(avg(ppl2), 6) AS ppl2"
TEXT_OUT = f"doc_id, label, n_sentences, n_scored_sentences, n_tokens, oov, in_vocab, {PPL_OUT}, is_nan"
SCORED = with_(LINES, MODEL, _score("test_sent", "scored"))
TEXTS_PROP = with_(LINES, MODEL, _score("test_sent", "scored"), _sent("scored", "sent_ppl"),
                   _texts("test_docs", "test_sent", "sent_ppl", "texts", "propagate"))
TEXTS_SKIP = with_(LINES, MODEL, _score("test_sent", "scored"), _sent("scored", "sent_ppl"),
                   _texts("test_docs", "test_sent", "sent_ppl", "texts", "skip"))

SQL["sentences"] = with_(LINES) + "SELECT doc_id, line::BIGINT AS line, value FROM doc_lines"
SQL["labelled_docs"] = (
    with_(LINES) + "SELECT t.doc_id, t.label, length(d.text)::BIGINT AS n_chars "
    "FROM test_docs t JOIN documents d ON d.doc_id = t.doc_id"
)
SQL["tokens"] = with_(LINES) + (
    "SELECT doc_id, line::BIGINT AS line, len(tokens)::BIGINT AS n_tokens, "
    "array_to_string(tokens, ' ') AS tokens FROM sentences"
)
SQL["vocab_counts"] = with_(LINES, MODEL) + "SELECT word, n::BIGINT AS n FROM vocab"
SQL["corpus_size"] = with_(LINES, MODEL) + "SELECT corpus_size FROM csize"
SQL["unigram_probs"] = with_(LINES, MODEL) + "SELECT word, n::BIGINT AS n, round(p, 12) AS p FROM uni"
SQL["trigrams"] = with_(LINES, MODEL) + "SELECT doc_id, line::BIGINT AS line, pos::BIGINT AS pos, w1, w2, w3 FROM train_grams"
SQL["trigram_counts"] = with_(LINES, MODEL) + "SELECT w1, w2, w3, c::BIGINT AS c FROM tri_counts"
SQL["trigram_probs"] = with_(LINES, MODEL) + "SELECT w1, w2, w3, c::BIGINT AS c, round(p, 12) AS p FROM tri_p"
SQL["trigram_model_stats"] = with_(LINES, MODEL) + """
SELECT (SELECT corpus_size FROM csize) AS corpus_size,
       (SELECT count(*) FROM vocab)::BIGINT AS vocab_size,
       (SELECT count(*) FROM tri_p)::BIGINT AS n_trigrams,
       (SELECT count(*) FROM (SELECT DISTINCT w1, w2 FROM tri_p))::BIGINT AS n_contexts
"""
SQL["scored_tokens"] = SCORED + (
    "SELECT doc_id, label, line::BIGINT AS line, pos::BIGINT AS pos, w3, round(p, 12) AS p, "
    "oov::INTEGER AS oov, in_vocab::INTEGER AS in_vocab FROM scored"
)
SQL["oov_counts"] = SCORED + """
SELECT label, count(*)::BIGINT AS n_scored, sum(oov)::BIGINT AS oov, sum(in_vocab)::BIGINT AS in_vocab,
       sum(1 - oov - in_vocab)::BIGINT AS trigram_hits
FROM scored GROUP BY label
"""
SQL["word_entropy"] = SCORED + (
    "SELECT doc_id, line::BIGINT AS line, pos::BIGINT AS pos, round(-log2(p), 9) AS entropy FROM scored"
)
SQL["sentence_perplexity"] = with_(LINES, MODEL, _score("test_sent", "scored"), _sent("scored", "sent_ppl")) + (
    f"SELECT doc_id, line::BIGINT AS line, n_scored::BIGINT AS n_scored, {PPL_OUT}, "
    "oov::BIGINT AS oov, in_vocab::BIGINT AS in_vocab FROM sent_ppl"
)
SQL["text_perplexity"] = TEXTS_PROP + f"SELECT {TEXT_OUT} FROM texts"
SQL["text_perplexity_propagate"] = SQL["text_perplexity"]
SQL["text_perplexity_skip"] = TEXTS_SKIP + f"SELECT {TEXT_OUT} FROM texts"
SQL["corpus_perplexity"] = with_(LINES, MODEL, _score("test_sent", "scored"), _sent("scored", "sent_ppl")) + f"""
SELECT (SELECT count(*) FROM test_sent)::BIGINT AS n_sentences,
       count(*)::BIGINT AS n_scored_sentences, sum(n_scored)::BIGINT AS n_tokens,
       sum(oov)::BIGINT AS oov, sum(in_vocab)::BIGINT AS in_vocab, {AVG_PPL_OUT}
FROM (SELECT n_scored, oov, in_vocab,
             CASE WHEN isfinite(ppl0) THEN ppl0 END AS ppl0,
             CASE WHEN isfinite(ppl1) THEN ppl1 END AS ppl1,
             CASE WHEN isfinite(ppl2) THEN ppl2 END AS ppl2 FROM sent_ppl)
"""
_TRAIN_SCORED = r"""
train_sent_l AS (SELECT doc_id, 'train' AS label, line, tokens FROM train_sent),
train_docs_l AS (SELECT doc_id, 'train' AS label FROM train_docs)
"""
SQL["class_perplexity"] = with_(
    LINES, MODEL, _score("test_sent", "scored"), _sent("scored", "sent_ppl"),
    _texts("test_docs", "test_sent", "sent_ppl", "texts", "skip"),
    _TRAIN_SCORED, _score("train_sent_l", "tscored"), _sent("tscored", "tsent_ppl"),
    _texts("train_docs_l", "train_sent_l", "tsent_ppl", "ttexts", "skip"),
) + f"""
SELECT label, count(*)::BIGINT AS n_texts, {AVG_PPL_OUT}
FROM (SELECT * FROM texts UNION ALL SELECT * FROM ttexts) WHERE NOT is_nan GROUP BY label
"""
SQL["corpus_stats"] = with_(LINES) + """
SELECT label, sum(w)::BIGINT AS n_words, count(*)::BIGINT AS n_texts FROM (
  SELECT label, doc_id, sum(len(tokens) - 1) AS w FROM (
    SELECT label, doc_id, tokens FROM test_sent
    UNION ALL SELECT 'train' AS label, doc_id, tokens FROM train_sent)
  GROUP BY label, doc_id)
GROUP BY label
"""
SQL["score_table"] = TEXTS_PROP + "SELECT CAST(doc_id AS VARCHAR) AS files, label, round(ppl2, 6) AS perpl, is_nan FROM texts"
SQL["extreme_texts"] = TEXTS_PROP + """,
st AS (SELECT CAST(doc_id AS VARCHAR) AS files, label, ppl2 AS perpl FROM texts WHERE ppl2 IS NOT NULL AND isfinite(ppl2))
SELECT * FROM (SELECT 'top' AS side, files, label, round(perpl, 6) AS perpl FROM st ORDER BY perpl DESC, files ASC LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'bottom' AS side, files, label, round(perpl, 6) AS perpl FROM st ORDER BY perpl ASC, files DESC LIMIT 5)
"""

_U = ("('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line AS VARCHAR)), 1, 12))::BIGINT"
      " / 281474976710656.0::DOUBLE")
GEN = f"""
seeds AS (SELECT doc_id, line, tokens[1] AS w1, tokens[2] AS w2, {_U} AS u FROM test_sent WHERE len(tokens) >= 2),
tri_c AS (
  SELECT w1, w2, w3, c,
         sum(c) OVER (PARTITION BY w1, w2 ORDER BY w3 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
         sum(c) OVER (PARTITION BY w1, w2) AS total
  FROM tri_counts
),
ctx_tot AS (SELECT DISTINCT w1, w2, total FROM tri_c),
ucum AS (SELECT word, n, sum(n) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM vocab),
best AS (
  SELECT w1, w2, w3 AS next_word FROM (
    SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY c DESC, w3 ASC) AS r FROM tri_counts) WHERE r = 1
),
widx AS (SELECT word, row_number() OVER (ORDER BY n DESC, word ASC) - 1 AS id FROM vocab)
"""
SQL["generated_sample"] = with_(LINES, MODEL, GEN) + """
SELECT k.doc_id, k.line::BIGINT AS line, k.w1, k.w2, t3.w3 AS next_word, TRUE AS from_context
FROM (SELECT s.*, floor(s.u * c.total) AS t FROM seeds s JOIN ctx_tot c ON c.w1 = s.w1 AND c.w2 = s.w2) k
JOIN tri_c t3 ON t3.w1 = k.w1 AND t3.w2 = k.w2 AND k.t >= t3.hi - t3.c AND k.t < t3.hi
UNION ALL
SELECT s.doc_id, s.line::BIGINT, s.w1, s.w2, u.word, FALSE
FROM seeds s CROSS JOIN csize m
JOIN ucum u ON floor(s.u * m.corpus_size) >= u.hi - u.n AND floor(s.u * m.corpus_size) < u.hi
WHERE NOT EXISTS (SELECT 1 FROM ctx_tot c WHERE c.w1 = s.w1 AND c.w2 = s.w2)
"""
SQL["generated_argmax"] = with_(LINES, MODEL, GEN) + """
SELECT s.doc_id, s.line::BIGINT AS line, s.w1, s.w2, b.next_word, TRUE AS from_context
FROM seeds s JOIN best b ON b.w1 = s.w1 AND b.w2 = s.w2
UNION ALL
SELECT s.doc_id, s.line::BIGINT, s.w1, s.w2, w.word, FALSE
FROM seeds s JOIN widx w ON w.id = floor(s.u * (SELECT count(*) FROM vocab))
WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.w1 = s.w1 AND b.w2 = s.w2)
"""

SQL["shuffled_sentences"] = with_(LINES) + """
SELECT pass::BIGINT AS pass, doc_id, line::BIGINT AS line,
       (row_number() OVER (ORDER BY pass, order_key, line) - 1)::BIGINT AS rank
FROM (SELECT p.range AS pass, l.doc_id, l.line,
             md5('42:' || CAST(p.range AS VARCHAR) || ':' || CAST(l.doc_id AS VARCHAR)) AS order_key
      FROM doc_lines l CROSS JOIN range(2) p)
"""

SQL["word_classes"] = with_(LINES, MODEL) + """, dealt AS (
  SELECT word, n, floor((sum(n) OVER (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING) - n) * 100 / (SELECT sum(n) FROM vocab)) AS raw
  FROM vocab)
SELECT word, n::BIGINT AS n, (dense_rank() OVER (ORDER BY raw) - 1)::BIGINT AS cls,
       round(n / sum(n) OVER (PARTITION BY raw), 9) AS share
FROM dealt
"""
