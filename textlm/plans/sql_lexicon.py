"""DuckDB twins of the word-list queries."""

from __future__ import annotations

from textlm.functions.text import TOKEN_PATTERN
from textlm.plans.sql_encode import SV
from textlm.plans.sql_lm import LINES, SQL, with_
from textlm.plans.sql_vectors import VEC

PAT = TOKEN_PATTERN


def _pos(w: str, tags=("NOUN", "VERB", "ADJ")) -> str:
    return f"CASE length({w}) % 3 WHEN 0 THEN '{tags[0]}' WHEN 1 THEN '{tags[1]}' ELSE '{tags[2]}' END"


def _lemma(w: str) -> str:
    return f"lower(regexp_replace({w}, '[^\\p{{L}}\\p{{N}}]+$', ''))"


def _tag(src_col: str, name: str) -> str:
    return f"""
{name}_t AS (
  SELECT idx, {src_col} AS word, unnest(regexp_extract_all({src_col}, '{PAT}', 0)) AS tok,
         unnest(range(len(regexp_extract_all({src_col}, '{PAT}', 0)))) AS tpos
  FROM bl
),
{name}_b AS (
  SELECT t.idx, t.word, arg_max(x.lemma, t.tpos) AS lemma, arg_max(x.pos, t.tpos) AS pos
  FROM {name}_t t JOIN lex x ON x.word = t.tok GROUP BY t.idx, t.word
),
{name} AS (
  SELECT b.idx, b.{src_col} AS word, s.lemma, s.pos FROM bl b LEFT JOIN {name}_b s ON s.idx = b.idx AND s.word = b.{src_col}
)"""


LEX = f"""
dtok AS (
  SELECT d.lang, unnest(regexp_extract_all(l.value, '{PAT}', 0)) AS word
  FROM doc_lines l JOIN documents d ON d.doc_id = l.doc_id
),
lex AS (SELECT word, {_lemma('word')} AS lemma, {_pos('word')} AS pos FROM (SELECT DISTINCT word FROM dtok)),
en_r AS (SELECT word AS src, row_number() OVER (ORDER BY n DESC, word ASC) - 1 AS idx
         FROM (SELECT word, count(*) AS n FROM dtok WHERE lang = 'en' GROUP BY word)),
ot_r AS (SELECT word AS tgt, row_number() OVER (ORDER BY n DESC, word ASC) - 1 AS idx
         FROM (SELECT word, count(*) AS n FROM dtok WHERE lang <> 'en' GROUP BY word)),
bl AS (
  SELECT e.idx, e.src, o.tgt FROM en_r e JOIN ot_r o ON o.idx = e.idx
  WHERE e.idx < least((SELECT count(*) FROM en_r), (SELECT count(*) FROM ot_r))
),
{_tag('src', 'ts').strip()},
{_tag('tgt', 'tt').strip()},
pp AS (
  SELECT s.idx, s.word AS src, s.lemma AS src_lemma, s.pos AS src_pos, t.word AS tgt, t.lemma AS tgt_lemma, t.pos AS tgt_pos
  FROM ts s JOIN tt t ON t.idx = s.idx
  WHERE (SELECT count(*) FROM ts) = (SELECT count(*) FROM tt)
),
sp AS (SELECT * FROM pp WHERE src_pos = tgt_pos),
lp AS (SELECT concat_ws('_', src_lemma, src_pos) AS src_lempos, concat_ws('_', tgt_lemma, tgt_pos) AS tgt_lempos, tgt_lemma FROM sp)
"""
ALL_LATIN = "NOT regexp_matches(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Latin}}]')"

SQL["lexicon"] = with_(LINES, LEX) + "SELECT word, lemma, pos FROM lex"
SQL["bilingual_list"] = with_(LINES, LEX) + "SELECT idx::BIGINT AS idx, src, tgt FROM bl"
SQL["tagged_words"] = with_(LINES, LEX) + "SELECT idx::BIGINT AS idx, word, lemma, pos FROM ts"
SQL["positional_pairs"] = with_(LINES, LEX) + (
    "SELECT idx::BIGINT AS idx, src, src_lemma, src_pos, tgt, tgt_lemma, tgt_pos FROM pp")
SQL["same_pos_pairs"] = with_(LINES, LEX) + (
    "SELECT idx::BIGINT AS idx, src, src_lemma, src_pos, tgt, tgt_lemma, tgt_pos FROM sp")
SQL["latin_flags"] = with_(LINES, LEX) + (
    f"SELECT idx::BIGINT AS idx, tgt_lemma, {ALL_LATIN.format(c='tgt_lemma')} AS all_latin FROM sp")
SQL["non_latin_pairs"] = with_(LINES, LEX) + (
    f"SELECT DISTINCT src_lempos, tgt_lempos FROM lp WHERE NOT ({ALL_LATIN.format(c='tgt_lemma')})")
SQL["lempos_pairs"] = with_(LINES, LEX) + "SELECT src_lempos, tgt_lempos FROM lp"
SQL["distinct_pairs"] = with_(LINES, LEX) + "SELECT DISTINCT src_lempos, tgt_lempos FROM lp"
SQL["pair_counts"] = with_(LINES, LEX) + (
    "SELECT count(*)::BIGINT AS n_pairs, count(DISTINCT (src_lempos, tgt_lempos))::BIGINT AS n_distinct FROM lp")
SQL["pos_counts"] = with_(LINES, LEX) + (
    "SELECT pos, count(*)::BIGINT AS n FROM (SELECT src_pos AS pos FROM pp UNION ALL SELECT tgt_pos FROM pp) GROUP BY pos")
_UD = "CASE s WHEN 'A' THEN 'ADJ' WHEN 'V' THEN 'VERB' WHEN 'N' THEN 'NOUN' ELSE s END"
SQL["lempos_similarity_list"] = with_(VEC) + f"""
SELECT concat_ws('_', w1, u) AS lempos1, concat_ws('_', w2, u) AS lempos2, score
FROM (SELECT w1, w2, score, {_UD.replace('s ', 'sh ').replace(' s END', ' sh END')} AS u
      FROM (SELECT *, {_pos('w1', ('N', 'V', 'A'))} AS sh FROM pairs))
"""
_F = "concat_ws(chr(9), CAST(i + 1 AS VARCHAR), tok, {lemma}, {pos}, {rest})"
_lm, _ps = _lemma("tok"), _pos("tok")
SQL["conll_rows"] = with_(LINES, SV) + f"""
, ctok AS (
  SELECT doc_id, line, unnest(range(len(t))) AS i, unnest(t) AS tok
  FROM (SELECT doc_id, line, regexp_extract_all(value, '{PAT}', 0) AS t FROM b_lines)
),
crows AS (
  SELECT doc_id, line, CASE WHEN regexp_matches(tok, '\\d')
    THEN {_F.format(lemma=_lm, pos=_ps, rest=", ".join(["'_'"] * 5))}
    ELSE {_F.format(lemma=_lm, pos=_ps, rest=", ".join(["'_'"] * 6))} END AS value
  FROM ctok
  UNION ALL SELECT doc_id, line, '# text = ' || value FROM b_lines
)
SELECT doc_id, line::BIGINT AS line, f[1] AS token_id, f[2] AS form, f[3] AS lemma, f[4] AS upos
FROM (SELECT doc_id, line, value, string_split(value, chr(9)) AS f FROM crows)
WHERE NOT starts_with(value, '#') AND value <> '' AND len(f) = 10
"""
