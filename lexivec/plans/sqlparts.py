"""Shared SQL fragments for the DuckDB oracles.

Oracles are independent re-statements of each operator in plain SQL (RE2
regexes, windows instead of array tricks), so a match is real evidence.
RE2 ``\\b``/``\\w`` are ASCII-only, so word boundaries are written out as
``[^\\p{L}\\p{N}_]`` classes where non-ASCII letters can touch them.
"""

from lexivec.functions.text import NEGATORS

WB = r"[^\p{L}\p{N}_]"


def r6(expr: str) -> str:
    """Round to 6 decimals; ``+ 0.0`` turns ``-0.0`` into ``0.0`` like Spark."""
    return f"(round(({expr})::DOUBLE, 6) + 0.0)"


def toks(col: str) -> str:
    """Standard tokens: collapse whitespace, lower, split on space."""
    return f"string_split(lower(regexp_replace({col}, '\\s+', ' ', 'g')), ' ')"


OPENER = "(?i)((^|" + WB + ")(" + "|".join(NEGATORS) + ")($|" + WB + ")|n't($|" + WB + "))"
CLOSER = "[.,:;!?]"

LEXICON_CTE = f"""lex AS (
  SELECT term,
         CASE WHEN length(term) % 2 = 0 THEN 'positive' ELSE 'negative' END AS cls,
         (length(term) - 5) / 5.0 AS score
  FROM (SELECT DISTINCT unnest({toks('text')}) AS term FROM benchmark)
  WHERE regexp_full_match(term, '[a-z]{{2,}}'))"""

BIGRAM_LEXICON_CTE = f"""bt AS (SELECT item_id, unnest(t) AS tok, unnest(generate_series(0, len(t) - 1)) AS pos
        FROM (SELECT item_id, {toks('text')} AS t FROM benchmark)),
blex AS (
  SELECT DISTINCT a.tok || ' ' || b.tok AS term, (length(a.tok || ' ' || b.tok) - 10) / 10.0 AS score
  FROM bt a JOIN bt b ON a.item_id = b.item_id AND b.pos = a.pos + 1
  WHERE regexp_full_match(a.tok, '[a-z]{{2,}}') AND regexp_full_match(b.tok, '[a-z]{{2,}}'))"""

# tokens with 0-based positions
DOC_TOKENS_CTE = f"""dt AS (
  SELECT doc_id, unnest(t) AS tok, unnest(generate_series(0, len(t) - 1)) AS pos
  FROM (SELECT doc_id, {toks('text')} AS t FROM documents))"""

# negation marking by window: last marker strictly before the token
NEG_MARK_CTE = f"""fl AS (
  SELECT *, CASE WHEN regexp_matches(tok, '{CLOSER}') THEN 'C'
                 WHEN regexp_matches(tok, '{OPENER.replace(chr(39), chr(39) * 2)}') THEN 'O' END AS kind FROM dt),
st AS (
  SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM fl),
mk AS (
  SELECT doc_id, pos, CASE WHEN kind IS NULL AND prev = 'O' THEN tok || '_NEG' ELSE tok END AS item FROM st)"""


def score_block_sql(items_cte: str, lex_sql: str) -> str:
    """Nine-value lexicon block over ``items_cte(doc_id, pos, item)`` and a
    lexicon query returning ``(term, score)``."""
    return _score_block(items_cte, lex_sql)


def score_block_cte(items_cte: str, lex_sql: str, name: str) -> str:
    """Same block as a named CTE (for composition)."""
    body = _score_block(items_cte, lex_sql)
    cte, select = body.split("\nSELECT doc_id,", 1)
    return f"{cte},\n{name} AS (SELECT doc_id,{select})"


def _score_block(items_cte: str, lex_sql: str) -> str:
    return f"""sc AS (
  SELECT i.doc_id, i.pos,
         CASE WHEN contains(i.item, '_NEG') THEN -l.score ELSE l.score END AS s
  FROM {items_cte} i LEFT JOIN ({lex_sql}) l ON lower(replace(i.item, '_NEG', '')) = l.term)
SELECT doc_id,
  (count(*) FILTER (WHERE s > 0))::BIGINT AS n_pos,
  (count(*) FILTER (WHERE s < 0))::BIGINT AS n_neg,
  {r6("coalesce(sum(s) FILTER (WHERE s > 0), 0)")} AS sum_pos,
  {r6("coalesce(sum(-s) FILTER (WHERE s < 0), 0)")} AS sum_neg,
  {r6("coalesce(sum(s) FILTER (WHERE s > 0), 0) - coalesce(sum(-s) FILTER (WHERE s < 0), 0)")} AS net,
  {r6("coalesce(max(s) FILTER (WHERE s > 0), 0)")} AS max_pos,
  {r6("coalesce(max(-s) FILTER (WHERE s < 0), 0)")} AS max_neg,
  {r6("coalesce(arg_max(abs(s), pos) FILTER (WHERE s <> 0), 0)")} AS last_nonzero,
  {r6("coalesce(arg_max(coalesce(s, 0), pos), 0)")} AS last_score
FROM sc GROUP BY doc_id"""


CLASS_SCORE_SQL = ("SELECT term, CASE cls WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 "
                   "WHEN 'neutral' THEN 0.0 WHEN 'both' THEN 0.0 END AS score FROM lex")
