"""SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from .bm25 import B, K1, TOP
from .repetition import LINE_CHARS_LIMIT, NGRAM_LIMITS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _ngram(n: int) -> str:
    """Words covered by windows of n words: found twice or more (any), repeating an earlier one (again)."""
    return f"""g{n} AS (SELECT doc_id, i, c, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g FROM w WHERE i + {n - 1} <= len(ws)),
 m{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS found, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS again FROM g{n}),
 p{n} AS (SELECT w.doc_id, w.i, w.c, max(CASE WHEN found THEN w.i END) OVER s >= w.i - {n - 1} AS found, max(CASE WHEN again THEN w.i END) OVER s >= w.i - {n - 1} AS again
 FROM w LEFT JOIN m{n} m ON m.doc_id = w.doc_id AND m.i = w.i WINDOW s AS (PARTITION BY w.doc_id ORDER BY w.i ROWS UNBOUNDED PRECEDING)),
 s{n} AS (SELECT doc_id, sum(CASE WHEN again THEN c ELSE 0 END)::BIGINT AS chars, count_if(found)::BIGINT AS words FROM p{n} GROUP BY doc_id)"""


_lengths = sorted(NGRAM_LIMITS)
_share = {n: f"coalesce(s{n}.chars, 0) / greatest(1, word_chars)::DOUBLE" for n in _lengths}
OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
 w AS (SELECT doc_id, ws, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i, length(unnest(ws)) AS c FROM d),
 t AS (SELECT doc_id, sum(c)::BIGINT AS word_chars FROM w GROUP BY doc_id),
 l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
 l1 AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) > 1 AS again FROM l0 WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
 l AS (SELECT doc_id, count(*) AS n, count_if(again)::BIGINT AS dup, sum(CASE WHEN again THEN length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) ELSE 0 END)::BIGINT AS chars FROM l1 GROUP BY doc_id),
 {', '.join(map(_ngram, _lengths))},
 f AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(s5.words, 0)::BIGINT AS n_repeat_words, coalesce(l.dup / l.n::DOUBLE, 0) AS dup_line_share,
 coalesce(l.chars / greatest(1, word_chars)::DOUBLE, 0) AS dup_line_char_share, {', '.join(f'coalesce({_share[n]}, 0) AS share{n}' for n in _lengths)}
 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id) {' '.join(f'LEFT JOIN s{n} USING (doc_id)' for n in _lengths)}),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND dup_line_char_share <= {LINE_CHARS_LIMIT} AND {' AND '.join(f'share{n} <= {NGRAM_LIMITS[n]}' for n in _lengths)} AS kept,
 dup_line_share, dup_line_char_share, greatest({', '.join(f'share{n}' for n in _lengths)}) AS max_ngram_share FROM b"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 p AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM d) GROUP BY ALL),
 n AS (SELECT count(*) AS n, avg(len(ws)) AS av FROM d), f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
 s AS (SELECT q.doc_id AS query_id, p.doc_id, sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * {K1 + 1} / (p.tf + {K1} * (1 - {B} + {B} * p.dl / av))) AS score
 FROM p q JOIN p USING (w) JOIN f USING (w), n WHERE q.doc_id % 100 = 0 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
 SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {TOP}"""
