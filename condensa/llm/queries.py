"""Registered queries of this subpackage. ORACLES has the SQL of those that SQL can state."""

from __future__ import annotations

from .bpe import op8_bpe
from .decontaminate import op7_decontaminate
from .language import op10_language
from .media import op9_media
from .pii import op3_pii
from .simhash import op6_simhash
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op4_token_counts
from .token_files import op2_token_output
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_output, op3_pii, op4_token_counts, op5_suffix_dedup, op6_simhash, op7_decontaminate, op8_bpe, op9_media, op10_language)}

#: Texts as lists of words: as the operators have them, letters and digits of Unicode, and for runs every sign but ASCII's and general punctuation.
_LEAK_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')".format
_RUN_WORDS = r"regexp_extract_all(lower(text), '[0-9a-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}]+')"

#: Runs of 50 words that another row has, by all windows of all texts.
_REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_RUN_WORDS} AS l FROM documents WHERE text IS NOT NULL),
 w AS (SELECT r, doc_id, p, hash(l[p:p + 49]) AS h FROM (SELECT r, doc_id, l, unnest(range(1, len(l) - 48)) AS p FROM d) q),
 again AS (SELECT h FROM w GROUP BY h HAVING min(r) <> max(r)),
 found AS (SELECT r, doc_id, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS part FROM w SEMI JOIN again USING (h))
SELECT doc_id, (min(p) - 1)::INT AS start_word, (max(p) + 49)::INT AS end_word FROM found GROUP BY r, doc_id, part"""

#: Runs of 13 words of an item, whole items of 5 to 12 words, and shorter ones near another part of theirs or as a whole text.
_LEAKS = f"""
WITH pieces AS (SELECT r, doc_id, unnest(range(len(l))) AS k, unnest(l) AS x FROM (
   SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS l FROM documents) q),
 placed AS (SELECT r, doc_id, k, x, sum(length(x)) OVER (PARTITION BY r ORDER BY k) AS e FROM pieces),
 w AS (SELECT r, doc_id, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS p, lower(x) AS x, (e - length(x))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE regexp_matches(x, '^[\\p{{L}}\\p{{N}}]')),
 d AS (SELECT r, list(x ORDER BY p) AS l FROM w GROUP BY r),
 i AS (SELECT row_number() OVER () AS k, item_id, l, len(l) AS m, least(len(l), 13) AS n FROM (SELECT DISTINCT item_id, text, {_LEAK_WORDS('lower(text)')} AS l FROM benchmark WHERE text IS NOT NULL) q WHERE len(l) > 0),
 ig AS (SELECT k, n, j, l[j:j + n - 1] AS g FROM (SELECT k, n, l, unnest(range(1, m - n + 2)) AS j FROM i) q),
 dg AS (SELECT r, n, p, l[p:p + n - 1] AS g FROM (SELECT r, n, l, unnest(range(1, len(l) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) ns) q),
 hit AS (SELECT DISTINCT r, k, n, p, p - j AS diagonal FROM dg JOIN ig USING (n, g)),
 run AS (SELECT r, k, min(p) - 1 AS a, max(p) + n - 1 AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY r, k, diagonal ORDER BY p) AS part FROM hit) q GROUP BY r, k, n, diagonal, part),
 long AS (SELECT run.*, item_id FROM run JOIN i USING (k) WHERE m >= 5 OR (a = 0 AND b = (SELECT len(l) FROM d WHERE d.r = run.r))),
 near AS (SELECT DISTINCT s.r, s.k, s.a, s.b, i.item_id FROM run s JOIN i USING (k) JOIN long o ON o.r = s.r AND o.item_id = i.item_id AND (s.b <= o.a AND s.a >= o.a - 100 - m OR s.a >= o.b AND s.b <= o.b + 100 + m) WHERE m < 5),
 every AS (SELECT * FROM long UNION SELECT r, k, a, b, item_id FROM near)
SELECT f.doc_id, item_id, f.s AS start, t.e AS "end", (b - a)::BIGINT AS n_words, m::BIGINT AS item_words
FROM every JOIN i USING (k, item_id) JOIN w f ON f.r = every.r AND f.p = a JOIN w t ON t.r = every.r AND t.p = b - 1"""

ORACLES: dict[str, str] = {"op5_suffix_dedup": _REPEATS, "op7_decontaminate": _LEAKS}
