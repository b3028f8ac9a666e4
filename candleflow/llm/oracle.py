"""DuckDB SQL of the queries that SQL can express.

The other queries use fitted models, XXH64 with a seed, seeded selection or
a tokenizer; their tests compare with brute force.
"""

from __future__ import annotations

from . import quality_rules as R
from .common import WORD

SQL: dict[str, str] = {}

SQL["op4_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
         AND list_bool_and([isfinite(x) for x in e]) AND list_bool_or([x <> 0 for x in e])),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
         ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.x = v.vec_id LEFT JOIN deg ON deg.x = v.vec_id"""


def _size(regex: str) -> str:
    return "length(regexp_replace(t, '" + regex.replace("'", "''") + "', '', 'g'))"


_CLASSES = list(R.CLASSES)
_COUNTS = ", ".join(f"{_size(rx)} AS n_{k}" for k, rx in R.CLASSES.items())
_OTHER = "all_ - " + " - ".join(f"n_{k}" for k in _CLASSES)
_SUMS = ", ".join(f"sum(n_{k}) / sum(all_) AS q_{k}" for k in _CLASSES)


def _xlog(p: str, m: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / ({m})) ELSE 0 END)"


def _js(p: str, q: str) -> str:
    m = f"({p} + {q}) / 2"
    return f"({_xlog(p, m)} + {_xlog(q, m)}) / 2"


_CHAR_JS = " + ".join(_js(f"(n_{k} / all_)", f"q_{k}") for k in [*_CLASSES, "other"])

SQL["op8_quality_rules"] = f"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, length(t) AS all_, {_COUNTS} FROM d),
x AS (SELECT *, {_OTHER} AS n_other FROM w),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n
        FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
              FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2) g) p),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM tri, range(0, 3) r(k) WHERE tri.n > 1 GROUP BY rid),
base AS (SELECT x.*, len(w) AS n_words,
                {_size(r'[ \x09-\x0D]+')} AS word_chars,
                {_size('[^#*$%&|<>]+')} AS n_symbols,
                (SELECT count(l) - count(DISTINCT l) FROM (SELECT unnest(string_split(x.t, chr(10))) AS l) s
                 WHERE regexp_matches(l, '{WORD}')) AS n_dup_lines,
                coalesce(rep.n, 0) AS n_repeat_words
         FROM x LEFT JOIN rep USING (rid)),
lang0 AS (SELECT lang, sum(all_) AS all_, {_SUMS}, sum(n_other) / sum(all_) AS q_other FROM x
          WHERE lang IS NOT NULL GROUP BY lang HAVING sum(all_) > 0),
langs AS (SELECT *, all_ >= {R.MIN_LANG_SHARE} * (SELECT sum(all_) FROM lang0) AS large FROM lang0
          WHERE all_ >= {R.MIN_LANG_SHARE} * (SELECT sum(all_) FROM lang0) OR all_ >= {R.MIN_LANG_CHARS}),
lw AS (SELECT lang, u AS word, count(*) AS n
       FROM (SELECT lang, unnest(regexp_extract_all(lower(t), '{WORD}')) AS u FROM d WHERE lang IN (SELECT lang FROM langs)) z
       GROUP BY lang, u),
top AS (SELECT lang, large, word, n / sum(n) OVER (PARTITION BY lang) AS q
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM lw) z JOIN langs USING (lang)
        WHERE r <= {R.TOP_WORDS}),
-- the words of a document that are frequent in some usable language
aw AS (SELECT rid, u AS word, count(*) AS n FROM (SELECT rid, unnest([lower(s) for s in w]) AS u FROM w) z
       WHERE u IN (SELECT word FROM top) GROUP BY rid, u),
many AS (SELECT DISTINCT word FROM top WHERE large),
-- first the large languages and the own one
pair0 AS (SELECT x.rid, l.lang FROM x JOIN langs l ON l.large OR l.lang = x.lang
          WHERE x.lang IS NULL OR x.lang IN (SELECT lang FROM langs)),
dw0 AS (SELECT aw.* FROM aw JOIN x USING (rid)
        WHERE word IN (SELECT word FROM many) OR (x.lang, word) IN (SELECT lang, word FROM top)),
dp0 AS (SELECT rid, word, n / sum(n) OVER (PARTITION BY rid) AS p FROM dw0),
w0 AS (SELECT rid, min(js) AS js FROM (
         SELECT dp0.rid, l.lang, 0.5 + sum({_js('dp0.p', 'coalesce(top.q, 0)')} - coalesce(top.q, 0) / 2) AS js
         FROM dp0 JOIN pair0 l USING (rid) LEFT JOIN top ON top.lang = l.lang AND top.word = dp0.word
         GROUP BY dp0.rid, l.lang) z GROUP BY rid),
c0 AS (SELECT rid, min(js) AS js FROM (SELECT rid, {_CHAR_JS} AS js
                                       FROM (SELECT * EXCLUDE (lang) FROM x) x JOIN pair0 USING (rid)
                                       JOIN (SELECT * EXCLUDE (all_, large) FROM langs) l USING (lang)) z GROUP BY rid),
v0 AS (SELECT base.*, base.n_words < 50 OR 100 * n_repeat_words > 50 * base.n_words AS base_failed,
              CASE WHEN base.all_ >= {R.MIN_CHARS} AND c0.js IS NOT NULL THEN sqrt(greatest(c0.js, 0)) END AS cd,
              CASE WHEN base.n_words >= {R.MIN_WORDS} AND c0.js IS NOT NULL
                   THEN CASE WHEN w0.js IS NULL THEN 1.0 ELSE sqrt(greatest(w0.js, 0)) END END AS wd
       FROM base LEFT JOIN c0 USING (rid) LEFT JOIN w0 USING (rid)),
-- then, for far documents, every other language that shares a frequent word
pair1 AS (SELECT DISTINCT v0.rid, top.lang FROM v0 JOIN aw USING (rid) JOIN top ON top.word = aw.word AND NOT top.large
          WHERE coalesce(cd, 0) > {R.MAX_CHAR_DISTANCE} OR coalesce(wd, 0) > {R.MAX_WORD_DISTANCE}
             OR (v0.lang IS NULL AND NOT EXISTS (SELECT 1 FROM langs WHERE large))),
dw1 AS (SELECT rid, pair1.lang, word, n FROM pair1 JOIN aw USING (rid)
        WHERE word IN (SELECT word FROM many) OR (pair1.lang, word) IN (SELECT lang, word FROM top)),
dp1 AS (SELECT *, n / sum(n) OVER (PARTITION BY rid, lang) AS p FROM dw1),
w1 AS (SELECT rid, min(js) AS js FROM (
         SELECT dp1.rid, dp1.lang, 0.5 + sum({_js('dp1.p', 'coalesce(top.q, 0)')} - coalesce(top.q, 0) / 2) AS js
         FROM dp1 LEFT JOIN top ON top.lang = dp1.lang AND top.word = dp1.word GROUP BY dp1.rid, dp1.lang) z GROUP BY rid),
c1 AS (SELECT rid, min(js) AS js FROM (SELECT rid, {_CHAR_JS} AS js
                                       FROM (SELECT * EXCLUDE (lang) FROM x) x JOIN pair1 USING (rid)
                                       JOIN (SELECT * EXCLUDE (all_, large) FROM langs) l USING (lang)) z GROUP BY rid),
v AS (SELECT v0.*,
             CASE WHEN v0.all_ >= {R.MIN_CHARS} AND c1.js IS NOT NULL
                  THEN least(cd, sqrt(greatest(c1.js, 0))) ELSE cd END AS char_distance,
             CASE WHEN v0.n_words >= {R.MIN_WORDS} AND w1.js IS NOT NULL
                  THEN least(wd, sqrt(greatest(w1.js, 0))) ELSE wd END AS word_distance
      FROM v0 LEFT JOIN c1 USING (rid) LEFT JOIN w1 USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_distance, 0) <= {R.MAX_CHAR_DISTANCE}
         AND coalesce(word_distance, 0) <= {R.MAX_WORD_DISTANCE} AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM v"""


#: Part, order and step of the five filters; masks by documents, then every
#: prefix of every permutation.  Shapley is the sum over the orders themselves.
SQL["op11_filter_audit"] = rf"""
WITH lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
             [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND a.bit <> e.bit AND b.bit <> c.bit
        AND b.bit <> d.bit AND b.bit <> e.bit AND c.bit <> d.bit AND c.bit <> e.bit AND d.bit <> e.bit),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before
      FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, any_value(bit) AS bit,
             sum(CASE WHEN mask & (before::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before::INT = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before::INT <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before::INT = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before::INT = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM x"""
