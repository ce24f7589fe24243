"""DuckDB SQL for each catalogue query (written independently of the Spark code).

Views ``documents``, ``labels``, ``embeddings`` ... are registered by the
caller.  Regular expressions use explicit classes so RE2 and Java agree.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

# Fixed values, written out here so that an error in the code under test shows.
W = r"[\p{L}\p{M}\p{N}_]+"
TK = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \t\n\r\f\x0B]"
POS_RULE_SQL = (
    "CASE WHEN NOT {w} THEN 'u' WHEN length({t}) <= 2 THEN 'l' "
    "WHEN {t} LIKE '%ly' THEN 'd' WHEN {t} LIKE '%ing' OR {t} LIKE '%ed' THEN 'v' "
    "WHEN {t} LIKE '%tion' OR {t} LIKE '%ment' OR {t} LIKE '%ness' THEN 'n' "
    "WHEN {t} LIKE '%er' OR {t} LIKE '%est' THEN 'a' WHEN length({t}) <= 4 THEN 'r' "
    "WHEN length({t}) <= 6 THEN 'c' ELSE 'n' END")
FUNCTION_WORDS = (
    "the of and to a in is it that was for on as with by he be at this from "
    "or an are which his her not but have were").split()

CORPUS = "SELECT doc_id, source AS author, text FROM documents"


def mfw(k: int = 100) -> str:
    return f"""
  corpus AS ({CORPUS}),
  words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM corpus),
  counts AS (SELECT doc_id, token, count(*) AS n FROM words GROUP BY ALL),
  top AS (SELECT token, sum(n) AS n FROM counts GROUP BY token ORDER BY n DESC, token LIMIT {k}),
  fc AS (SELECT * FROM counts WHERE token IN (SELECT token FROM top)),
  nd AS (SELECT count(*) AS n_docs FROM corpus)
"""


MFW_COUNTS = mfw(100)


# Per author: counts of the top words over all of the author's texts.
PROFILES = f"""
  {MFW_COUNTS},
  ac AS (SELECT author, token, sum(n) AS n FROM fc JOIN corpus USING (doc_id) GROUP BY ALL),
  na AS (SELECT count(DISTINCT author) AS n_docs FROM corpus)
"""

SQL["moisl_features"] = f"""
WITH {PROFILES},
  tot AS (SELECT author, sum(n) AS tot FROM ac GROUP BY author),
  mint AS (SELECT CASE WHEN count(*) < (SELECT n_docs FROM na) THEN 0 ELSE min(tot) END AS m
           FROM tot),
  x AS (SELECT ac.token, ac.n, ac.n / tot.tot AS x FROM ac JOIN tot USING (author)),
  st AS (SELECT token, sum(n) AS freq, sum(x) AS s1, sum(x * x) AS s2, count(*) AS rows,
                max(x) AS mx, min(x) AS mn FROM x GROUP BY token),
  m AS (SELECT *, (mx + CASE WHEN rows < (SELECT n_docs FROM na) THEN 0 ELSE mn END) / 2 AS m
        FROM st),
  s AS (SELECT *, s2 - 2 * m * s1 + (SELECT n_docs FROM na) * m * m AS ss FROM m)
SELECT token AS feature, freq::BIGINT AS freq,
       round(s1 / (SELECT n_docs FROM na), 6) AS mean_prob,
       round(CASE WHEN ss > 0 THEN m * (1 - m) * (1.91 * 1.91)
             * (2 * (SELECT n_docs FROM na) - 1) / (8 * ss) END, 6) AS score,
       coalesce(CASE WHEN ss > 0 THEN m * (1 - m) * (1.91 * 1.91)
             * (2 * (SELECT n_docs FROM na) - 1) / (8 * ss) END <= (SELECT m FROM mint), false) AS keep
FROM s
"""


def rule(t: str, w: str = "true") -> str:
    return POS_RULE_SQL.format(t=t, w=w)


IS_WORD = r"^[\p{L}\p{M}\p{N}_]"
FWORDS = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)

SQL["word_counts"] = f"""
SELECT doc_id, source AS author, len(regexp_extract_all(text, '{W}'))::BIGINT AS n_words
FROM documents
"""

SQL["author_counts"] = f"""
WITH corpus AS ({CORPUS})
SELECT author, count(*) AS n_docs, sum(len(regexp_extract_all(text, '{W}')))::BIGINT AS n_words
FROM corpus GROUP BY author
"""

SQL["reject_report"] = f"""
SELECT reason, count(*) AS n_docs, count(DISTINCT source) AS n_authors FROM (
  SELECT CASE WHEN source IN ('src7', 'src13') THEN 'author'
              WHEN lang NOT IN ('en') THEN 'genre'
              WHEN len(regexp_extract_all(text, '{W}')) < 300 THEN 'short'
              ELSE 'kept' END AS reason, source
  FROM documents)
GROUP BY reason
"""

SQL["function_words"] = f"""
WITH corpus AS ({CORPUS}),
  words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM corpus)
SELECT doc_id, token AS feature, count(*) AS n FROM words
WHERE token IN ({FWORDS}) GROUP BY ALL
"""

SQL["pos_trigrams"] = f"""
WITH corpus AS ({CORPUS}),
  t AS (SELECT list_transform(regexp_extract_all(lower(text), '{W}'), lambda w: {rule('w')}) AS tags
        FROM corpus),
  g AS (SELECT unnest(list_transform(range(1, len(tags) - 1),
                 lambda i: tags[i] || '-' || tags[i + 1] || '-' || tags[i + 2])) AS trigram
        FROM t WHERE len(tags) >= 3)
SELECT trigram, count(*) AS n FROM g GROUP BY trigram
"""

AFFIXES = """
  a AS (SELECT doc_id, unnest(list_filter([
          CASE WHEN length(token) <= 3 THEN token END,
          CASE WHEN length(token) >= 2 THEN '_' || left(token, 2) END,
          CASE WHEN length(token) >= 2 THEN right(token, 2) || '_' END,
          CASE WHEN length(token) > 3 THEN left(token, 3) END,
          CASE WHEN length(token) > 3 THEN right(token, 3) END], lambda x: x IS NOT NULL)) AS affix
        FROM words)
"""

SQL["affix_counts"] = f"""
WITH corpus AS ({CORPUS}),
  words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM corpus),
  {AFFIXES}
SELECT affix, count(*) AS n FROM a GROUP BY affix
"""

SQL["top_tokens"] = f"""
WITH corpus AS ({CORPUS}),
  toks AS (SELECT unnest(regexp_extract_all(lower(text), '{TK}')) AS token FROM corpus),
  tt AS (SELECT token, regexp_matches(token, '{IS_WORD}') AS is_word FROM toks),
  f AS (SELECT token FROM tt WHERE ({rule('token', 'is_word')}) NOT IN ('u', 'n')),
  top AS (SELECT token, count(*) AS n FROM f GROUP BY token ORDER BY n DESC, token LIMIT 200)
SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n FROM top
"""

SQL["affix_shares"] = f"""
WITH corpus AS ({CORPUS}),
  words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM corpus),
  {AFFIXES},
  top AS (SELECT affix, count(*) AS n FROM a GROUP BY affix ORDER BY n DESC, affix LIMIT 1000),
  u AS (SELECT doc_id, replace(' ' || trim(array_to_string(regexp_extract_all(lower(text), '{TK}'), ' '))
                               || ' ', ' ', '_') AS u FROM corpus),
  c AS (SELECT doc_id, affix AS feature,
               ((length(u) - length(replace(u, affix, ''))) // length(affix))::BIGINT AS n
        FROM u CROSS JOIN top),
  s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS tot FROM c)
SELECT doc_id, feature, n, round(CASE WHEN tot > 0 THEN n / tot ELSE 0 END, 6) AS value
FROM s WHERE n > 0
"""

SQL["masked_text"] = f"""
WITH {MFW_COUNTS},
  v AS (SELECT list(token) AS mfw FROM top)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '{TK}'),
         lambda t: CASE WHEN NOT regexp_matches(t, '{IS_WORD}') OR list_contains(mfw, t) THEN t
                        ELSE {rule('t')} END), ' ') AS masked
FROM corpus CROSS JOIN v
"""

SQL["relative_freq"] = f"""
WITH {MFW_COUNTS},
  tot AS (SELECT doc_id, sum(n) AS tot FROM fc GROUP BY doc_id)
SELECT doc_id, token AS feature, round(n / tot, 6) AS value FROM fc JOIN tot USING (doc_id)
"""

def normalised(unit: str) -> str:
    """From grid(unit, token, n) to zl(unit, feature, value)."""
    return f"""
  rel AS (SELECT {unit}, token, CASE WHEN sum(n) OVER (PARTITION BY {unit}) > 0
                 THEN n / sum(n) OVER (PARTITION BY {unit}) ELSE 0 END AS x FROM cell),
  st2 AS (SELECT token, avg(x) AS mu, stddev_samp(x) AS sd FROM rel GROUP BY token
          HAVING min(x) < max(x)),
  z AS (SELECT {unit}, token, (x - mu) / sd AS z FROM rel JOIN st2 USING (token)),
  l AS (SELECT *, sqrt(sum(z * z) OVER (PARTITION BY {unit})) AS norm FROM z),
  zl AS (SELECT {unit}, token AS feature, CASE WHEN norm > 0 THEN z / norm ELSE 0 END AS value
         FROM l)
"""


ZL2 = f"""
  {MFW_COUNTS},
  cell AS (SELECT g.doc_id, g.token, coalesce(fc.n, 0) AS n
           FROM (SELECT e.doc_id, t.token FROM corpus e CROSS JOIN top t) g
           LEFT JOIN fc USING (doc_id, token)),
  {normalised("doc_id")}
"""

AUTHOR_ZL2 = f"""
  {PROFILES},
  tot AS (SELECT author, sum(n) AS tot FROM ac GROUP BY author),
  mint AS (SELECT CASE WHEN count(*) < (SELECT n_docs FROM na) THEN 0 ELSE min(tot) END AS m
           FROM tot),
  grid AS (SELECT a.author, t.token, coalesce(ac.n, 0) AS n
           FROM (SELECT DISTINCT author FROM corpus) a CROSS JOIN top t
           LEFT JOIN ac ON ac.author = a.author AND ac.token = t.token),
  sh AS (SELECT author, token, coalesce(n / tot, 0) AS x FROM grid LEFT JOIN tot USING (author)),
  mid AS (SELECT token, (max(x) + min(x)) / 2 AS m FROM sh GROUP BY token),
  dev AS (SELECT token, m, sum((x - m) ^ 2) AS ss FROM sh JOIN mid USING (token) GROUP BY ALL),
  kept AS (SELECT token FROM dev
           WHERE ss > 0 AND m * (1 - m) * (1.91 * 1.91) * (2 * (SELECT n_docs FROM na) - 1)
                 / (8 * ss) <= (SELECT m FROM mint)),
  cell AS (SELECT * FROM grid WHERE token IN (SELECT token FROM kept)),
  {normalised("author")},
  leaf AS (SELECT author, row_number() OVER (ORDER BY author) - 1 AS leaf
           FROM (SELECT DISTINCT author FROM corpus)),
  base AS (SELECT x.leaf AS a, y.leaf AS b, sum(abs(u.value - v.value)) AS d
           FROM zl u JOIN zl v ON u.feature = v.feature AND u.author < v.author
           JOIN leaf x ON x.author = u.author JOIN leaf y ON y.author = v.author GROUP BY ALL)
"""

HEIGHT = {
    "average": "avg(d)", "complete": "max(d)", "single": "min(d)",
    "ward": "sqrt(2 * na * nb / (na + nb) * (sum(d * d) / (na * nb) - wa / na ^ 2 - wb / nb ^ 2))",
}


def tree(method: str) -> str:
    """One merge at a time: heights of all cluster pairs from the base distances, the
    least one merges (part: which cluster a leaf is in after a step)."""
    return f"""
WITH RECURSIVE {AUTHOR_ZL2},
  part(step, leaf, c, a, b, h) AS (
    SELECT 0, leaf, leaf, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM leaf
    UNION ALL
    (WITH size AS (SELECT c, count(*) AS n FROM part GROUP BY c),
      within AS (SELECT p.c, sum(d * d) AS w FROM part p JOIN part q ON p.c = q.c AND p.leaf < q.leaf
                 JOIN base ON base.a = p.leaf AND base.b = q.leaf GROUP BY p.c),
      cross_d AS (SELECT least(p.c, q.c) AS x, greatest(p.c, q.c) AS y, d
                  FROM base JOIN part p ON p.leaf = base.a JOIN part q ON q.leaf = base.b
                  WHERE p.c <> q.c),
      heights AS (SELECT x, y, {HEIGHT[method]} AS h
                  FROM (SELECT x, y, d, s.n::DOUBLE AS na, t.n::DOUBLE AS nb,
                               coalesce(u.w, 0) AS wa, coalesce(v.w, 0) AS wb
                        FROM cross_d JOIN size s ON s.c = x JOIN size t ON t.c = y
                        LEFT JOIN within u ON u.c = x LEFT JOIN within v ON v.c = y)
                  GROUP BY x, y, na, nb, wa, wb),
      best AS (SELECT x, y, h FROM heights ORDER BY h, x, y LIMIT 1)
    SELECT step + 1, leaf, CASE WHEN c = best.y THEN best.x ELSE c END, best.x, best.y, best.h
    FROM part, best)),
  merges AS (SELECT step, any_value(a) AS a, any_value(b) AS b, any_value(h) AS h,
                    count(*) FILTER (c = a) AS size FROM part WHERE step > 0 GROUP BY step),
  n AS (SELECT count(*) AS n FROM leaf),
  ends AS (SELECT m.step, m.h, m.size,
             coalesce((SELECT max(e.step) FROM merges e WHERE e.a = m.a AND e.step < m.step) + n - 1,
                      m.a) AS u,
             coalesce((SELECT max(e.step) FROM merges e WHERE e.a = m.b AND e.step < m.step) + n - 1,
                      m.b) AS v
           FROM merges m, n)
"""


TREE_OUT = """
SELECT step::BIGINT AS step, least(u, v)::BIGINT AS left, greatest(u, v)::BIGINT AS right,
       round(h, 6) AS height, size FROM ends
"""
SQL["ward_linkage"] = tree("ward") + TREE_OUT
SQL["linkage_average"] = tree("average") + TREE_OUT
SQL["linkage_complete"] = tree("complete") + TREE_OUT
SQL["linkage_single"] = tree("single") + TREE_OUT

CLUSTERS = """,
  flat AS (SELECT leaf, c FROM part WHERE step = ({step})),
  num AS (SELECT c, row_number() OVER (ORDER BY min(leaf)) AS cluster FROM flat GROUP BY c)
SELECT author, cluster FROM flat JOIN num USING (c) JOIN leaf USING (leaf)
"""
SQL["clusters_k"] = tree("ward") + CLUSTERS.format(step="SELECT n - 9 FROM n")
SQL["clusters_height"] = tree("average") + CLUSTERS.format(
    step="SELECT count(*) FROM merges WHERE h < 8.0")
SQL["cut_height"] = tree("ward") + """
SELECT 9::BIGINT AS k, round(avg(h), 6) AS height FROM merges, n WHERE step IN (n - 9, n - 8)
"""

SQL["zscore_l2"] = f"""
WITH {ZL2}
SELECT doc_id, feature, round(value, 6) AS value FROM zl
"""

SQL["eta2"] = f"""
WITH {ZL2},
  v AS (SELECT zl.*, e.author FROM zl JOIN corpus e USING (doc_id)),
  m AS (SELECT feature, avg(value) AS mu FROM v GROUP BY feature),
  b AS (SELECT feature, sum(nc * (mc - mu) ^ 2) AS ssb FROM (
          SELECT feature, author, count(*) AS nc, avg(value) AS mc FROM v GROUP BY ALL)
        JOIN m USING (feature) GROUP BY feature),
  t AS (SELECT v.feature, sum((value - mu) ^ 2) AS sst FROM v JOIN m USING (feature)
        GROUP BY v.feature)
SELECT feature, round(CASE WHEN sst > 0 THEN ssb / sst END, 6) AS eta2 FROM b JOIN t USING (feature)
"""

SQL["drop_low"] = f"""
WITH {mfw(1000)},
  per AS (SELECT token, sum(n) AS total, count(DISTINCT n) AS ndv, count(*) AS rows
          FROM fc GROUP BY token)
SELECT token AS feature, total::BIGINT AS total FROM per
WHERE total > 10 AND ndv + CASE WHEN rows < (SELECT n_docs FROM nd) THEN 1 ELSE 0 END
      > round_even((SELECT n_docs FROM nd) * 0.01, 0)
"""

SQL["ranked_features"] = f"""
WITH corpus AS ({CORPUS}),
  words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM corpus),
  t AS (SELECT token AS feature, count(*) AS n FROM words WHERE token IN ({FWORDS})
        GROUP BY token ORDER BY n DESC, feature LIMIT 10)
SELECT row_number() OVER (ORDER BY n DESC, feature) AS rank, feature, n FROM t
"""

TURNS = f"""
  turn_words AS (SELECT conv_id || '-' || turn AS doc_id,
                        unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM conversations),
  tc AS (SELECT doc_id, token AS feature, count(*)::DOUBLE AS value FROM turn_words GROUP BY ALL)
"""

SQL["align_features"] = f"""
WITH {MFW_COUNTS}, {TURNS}
SELECT doc_id, feature, value FROM tc WHERE feature IN (SELECT token FROM top)
"""

SQL["missing_features"] = f"""
WITH {mfw(1000)}, {TURNS}
SELECT token AS feature FROM top WHERE token NOT IN (SELECT feature FROM tc)
"""

SQL["merge_corpora"] = f"""
WITH {MFW_COUNTS}, {TURNS},
  m AS (SELECT 'documents' AS corpus, token AS feature, n::DOUBLE AS value FROM fc
        UNION ALL
        SELECT 'turns', feature, value FROM tc WHERE feature IN (SELECT token FROM top))
SELECT corpus, feature, sum(value)::BIGINT AS n, count(*) AS n_docs FROM m GROUP BY ALL
"""

SAMPLES = f"""
  d AS (SELECT doc_id, regexp_extract_all(lower(text), '{TK}') AS toks FROM documents),
  meta AS (SELECT doc_id,
             CASE WHEN len(toks) < 2000 THEN greatest((len(toks) - 1000) // 2, 0) ELSE 500 END
               AS margin,
             CASE WHEN len(toks) >= 2000 AND (len(toks) - 1000) // 1000 > 1
                  THEN least((len(toks) - 1000) // 1000, 5) ELSE 1 END AS nsel
           FROM d),
  t AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(0, len(toks))) AS pos FROM d),
  t2 AS (SELECT t.doc_id, t.tok, t.pos, regexp_matches(t.tok, '{IS_WORD}')::INT AS w
         FROM t JOIN meta USING (doc_id) WHERE t.pos >= meta.margin),
  t3 AS (SELECT *, (coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000)::BIGINT AS sample
         FROM t2),
  s AS (SELECT doc_id, sample, min(pos) AS start_pos, max(pos) AS end_pos,
               count(*) AS n_tokens, sum(w)::BIGINT AS length,
               string_agg(tok, ' ' ORDER BY pos) AS tokens
        FROM t3 GROUP BY doc_id, sample HAVING sum(w) = 1000),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id
                    ORDER BY md5('42|' || doc_id || '|' || sample)) AS rk FROM s),
  sel AS (SELECT r.* FROM r JOIN meta USING (doc_id) WHERE rk <= nsel)
"""

SQL["text_samples"] = f"""
WITH {SAMPLES}
SELECT doc_id, sample, start_pos, end_pos, n_tokens, length, tokens FROM sel
"""

SQL["sample_shares"] = f"""
WITH {SAMPLES},
  st AS (SELECT t3.* FROM t3 JOIN sel USING (doc_id, sample)),
  aw AS (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM documents),
  mfw AS (SELECT token FROM aw WHERE ({rule('token')}) <> 'n'
          GROUP BY token ORDER BY count(*) DESC, token LIMIT 1000),
  tg AS (SELECT list_transform(regexp_extract_all(lower(text), '{W}'), lambda w: {rule('w')})
           AS tags FROM documents),
  tri AS (SELECT unnest(list_transform(range(1, len(tags) - 1),
                 lambda i: tags[i] || '-' || tags[i + 1] || '-' || tags[i + 2])) AS trigram
          FROM tg WHERE len(tags) >= 3),
  mfp AS (SELECT trigram FROM tri GROUP BY trigram ORDER BY count(*) DESC, trigram LIMIT 100),
  wc AS (SELECT doc_id, sample, tok, count(*) AS n FROM st
         WHERE w = 1 AND tok IN (SELECT token FROM mfw) GROUP BY ALL),
  ws AS (SELECT doc_id, sample, '$MFW$' || tok AS feature,
                n / sum(n) OVER (PARTITION BY doc_id, sample) AS value FROM wc),
  sw AS (SELECT doc_id, sample, pos, {rule('tok')} AS tag FROM st WHERE w = 1),
  sg AS (SELECT doc_id, sample, tag || '-' || lead(tag, 1) OVER wdw || '-'
                || lead(tag, 2) OVER wdw AS trigram
         FROM sw WINDOW wdw AS (PARTITION BY doc_id, sample ORDER BY pos)),
  pc AS (SELECT doc_id, sample, trigram, count(*) AS n FROM sg
         WHERE trigram IN (SELECT trigram FROM mfp) GROUP BY ALL),
  ps AS (SELECT doc_id, sample, '$POS$' || trigram AS feature,
                n / sum(n) OVER (PARTITION BY doc_id, sample) AS value FROM pc)
SELECT doc_id, sample, feature, round(value, 6) AS value FROM ws
UNION ALL
SELECT doc_id, sample, feature, round(value, 6) AS value FROM ps
"""

SQL["group_split"] = f"""
WITH corpus AS ({CORPUS}),
  per AS (SELECT author, count(*) AS c FROM corpus GROUP BY author),
  elig AS (SELECT author FROM per WHERE c >= 2),
  r AS (SELECT author, row_number() OVER (ORDER BY md5('42|' || author), author) AS r FROM elig),
  nt AS (SELECT floor(count(*) * 10 / 100) AS t FROM elig),
  k AS (SELECT author, CASE WHEN r <= (SELECT t FROM nt) THEN 'test'
                            WHEN r <= 2 * (SELECT t FROM nt) THEN 'dev' ELSE 'train' END AS split
        FROM r)
SELECT e.doc_id, e.author, coalesce(k.split, 'train') AS split
FROM corpus e LEFT JOIN k USING (author)
"""

SQL["holdout_split"] = """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS rk,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN rk <= round_even(n * 0.9, 0) THEN 'train' ELSE 'holdout' END
       AS split FROM r
"""

SQL["kfold_roles"] = f"""
WITH corpus AS ({CORPUS}),
  r AS (SELECT doc_id, author, row_number() OVER (PARTITION BY author ORDER BY doc_id) - 1 AS r0,
               count(*) OVER (PARTITION BY author) AS n FROM corpus),
  c AS (SELECT *, n // 5 AS q, n % 5 AS m FROM r),
  c2 AS (SELECT doc_id, author,
                CASE WHEN r0 < m * (q + 1) THEN r0 // (q + 1)
                     ELSE m + (r0 - m * (q + 1)) // greatest(q, 1) END AS chunk FROM c),
  f AS (SELECT c2.*, unnest(range(0, 5)) AS fold FROM c2)
SELECT doc_id, author, fold,
       CASE WHEN chunk = fold THEN 'dev' WHEN chunk = (fold + 1) % 5 THEN 'test' ELSE 'train' END
         AS role
FROM f
"""

SQL["under_sample"] = """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS rk
           FROM labels),
  mn AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM labels GROUP BY quality))
SELECT doc_id, quality FROM r WHERE rk <= (SELECT m FROM mn)
"""

SQL["over_sample"] = """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS rk,
                  count(*) OVER (PARTITION BY quality) AS n FROM labels),
  mx AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM labels GROUP BY quality)),
  c AS (SELECT *, (SELECT m FROM mx) // n
                  + CASE WHEN rk <= (SELECT m FROM mx) - ((SELECT m FROM mx) // n) * n THEN 1 ELSE 0 END
                  AS copies FROM r)
SELECT doc_id, quality, unnest(range(1, copies + 1)) AS copy FROM c
"""

SQL["m_per_class"] = f"""
WITH corpus AS ({CORPUS}),
  e AS (SELECT doc_id, author, unnest(range(0, 2)) AS epoch FROM corpus),
  r AS (SELECT *, row_number() OVER (PARTITION BY epoch, author
                  ORDER BY md5('42|' || epoch || '|' || doc_id), doc_id) AS rk FROM e)
SELECT doc_id, author, epoch, (rk - 1) // 4 AS batch FROM r
"""

EMB = """
  e AS (SELECT vec_id, label, embedding,
               sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nrm
        FROM embeddings)
"""

def unit_pairs(compared: str = "a.vec_id % 20 = 0 AND ") -> str:
    return f"""
  {EMB},
  p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.label AS left_label,
               b.label AS right_label,
               round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
                 lambda i: (a.embedding[i]::DOUBLE / a.nrm - b.embedding[i]::DOUBLE / b.nrm) ^ 2))), 6)
                 AS distance,
               a.label = b.label AS is_pair
        FROM e a JOIN e b ON {compared}a.vec_id <> b.vec_id)
"""


UNIT_PAIRS = unit_pairs()

SQL["manhattan_pairs"] = f"""
WITH {EMB}
SELECT a.vec_id AS left_id, b.vec_id AS right_id,
       round(list_sum(list_transform(range(1, len(a.embedding) + 1),
         lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS distance,
       a.label = b.label AS is_pair
FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
"""

SQL["snr_pairs"] = f"""
WITH {EMB}
SELECT a.vec_id AS left_id, b.vec_id AS right_id,
       round(list_var_samp(list_transform(range(1, len(a.embedding) + 1),
               lambda i: a.embedding[i]::DOUBLE / a.nrm - b.embedding[i]::DOUBLE / b.nrm))
             / list_var_samp(list_transform(a.embedding, lambda x: x::DOUBLE / a.nrm)), 6)
         AS distance
FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
"""

SQL["cosine_pairs"] = f"""
WITH {EMB}
SELECT a.vec_id AS left_id, b.vec_id AS right_id,
       round(1 - list_sum(list_transform(range(1, len(a.embedding) + 1),
         lambda i: a.embedding[i]::DOUBLE / a.nrm * (b.embedding[i]::DOUBLE / b.nrm))), 6) AS distance
FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
"""

SQL["sqeuclidean_pairs"] = f"""
WITH {EMB}
SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.label AS left_label, b.label AS right_label,
       round(list_sum(list_transform(range(1, len(a.embedding) + 1),
         lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ^ 2)), 6) AS distance
FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
"""

FRAME = f"""
  {UNIT_PAIRS},
  f AS (SELECT left_label::VARCHAR AS ComparedClass, left_id::VARCHAR AS ComparedLabel,
               right_label::VARCHAR AS ComparatorClass, right_id::VARCHAR AS ComparatorLabel,
               distance AS Distance, round(1 - distance, 6) AS Probability,
               distance < 1.4 AS Attribution, left_label = right_label AS IsAPair, 0 AS K
        FROM p)
"""

SQL["vector_pairs"] = f"WITH {FRAME} SELECT * FROM f"

SQL["pair_scores"] = f"""
WITH {FRAME},
  c AS (SELECT *, (IsAPair = Attribution)::DOUBLE AS correct FROM f WHERE IsAPair IS NOT NULL),
  s AS (SELECT ComparedClass AS Class, avg(correct) AS Accuracy,
               avg(CASE WHEN ComparedClass = ComparatorClass THEN correct END) AS Precision,
               avg(CASE WHEN ComparedClass <> ComparatorClass THEN correct END) AS Recall
        FROM c GROUP BY ComparedClass)
SELECT Class, round(Accuracy, 6) AS Accuracy, round(Precision, 6) AS Precision,
       round(Recall, 6) AS Recall, 0 AS K
FROM s WHERE Precision IS NOT NULL AND Recall IS NOT NULL
"""

CURVE = f"""
  {UNIT_PAIRS},
  st AS (SELECT max(distance) AS mx, count(*) FILTER (WHERE is_pair) AS P,
                count(*) FILTER (WHERE NOT is_pair) AS N FROM p),
  t AS (SELECT 0.005::DOUBLE + i * 0.005::DOUBLE AS t
        FROM range(0, (SELECT ceil((mx - 0.005::DOUBLE) / 0.005::DOUBLE) FROM st)::BIGINT) r(i)),
  c AS (SELECT t.t,
               count(*) FILTER (WHERE p.distance <= t.t AND p.is_pair) AS tp,
               count(*) FILTER (WHERE p.distance <= t.t AND NOT p.is_pair) AS fp,
               count(*) FILTER (WHERE p.distance < t.t AND p.is_pair) AS tps,
               count(*) FILTER (WHERE p.distance < t.t AND NOT p.is_pair) AS fps
        FROM t CROSS JOIN p GROUP BY t.t),
  curve AS (
    SELECT c.t AS Threshold, tp / P AS Sensitivity, (N - fp) / N AS Specificity,
           CASE WHEN 2 * tps + fps + (P - tps) > 0 THEN 2 * tps / (2 * tps + fps + (P - tps))
                ELSE 0 END AS F1,
           (tps / P + (N - fps) / N) / 2 AS AuRoc, 0 AS K
    FROM c CROSS JOIN st)
"""

SQL["threshold_curve"] = f"""
WITH {CURVE}
SELECT round(Threshold, 6) AS Threshold, round(Sensitivity, 6) AS Sensitivity,
       round(Specificity, 6) AS Specificity, round(F1, 6) AS F1, round(AuRoc, 6) AS AuRoc, K
FROM curve
"""

SQL["best_threshold"] = f"""
WITH {CURVE}
SELECT round(Threshold, 6) AS Threshold, round(Sensitivity, 6) AS Sensitivity,
       round(Specificity, 6) AS Specificity, round(F1, 6) AS F1, round(AuRoc, 6) AS AuRoc, K
FROM curve ORDER BY Sensitivity + 2 * Specificity DESC, Threshold LIMIT 1
"""

SQL["roc_auc"] = f"""
WITH {UNIT_PAIRS},
  r AS (SELECT distance, is_pair, rank() OVER (ORDER BY distance DESC) AS rk,
               count(*) OVER (PARTITION BY distance) AS c FROM p),
  s AS (SELECT sum(CASE WHEN is_pair THEN rk + (c - 1) / 2.0 END) AS sr,
               count(*) FILTER (WHERE is_pair) AS P, count(*) FILTER (WHERE NOT is_pair) AS N FROM r)
SELECT round((sr - P * (P + 1) / 2.0) / (P * N), 6) AS auc FROM s
"""

SQL["roc_curve"] = f"""
WITH {UNIT_PAIRS},
  st AS (SELECT count(*) FILTER (WHERE is_pair) AS P, count(*) FILTER (WHERE NOT is_pair) AS N
         FROM p),
  c AS (SELECT distance, count(*) FILTER (WHERE is_pair) AS pos,
               count(*) FILTER (WHERE NOT is_pair) AS neg FROM p GROUP BY distance),
  s AS (SELECT distance, sum(pos) OVER (ORDER BY distance) AS cp,
               sum(neg) OVER (ORDER BY distance) AS cn FROM c)
SELECT distance AS threshold, round(cn / N, 6) AS fpr, round(cp / P, 6) AS tpr FROM s, st
"""

SQL["batch_mining"] = f"""
WITH {EMB},
  r AS (SELECT vec_id, label, embedding, nrm, epoch,
               (row_number() OVER (PARTITION BY epoch, label
                  ORDER BY md5('42|' || epoch || '|' || vec_id), vec_id) - 1) // 4 AS batch
        FROM e, unnest(range(0, 2)) AS u(epoch)),
  p AS (SELECT a.epoch, a.batch, a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same,
               round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
                 lambda i: (a.embedding[i]::DOUBLE / a.nrm - b.embedding[i]::DOUBLE / b.nrm) ^ 2))), 6)
                 AS d
        FROM r a JOIN r b ON a.epoch = b.epoch AND a.batch = b.batch AND a.vec_id <> b.vec_id),
  once AS (SELECT *, rank() OVER (PARTITION BY epoch, batch ORDER BY d DESC) AS rk,
                  count(*) OVER (PARTITION BY epoch, batch, d) AS c FROM p WHERE anchor < other),
  auc AS (SELECT epoch, batch, count(*) AS n_pairs, count(*) FILTER (same) AS n_true,
                 sum(CASE WHEN same THEN rk + (c - 1) / 2.0 END) AS sr FROM once GROUP BY ALL),
  anchors AS (SELECT epoch, batch, anchor, min(d) FILTER (same) AS ep, max(d) FILTER (same) AS hp,
                     max(d) FILTER (NOT same) AS en, min(d) FILTER (NOT same) AS hn
              FROM p GROUP BY ALL),
  mined AS (SELECT a.*, (SELECT min(d) FROM p WHERE p.epoch = a.epoch AND p.batch = a.batch
                        AND p.anchor = a.anchor AND NOT same AND d > a.ep) AS sn
           FROM anchors a WHERE ep IS NOT NULL AND hn IS NOT NULL),
  sums AS (SELECT epoch, batch, count(*) AS n_anchors, count(sn) AS n_semihard,
                  sum(ep) AS easy_positive, sum(hp) AS hard_positive, sum(en) AS easy_negative,
                  coalesce(sum(sn), 0) AS semihard_negative, sum(hn) AS hard_negative
            FROM mined GROUP BY ALL),
  sizes AS (SELECT epoch, batch, count(*) AS n_rows FROM r GROUP BY ALL)
SELECT epoch, batch, n_rows, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_true, 0) AS n_true,
       coalesce(n_anchors, 0) AS n_anchors, coalesce(n_semihard, 0) AS n_semihard,
       round((sr - n_true * (n_true + 1) / 2.0) / (n_true * nullif(n_pairs - n_true, 0)), 5) AS auroc,
       round(coalesce(easy_positive, 0), 6) AS easy_positive,
       round(coalesce(hard_positive, 0), 6) AS hard_positive,
       round(coalesce(easy_negative, 0), 6) AS easy_negative,
       round(coalesce(semihard_negative, 0), 6) AS semihard_negative,
       round(coalesce(hard_negative, 0), 6) AS hard_negative
FROM sizes LEFT JOIN auc USING (epoch, batch) LEFT JOIN sums USING (epoch, batch)
"""

SQL["roc_thinned"] = f"""
WITH {UNIT_PAIRS},
  st AS (SELECT count(*) FILTER (WHERE is_pair) AS P, count(*) FILTER (WHERE NOT is_pair) AS N
         FROM p),
  c AS (SELECT distance, count(*) FILTER (WHERE is_pair) AS pos,
               count(*) FILTER (WHERE NOT is_pair) AS neg FROM p GROUP BY distance),
  s AS (SELECT distance, sum(pos) OVER (ORDER BY distance) AS cp,
               sum(neg) OVER (ORDER BY distance) AS cn,
               row_number() OVER (ORDER BY distance) - 1 AS place FROM c),
  t AS (SELECT *, lag(cp) OVER (ORDER BY distance) AS before FROM s WHERE place % 10 = 0)
SELECT distance AS threshold, round(cn / N, 6) AS fpr, round(cp / P, 6) AS tpr
FROM t, st WHERE before IS NULL OR cp <> before
"""

SQL["encode_bilevel"] = f"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{W}') AS w FROM conversations),
  toks AS (SELECT conv_id, turn, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM t),
  v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id
        FROM toks GROUP BY token HAVING count(*) >= 5),
  sized AS (SELECT max(n) AS sentences, max(words) AS words FROM (
              SELECT conv_id, count(*) AS n, max(len(w)) AS words FROM t GROUP BY conv_id)),
  padded AS (
    SELECT conv_id, turn, list_resize(list_transform(w, lambda x: 1), (SELECT words FROM sized), 1)
             AS plain FROM t),
  coded AS (SELECT conv_id, turn, toks.pos, coalesce(v.id, 0) AS id FROM toks LEFT JOIN v USING (token)),
  sent AS (
    SELECT p.conv_id, p.turn, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY c.pos), '') AS ids,
           count(id) AS n FROM padded p LEFT JOIN coded c USING (conv_id, turn) GROUP BY ALL),
  full_sent AS (
    SELECT conv_id, turn, n, trim(ids || repeat(' 1', ((SELECT words FROM sized) - n)::INT)) AS ids
    FROM sent)
SELECT conv_id, count(*) AS n_sentences, max(n) AS longest,
       string_agg(ids, '/' ORDER BY turn)
         || repeat('/' || trim(repeat(' 1', (SELECT words FROM sized)::INT)),
                   ((SELECT sentences FROM sized) - count(*))::INT) AS ids
FROM full_sent GROUP BY conv_id
"""

SQL["strong_thresholds"] = f"""
WITH {UNIT_PAIRS},
  q AS (SELECT quantile_cont(distance, [0.25, 0.5, 0.75, 0.9]) AS qs FROM p WHERE is_pair)
SELECT unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS percentile, round(unnest(qs), 9) AS threshold
FROM q
"""

SQL["f05u"] = f"""
WITH {UNIT_PAIRS},
  pr AS (SELECT CASE WHEN abs(distance - 1.4) <= 0.01 THEN 0.5 WHEN distance < 1.4 THEN 1.0
                     ELSE 0.0 END AS pred, is_pair AS t FROM p),
  s AS (SELECT count(*) FILTER (WHERE pred = 0.5) AS n_u,
               count(*) FILTER (WHERE pred = 1.0 AND t) AS n_tp,
               count(*) FILTER (WHERE pred = 1.0 AND NOT t) AS n_fp,
               count(*) FILTER (WHERE pred = 0.0 AND t) AS n_fn FROM pr)
SELECT round(1.25 * n_tp / (1.25 * n_tp + 0.25 * (n_fn + n_u) + n_fp), 6) AS f05u,
       n_tp, n_fp, n_fn, n_u FROM s
"""

SQL["hard_pairs"] = f"""
WITH {UNIT_PAIRS}
SELECT left_id, right_id, distance FROM p WHERE NOT is_pair
ORDER BY distance, left_id, right_id LIMIT 20
"""

SQL["pair_losses"] = f"""
WITH {UNIT_PAIRS},
  c AS (SELECT avg(CASE WHEN is_pair AND distance > 0 THEN distance END) AS pos_loss,
               avg(CASE WHEN NOT is_pair AND 1 - distance > 0 THEN 1 - distance END) AS neg_loss
        FROM p),
  a AS (SELECT left_id AS anchor, distance, is_pair FROM p),
  m AS (SELECT anchor, max(distance) FILTER (WHERE is_pair) AS d_ap,
               min(distance) FILTER (WHERE NOT is_pair) AS d_an FROM a GROUP BY anchor),
  t AS (SELECT avg(CASE WHEN d_ap - d_an + 0.05 > 0 THEN d_ap - d_an + 0.05 END) AS triplet_loss,
               count(*) AS n_anchors FROM m WHERE d_ap IS NOT NULL AND d_an IS NOT NULL)
SELECT round(pos_loss, 6) AS pos_loss, round(neg_loss, 6) AS neg_loss,
       round(coalesce(pos_loss, 0) + coalesce(neg_loss, 0), 6) AS contrastive_loss,
       round(triplet_loss, 6) AS triplet_loss, n_anchors
FROM c, t
"""

SQL["mined_triplets"] = f"""
WITH {UNIT_PAIRS},
  m AS (SELECT left_id AS anchor, min(distance) FILTER (WHERE is_pair) AS d_ap,
               max(distance) FILTER (WHERE NOT is_pair) AS d_easy FROM p GROUP BY left_id)
SELECT anchor, d_ap, (SELECT min(distance) FROM p WHERE left_id = anchor AND NOT is_pair
                      AND distance > d_ap) AS d_an, d_easy
FROM m
"""

SQL["threshold_confusion"] = f"""
WITH {UNIT_PAIRS}
SELECT count(*) FILTER (WHERE distance <= 1.4 AND is_pair) AS tp,
       count(*) FILTER (WHERE distance <= 1.4 AND NOT is_pair) AS fp,
       count(*) FILTER (WHERE distance > 1.4 AND NOT is_pair) AS tn,
       count(*) FILTER (WHERE distance > 1.4 AND is_pair) AS fn
FROM p
"""

SQL["asof_rates"] = f"""
WITH {unit_pairs("")},
  h0 AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id)
                  AS rk, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
  j AS (SELECT p.*, rk > round_even(n * 0.9, 0) AS held FROM p JOIN h0 ON p.right_id = h0.vec_id),
  ref AS (SELECT * FROM j WHERE NOT held),
  q AS (SELECT DISTINCT round(distance, 2) AS distance FROM j WHERE held),
  st AS (SELECT count(*) FILTER (WHERE is_pair) AS P, count(*) FILTER (WHERE NOT is_pair) AS N
         FROM ref),
  c AS (SELECT q.distance, count(*) FILTER (WHERE ref.is_pair) AS tp,
               count(*) FILTER (WHERE NOT ref.is_pair) AS fp
        FROM q LEFT JOIN ref ON ref.distance <= q.distance GROUP BY q.distance)
SELECT distance, round(tp / P, 6) AS tpr,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision,
       round(fp / N, 6) AS fpr, tp, fp, N - fp AS tn, P - tp AS fn
FROM c, st
"""

PPM = """
  cv AS (SELECT conv_id, turn, role, text, conv_id || '-' || turn AS doc FROM conversations),
  cp AS (SELECT doc, text, unnest(range(0, length(text))) AS i FROM cv WHERE length(text) > 0),
  pos AS (SELECT doc, substring(text, greatest(i - 5, 0) + 1, least(i, 5)) AS c,
                 substring(text, i + 1, 1) AS ch FROM cp),
  sfx AS (SELECT doc, c, ch, unnest(range(0, length(c) + 1)) AS k FROM pos),
  grams AS (SELECT doc, right(c, k::INT) AS ctx, ch, count(*) AS n FROM sfx GROUP BY ALL)
"""

SQL["char_model"] = f"""
WITH {PPM}
SELECT doc, length(ctx) AS k, count(DISTINCT ctx) AS n_contexts, count(*) AS n_grams,
       sum(n)::BIGINT AS n_chars
FROM grams GROUP BY ALL
"""

SQL["cross_entropy"] = f"""
WITH {PPM},
  v AS (SELECT count(DISTINCT ch) AS v FROM pos),
  tot AS (SELECT doc, ctx, sum(n) AS tot FROM grams GROUP BY ALL),
  m AS (SELECT g.doc AS a, g.ctx, g.ch, g.n / t.tot AS p FROM grams g JOIN tot t USING (doc, ctx)),
  tc AS (SELECT doc AS b, c, ch, count(*) AS cnt FROM pos GROUP BY ALL),
  len AS (SELECT b, sum(cnt) AS len FROM tc GROUP BY b),
  tp AS (SELECT x.conv_id, x.turn AS turn_a, y.turn AS turn_b, x.doc AS a, y.doc AS b,
                x.role = y.role AS is_pair
         FROM cv x JOIN cv y ON x.conv_id = y.conv_id AND y.turn IN (x.turn + 1, x.turn + 2)),
  op AS (SELECT a, b FROM tp UNION SELECT b, a FROM tp),
  q AS (SELECT op.a, op.b, tc.c, tc.ch, tc.cnt, unnest(range(0, length(tc.c) + 1)) AS k
        FROM op JOIN tc ON tc.b = op.b),
  hit AS (SELECT q.a, q.b, q.c, q.ch, q.cnt, q.k, m.p FROM q
          JOIN m ON m.a = q.a AND m.ctx = right(q.c, q.k::INT) AND m.ch = q.ch),
  best AS (SELECT a, b, c, ch, cnt, arg_max(p, k) AS p FROM hit GROUP BY ALL),
  per AS (SELECT a, b, sum(cnt * -log2(p)) AS bits, sum(cnt) AS hits FROM best GROUP BY ALL),
  h AS (SELECT op.a, op.b, (coalesce(per.bits, 0) + (len.len - coalesce(per.hits, 0))
                            * log2((SELECT v FROM v))) / len.len AS h
        FROM op LEFT JOIN len ON len.b = op.b LEFT JOIN per ON per.a = op.a AND per.b = op.b)
SELECT tp.conv_id, tp.turn_a, tp.turn_b, round(x.h, 4) AS h_ab, round(y.h, 4) AS h_ba, tp.is_pair
FROM tp JOIN h x ON x.a = tp.a AND x.b = tp.b JOIN h y ON y.a = tp.b AND y.b = tp.a
"""

SQL["imposters"] = f"""
WITH {MFW_COUNTS},
  idx AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS f FROM top),
  h0 AS (SELECT doc_id, author, row_number() OVER (PARTITION BY author
                  ORDER BY md5('42|' || doc_id), doc_id) AS rk,
                count(*) OVER (PARTITION BY author) AS n FROM corpus),
  roles AS (SELECT doc_id, author,
                   CASE WHEN rk > round_even(n * 0.9, 0) THEN 'test' ELSE 'train' END AS role
            FROM h0),
  cands AS (SELECT author AS C FROM roles WHERE role = 'train' GROUP BY author
            HAVING count(*) >= 2),
  tasks AS (SELECT C, it FROM cands, range(0, 100) r(it)),
  tf AS (SELECT C, it, f, row_number() OVER (PARTITION BY C, it
                ORDER BY md5('42|' || C || '|' || it || '|' || f), f) AS r
         FROM tasks, range(1, 101) g(f)),
  feats AS (SELECT C, it, f FROM tf WHERE r <= 50),
  mem AS (SELECT t.C, t.it, r.doc_id, r.author, 0 AS kind FROM tasks t
            JOIN roles r ON r.role = 'train' AND r.author = t.C
          UNION ALL
          SELECT C, it, doc_id, author, 1
          FROM (SELECT t.C, t.it, r.doc_id, r.author,
                       row_number() OVER (PARTITION BY t.C, t.it ORDER BY
                         md5('42|' || t.C || '|' || t.it || '|' || r.doc_id), r.doc_id) AS rk,
                       count(*) OVER (PARTITION BY t.C, t.it) AS n
                FROM tasks t JOIN roles r ON r.role = 'train' AND r.author <> t.C)
          WHERE rk <= round_even(n * 0.5, 0)
          UNION ALL
          SELECT t.C, t.it, r.doc_id, r.author, 2 FROM tasks t JOIN roles r ON r.role = 'test'),
  cells AS (SELECT m.C, m.it, m.doc_id, m.author, m.kind, fe.f,
                   coalesce(fc.n, 0)::DOUBLE AS cnt
            FROM mem m JOIN feats fe ON fe.C = m.C AND fe.it = m.it
            JOIN idx ON idx.f = fe.f
            LEFT JOIN fc ON fc.doc_id = m.doc_id AND fc.token = idx.token),
  sh AS (SELECT *, CASE WHEN sum(cnt) OVER w > 0 THEN cnt / sum(cnt) OVER w ELSE 0 END AS x
         FROM cells WINDOW w AS (PARTITION BY C, it, doc_id, kind)),
  st AS (SELECT C, it, f, avg(x) AS mu,
                CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd
         FROM sh GROUP BY C, it, f),
  z AS (SELECT sh.C, sh.it, sh.doc_id, sh.author, sh.kind, sh.f, (sh.x - st.mu) / st.sd AS z
        FROM sh JOIN st USING (C, it, f)),
  dist AS (SELECT t.C, t.it, t.doc_id AS text, r.doc_id AS ref, r.kind, r.author,
                  round(sum(abs(t.z - r.z)), 9) AS d
           FROM z t JOIN z r ON t.C = r.C AND t.it = r.it AND t.f = r.f
           WHERE t.kind = 2 AND r.kind < 2
           GROUP BY ALL),
  win AS (SELECT C, it, text, arg_min(author, (d, kind, ref)) AS proposal FROM dist GROUP BY ALL)
SELECT text AS Text, C AS Candidate, proposal AS Proposal, count(*) AS Proposed,
       100::BIGINT AS "Total-Iterations", round(count(*) / 100, 6) AS Percent
FROM win GROUP BY ALL
"""

NEAREST = f"""
  {ZL2},
  h0 AS (SELECT doc_id, author, row_number() OVER (PARTITION BY author
                  ORDER BY md5('42|' || doc_id), doc_id) AS rk,
                count(*) OVER (PARTITION BY author) AS n FROM corpus),
  roles AS (SELECT doc_id, author, rk > round_even(n * 0.9, 0) AS held FROM h0),
  dd AS (SELECT a.doc_id AS q, b.doc_id AS r, round(sum(abs(a.value - b.value)), 9) AS distance
         FROM zl a JOIN zl b ON a.feature = b.feature AND a.doc_id <> b.doc_id
         WHERE a.doc_id IN (SELECT doc_id FROM roles WHERE held)
           AND b.doc_id IN (SELECT doc_id FROM roles WHERE NOT held)
         GROUP BY ALL),
  nn AS (SELECT q, arg_min(r, (distance, r)) AS r, min(distance) AS distance FROM dd GROUP BY q),
  pred AS (SELECT nn.q AS doc_id, x.author AS truth, y.author AS prediction, nn.r AS nearest,
                  nn.distance
           FROM nn JOIN roles x ON x.doc_id = nn.q JOIN roles y ON y.doc_id = nn.r)
"""

SQL["nearest_author"] = f"""
WITH {NEAREST}
SELECT doc_id, truth, prediction, nearest, round(distance, 6) AS distance FROM pred
"""

SQL["confusion"] = f"""
WITH {NEAREST}
SELECT truth, prediction, count(*) AS n FROM pred GROUP BY ALL
"""

SQL["fold_metrics"] = f"""
WITH {NEAREST},
  c AS (SELECT truth AS cls FROM pred UNION SELECT prediction FROM pred),
  s AS (SELECT c.cls,
               (SELECT count(*) FROM pred WHERE truth = c.cls AND prediction = c.cls) AS tp,
               (SELECT count(*) FROM pred WHERE truth = c.cls) AS support,
               (SELECT count(*) FROM pred WHERE prediction = c.cls) AS predicted
        FROM c),
  m AS (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support FROM s)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                  ELSE 0 END, 6) AS f1, support
FROM m
"""

TOMEK = f"""
  {EMB},
  dd AS (SELECT a.vec_id AS q, b.vec_id AS r,
                round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
                  lambda i: (a.embedding[i]::DOUBLE / a.nrm - b.embedding[i]::DOUBLE / b.nrm) ^ 2))), 6)
                  AS distance
         FROM e a JOIN e b ON a.vec_id <> b.vec_id),
  nn AS (SELECT q, arg_min(r, (distance, r)) AS r FROM dd GROUP BY q),
  links AS (SELECT x.q AS left_id, x.r AS right_id FROM nn x JOIN nn y ON x.r = y.q AND y.r = x.q
            JOIN embeddings ex ON ex.vec_id = x.q JOIN embeddings ey ON ey.vec_id = x.r
            WHERE x.q < x.r AND ex.label <> ey.label)
"""

SQL["tomek_links"] = f"WITH {TOMEK} SELECT * FROM links"

SQL["tomek_removed"] = f"""
WITH {TOMEK}
SELECT vec_id, label FROM embeddings
WHERE vec_id NOT IN (SELECT left_id FROM links UNION SELECT right_id FROM links)
   OR label = (SELECT label FROM embeddings GROUP BY label ORDER BY count(*), label LIMIT 1)
"""

SQL["encode_docs"] = f"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{W}') AS w FROM conversations),
  toks AS (SELECT conv_id, turn, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM t),
  v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id
        FROM toks GROUP BY token HAVING count(*) >= 5),
  e AS (SELECT toks.conv_id, toks.turn, toks.pos, coalesce(v.id, 0) AS id
        FROM toks LEFT JOIN v USING (token))
SELECT conv_id, turn, count(id) AS n_tokens, count(*) FILTER (WHERE id = 0) AS n_unk,
       coalesce(string_agg(id::VARCHAR, ' ' ORDER BY pos), '') AS ids
FROM t LEFT JOIN e USING (conv_id, turn) GROUP BY ALL
"""

SQL["merge_minus_model"] = f"""
WITH {PPM},
  g AS (SELECT grams.*, cv.role, length(grams.ctx) AS k FROM grams JOIN cv USING (doc)),
  role AS (SELECT role, ctx, ch, k, sum(n) AS N FROM g GROUP BY ALL),
  role_tot AS (SELECT role, k, count(*) AS role_grams, sum(N) AS role_chars FROM role GROUP BY ALL),
  doc_tot AS (SELECT doc, role, k, sum(n) AS doc_chars FROM g GROUP BY ALL),
  gone AS (SELECT g.doc, g.k, count(*) AS gone FROM g JOIN role USING (role, ctx, ch, k)
           WHERE g.n = role.N GROUP BY ALL)
SELECT d.doc, d.k, r.role_grams - coalesce(gone.gone, 0) AS loo_grams,
       (r.role_chars - d.doc_chars)::BIGINT AS loo_chars
FROM doc_tot d JOIN role_tot r USING (role, k) LEFT JOIN gone USING (doc, k)
"""

SQL["length_summary"] = f"""
WITH d AS (SELECT source AS author, len(regexp_extract_all(text, '{W}')) AS n_words
           FROM documents),
  q AS (SELECT author, quantile_cont(n_words, [0.0, 0.25, 0.5, 0.75, 1.0]) AS qs FROM d
        GROUP BY author)
SELECT author, unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS percentile,
       round(unnest(qs), 6) AS value
FROM q
"""

SQL["eta2_classes"] = f"""
WITH {ZL2},
  v AS (SELECT zl.*, e.author FROM zl JOIN corpus e USING (doc_id)),
  m AS (SELECT feature, avg(value) AS mu FROM v GROUP BY feature),
  b AS (SELECT feature, sum(nc * (mc - mu) ^ 2) AS ssb FROM (
          SELECT feature, author, count(*) AS nc, avg(value) AS mc FROM v GROUP BY ALL)
        JOIN m USING (feature) GROUP BY feature),
  t AS (SELECT v.feature, sum((value - mu) ^ 2) AS sst FROM v JOIN m USING (feature)
        GROUP BY v.feature),
  e2 AS (SELECT feature, CASE WHEN sst > 0 THEN ssb / sst END AS eta2 FROM b JOIN t USING (feature)),
  top3 AS (SELECT feature FROM e2 ORDER BY eta2 DESC, feature LIMIT 3)
SELECT doc_id, author, feature, round(value, 6) AS value FROM v
WHERE feature IN (SELECT feature FROM top3)
"""

SQL["fold_scores"] = f"""
WITH {NEAREST},
  f AS (SELECT doc_id % 5 AS fold, truth, prediction FROM pred),
  c AS (SELECT fold, truth AS cls FROM f UNION SELECT fold, prediction FROM f),
  s AS (SELECT c.fold, c.cls,
               count(*) FILTER (f.truth = c.cls AND f.prediction = c.cls) AS tp,
               count(*) FILTER (f.truth = c.cls) AS t, count(*) FILTER (f.prediction = c.cls) AS p
        FROM c JOIN f USING (fold) GROUP BY ALL)
SELECT fold, round(sum(tp) / sum(t), 6) AS accuracy,
       round(avg(CASE WHEN p > 0 THEN tp / p ELSE 0 END), 6) AS precision,
       round(avg(CASE WHEN t > 0 THEN tp / t ELSE 0 END), 6) AS recall,
       round(avg(2 * tp / (p + t)), 6) AS f1
FROM s GROUP BY fold
"""

SMOTE = """
  v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
  sized AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS r,
                   count(*) OVER (PARTITION BY label) AS n FROM v),
  lg AS (SELECT max(n) AS largest FROM sized),
  turns AS (SELECT *, (largest - n) // n + CASE WHEN r <= (largest - n) % n THEN 1 ELSE 0 END AS t
            FROM sized, lg),
  made AS (SELECT vec_id, label, vec, n, unnest(range(1, t + 1)) AS copy FROM turns),
  chosen AS (SELECT *, ('0x' || left(md5('42|' || vec_id || '|' || copy), 8))::BIGINT
                       % least(5, n - 1) + 1 AS nb,
                    ('0x' || left(md5('42:place|' || vec_id || '|' || copy), 13))::BIGINT
                       / 4503599627370496.0::DOUBLE AS u FROM made),
  near AS (SELECT a.vec_id AS q, b.vec AS other,
                  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(sqrt(list_sum(list_transform(
                    range(1, len(a.vec) + 1), lambda i: (a.vec[i] - b.vec[i]) ^ 2))), 9), b.vec_id) AS rank
           FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
  grown AS (
    SELECT vec_id, 0::BIGINT AS copy, label, vec FROM v
    UNION ALL
    SELECT vec_id, copy, label, list_transform(range(1, len(vec) + 1),
             lambda i: vec[i] + u * (other[i] - vec[i]))
    FROM chosen JOIN near ON q = vec_id AND rank = nb)
"""

SQL["smote"] = f"""
WITH {SMOTE}
SELECT vec_id, copy, label, round(list_sum(vec), 5) AS total FROM grown
"""

SQL["smote_tomek"] = f"""
WITH {SMOTE},
  g AS (SELECT *, row_number() OVER (ORDER BY vec_id, copy) AS k FROM grown),
  dd AS (SELECT a.k AS q, b.k AS r, round(sqrt(list_sum(list_transform(range(1, len(a.vec) + 1),
                  lambda i: (a.vec[i] - b.vec[i]) ^ 2))), 6) AS d FROM g a JOIN g b ON a.k <> b.k),
  nn AS (SELECT q, arg_min(r, (d, r)) AS r FROM dd GROUP BY q),
  ends AS (SELECT x.q FROM nn x JOIN nn y ON x.r = y.q AND y.r = x.q JOIN g a ON a.k = x.q
           JOIN g b ON b.k = x.r WHERE a.label <> b.label)
SELECT label, count(*) AS n, count(*) FILTER (copy > 0) AS n_new FROM g
WHERE k NOT IN (SELECT q FROM ends) GROUP BY label
"""

TITLES = "t AS (SELECT doc_id, source, string_split(text, chr(10))[1] AS title FROM documents)"
NEEDLES = """(contains(lower(title), 'idiot') OR contains(lower(title), 'scum')
   OR contains(lower(title), 'loser') OR contains(lower(title), 'copyright')
   OR contains(lower(title), 'licensed') OR ends_with(lower(title), ' et')
   OR ends_with(lower(title), ' and') OR ends_with(lower(title), ' und'))"""

SQL["author_rules"] = f"WITH {TITLES} SELECT doc_id, {NEEDLES} AS blocked FROM t"

SQL["author_clean"] = f"""
WITH {TITLES}
SELECT doc_id, replace(regexp_replace(title, '[ \\t\\n\\r\\f\\x0B]+{W}[.]', '', 'g'), ' et', '') AS author
FROM t
"""

SQL["filtered_titles"] = f"""
WITH {TITLES}
SELECT doc_id, title FROM t
WHERE source NOT IN ('src1', 'src2', 'src13') AND NOT regexp_matches(title, 'the |Der |qu|[0-9]')
"""

SQL["reject_authors"] = f"""
WITH {TITLES}
SELECT source, CASE WHEN source IN ('src1', 'src2', 'src13') THEN 'group'
                    WHEN {NEEDLES} THEN 'author'
                    WHEN regexp_matches(title, 'the |Der |qu|[0-9]') THEN 'title'
                    ELSE 'kept' END AS reason, count(*) AS n_docs
FROM t GROUP BY ALL
"""

SQL["cleaned_text"] = r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s{2,}|\n+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM c
"""

SQL["cased_function_words"] = f"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(
                  replace(text, chr(697), chr(39)), '[\\p{{P}}$+<=>^`|~]', ' ', 'g'),
                  '[ \\t\\n\\r\\f\\x0B]+')) AS token FROM documents)
SELECT doc_id, token, count(*) AS n FROM w WHERE token IN ({FWORDS}) GROUP BY ALL
"""

SQL["tag_strings"] = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS words FROM documents)
SELECT doc_id, coalesce(array_to_string(list_transform(words[11:60], lambda w: {rule('w')}), ''), '') AS tags
FROM t
"""

SQL["complete_features"] = f"""
WITH {PROFILES}
SELECT author, token AS feature, n::BIGINT AS n FROM ac
WHERE token IN (SELECT token FROM ac GROUP BY token
                HAVING count(*) = (SELECT n_docs FROM na))
"""

SQL["family_features"] = f"""
SELECT * FROM ({SQL["sample_shares"]}) WHERE starts_with(feature, '$MFW$')
"""

SQL["family_change"] = f"""
WITH f AS (SELECT DISTINCT feature FROM ({SQL["sample_shares"]})),
  o AS (SELECT row_number() OVER (ORDER BY feature) - 1 AS i, split_part(feature, '$', 2) AS f,
               lag(split_part(feature, '$', 2)) OVER (ORDER BY feature) AS g FROM f)
SELECT coalesce(min(i) FILTER (f <> g), -1) AS change FROM o
"""

SQL["wide_features"] = f"""
WITH fw AS ({SQL["function_words"]}),
  names AS (SELECT unnest([{FWORDS}]) AS feature)
SELECT d.doc_id, names.feature, coalesce(fw.n, 0)::DOUBLE AS value
FROM (SELECT DISTINCT doc_id FROM fw) d CROSS JOIN names
LEFT JOIN fw ON fw.doc_id = d.doc_id AND fw.feature = names.feature
"""

SQL["status_subset"] = """
WITH h AS (SELECT doc_id, source AS author,
                  row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS rk,
                  count(*) OVER (PARTITION BY source) AS n FROM documents),
  i AS (SELECT doc_id, author, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r,
               count(*) OVER () AS m FROM h
        WHERE rk <= round_even(n * 0.9, 0) AND author <> (SELECT min(source) FROM documents))
SELECT doc_id, author FROM i WHERE r <= round_even(m * 0.5, 0)
"""

SQL["ood_pairs"] = f"""
WITH {UNIT_PAIRS},
  c AS (SELECT *, CASE WHEN left_label < 7 THEN left_label::VARCHAR ELSE '[OOD]' END AS l,
               CASE WHEN right_label < 7 THEN right_label::VARCHAR ELSE '[OOD]' END AS r FROM p)
SELECT l AS ComparedClass, left_id::VARCHAR AS ComparedLabel, r AS ComparatorClass,
       right_id::VARCHAR AS ComparatorLabel, distance AS Distance,
       CASE WHEN l = '[OOD]' OR r = '[OOD]' THEN NULL ELSE l = r END AS IsAPair
FROM c
"""

SQL["attribution_rate"] = f"""
WITH {FRAME} SELECT round(avg(Attribution::INT), 6) AS rate, count(*) AS n FROM f
"""

SQL["row_shuffle"] = """
SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS place FROM documents
"""
