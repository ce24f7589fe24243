"""DuckDB SQL of the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

EXACT = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM norm
WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id NULLS LAST)
"""

_SPANS = r"""
  SELECT doc_id, {place} AS place, '{kind}' AS kind, text,
         regexp_extract_all(text, '{pattern}') AS found,
         regexp_extract_all(text, '{pattern}', {group}) AS part,
         string_split_regex(text, '{bare}') AS gaps
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
  WHERE regexp_matches(text, '{pattern}')"""

_KEY = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
        "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
_TAIL = r"""["'']?\x20*[:=]\x20*["'']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"

SECRETS = "WITH matched AS (" + "\n  UNION ALL".join([
    _SPANS.format(place=0, kind="assign", group=2, pattern=f"({_KEY}){_TAIL}({_VALUE})",
                  bare=f"(?:{_KEY}){_TAIL}{_VALUE}"),
    _SPANS.format(place=1, kind="access", group=0, pattern="AKIA[A-Z0-9]+", bare="AKIA[A-Z0-9]+"),
    _SPANS.format(place=2, kind="hex", group=0, pattern="[0-9a-f]{32,}", bare="[0-9a-f]{32,}"),
]) + r"""),
placed AS (
  SELECT doc_id, place, kind, i, found[i] AS hit, part[i] AS checked,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
  FROM matched, unnest(generate_series(1, len(found))) AS u(i)),
spans AS (
  SELECT doc_id, place, kind, CAST(start AS BIGINT) AS start,
         CAST(start + length(hit) AS BIGINT) AS stop
  FROM placed
  WHERE length(checked) >= CASE place WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
listed AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS b,
         count(*) FILTER (place = 2) AS c,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""

MIXTURE = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST(('0x' || left(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':'
              || coalesce(text, '')), 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
-- For every source taken as the first that is not full: the level of the rest.
tried AS (
  SELECT a.source, a.cap, a.weight,
         (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM sources)
           - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0) AS left_over,
         (SELECT sum(weight) FROM sources)
           - coalesce(sum(b.weight) FILTER (b.cap / b.weight < a.cap / a.weight), 0) AS weights
  FROM sources a, sources b GROUP BY a.source, a.cap, a.weight),
level AS (
  SELECT arg_min(left_over / weights, cap / weight) AS level
  FROM tried WHERE cap >= left_over / weights * weight),
targets AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target
  FROM sources, level)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT)
         AS taken
FROM (SELECT s.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""

HOSTS = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
label AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1
                          WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
by_host AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         CASE WHEN regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$')
              THEN regexp_extract(host, '([^.]*\.[^.]*)$', 1)
              ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix
  FROM parts LEFT JOIN label ON page_id = doc_id GROUP BY host),
hosts AS (
  SELECT *, CASE WHEN label = '' THEN host ELSE label || '.' || suffix END AS domain
  FROM (SELECT *, regexp_extract(left(host, greatest(length(host) - length(suffix) - 1, 0)),
                                 '([^.]*)$', 1) AS label FROM by_host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
levels AS (
  SELECT 'host' AS level, n, bad FROM hosts WHERE n > 0
  UNION ALL SELECT 'domain', n, bad FROM domains WHERE n > 0
  UNION ALL SELECT 'suffix', n, bad FROM suffixes WHERE n > 0),
sums AS (
  SELECT level, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad,
         sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS bb
  FROM levels GROUP BY level),
squares AS (
  SELECT level, k, n, (bb - bad * bad / n) / nullif(k - 1, 0) AS between_sq,
         (bad - bb) / nullif(n - k, 0) AS within_sq, (n - nn / n) / nullif(k - 1, 0) AS size
  FROM sums),
strength AS (
  SELECT level, CASE WHEN k < 2 OR n <= k THEN 1000.0
                     WHEN between_sq - within_sq <= 0 THEN 1000.0
                     ELSE least(1000.0, greatest(1.0,
                       (between_sq + (size - 1) * within_sq) / (between_sq - within_sq) - 1)) END
         ::DOUBLE AS m
  FROM squares),
m AS (
  SELECT coalesce(max(m) FILTER (level = 'host'), 1000) AS mh,
         coalesce(max(m) FILTER (level = 'domain'), 1000) AS md,
         coalesce(max(m) FILTER (level = 'suffix'), 1000) AS ms,
         (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0), 0) FROM suffixes) AS overall
  FROM strength),
rated AS (
  SELECT h.host, h.n, mh, overall,
         (h.bad + mh * (d.bad + md * (s.bad + ms * overall) / (s.n + ms)) / (d.n + md))
           / (h.n + mh) AS rate
  FROM hosts h JOIN domains d USING (domain, suffix) JOIN suffixes s USING (suffix), m),
rules(verdict, rule) AS (
  VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'),
         ('allow', 'org/fr/')),
fitting AS (
  SELECT p.host, p.path, arg_max(rule, length(rule)) AS rule,
         arg_max(r.verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
    ON (p.host = split_part(rule, '/', 1) OR ends_with(p.host, '.' || split_part(rule, '/', 1)))
       AND starts_with(p.path, substr(rule, instr(rule, '/')))
  GROUP BY p.host, p.path)
SELECT page_id, p.host, p.path, rule,
       coalesce(verdict, CASE WHEN greatest(0, rate - 0.253 * sqrt(rate * (1 - rate)
                                   / (n + mh + 1))) > overall THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN rated USING (host) LEFT JOIN fitting f
  ON p.host = f.host AND p.path = f.path
"""

QUALITY = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
held AS (
  SELECT *, list_transform(lines, lambda x: lower(array_to_string(
              regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' '))) AS plain
  FROM base),
grams AS (
  SELECT rid, i, words[i] || chr(31) || words[i + 1] || chr(31) || words[i + 2] AS gram
  FROM base, unnest(generate_series(1, len(words) - 2)) AS u(i)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams)
  WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT i + d) AS n_repeat_words
  FROM twice, unnest([0, 1, 2]) AS u(d) GROUP BY rid),
contents AS (SELECT DISTINCT source, plain FROM held),
lined AS (
  SELECT source, line, count(*) AS n_docs
  FROM (SELECT source, unnest(list_distinct(plain)) AS line FROM contents) GROUP BY ALL),
frequent AS (
  SELECT source, line FROM lined WHERE n_docs > 5),
removed AS (
  SELECT o.rid, sum(len(string_split(o.line, ' '))) AS removed_words
  FROM (SELECT rid, source, unnest(plain) AS line FROM held) o JOIN frequent f
    ON o.line = f.line AND o.source IS NOT DISTINCT FROM f.source
  GROUP BY o.rid),
figures AS (
  SELECT rid, doc_id, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM held LEFT JOIN covered USING (rid) LEFT JOIN removed USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 100 * removed_words <= 25 * n_words AND n_words - removed_words >= 50 AS kept
FROM figures
"""

AUDIT = r"""
WITH told AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels GROUP BY doc_id),
masks AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))
                      > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN first_id IS NOT NULL AND (t.doc_id IS NULL OR t.doc_id > first_id)
                 THEN 'E' ELSE '' END AS failed
  FROM told t LEFT JOIN marks m ON t.doc_id = m.doc_id),
cells AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM masks GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter,
         left(filter_order, step - 1) AS earlier
  FROM orders, unnest(generate_series(1, 5)) AS u(step)),
met AS (
  SELECT part, filter_order, step, letter, failed, n, good, toxic,
         contains(failed, letter) AS fails,
         length(translate(earlier, failed, '')) < length(earlier) AS gone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND length(failed) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""

RUNS = r"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         -- CRC-32, bit by bit: a byte is xor-ed in, then follow eight shifts.
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
               string_split(CAST(doc_id AS VARCHAR), ''),
               lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
                               WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT)
                               ELSE c >> 1 END), 4294967295::BIGINT) AS h
  FROM documents),
part AS (
  SELECT rid, doc_id, words, h % 10 = 0 AND len(words) > 0 AS chosen, h // 10 AS g,
         len(words) AS n,
         CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a
  FROM raw),
planted AS (
  SELECT rid, doc_id, n,
         CASE WHEN chosen THEN list_transform(generate_series(0, n - 1), lambda i:
                CASE WHEN i >= a THEN words[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1]
                     ELSE words[i + 1] END) ELSE words END AS words
  FROM part),
tok AS (
  SELECT rid, n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM planted),
same AS (
  SELECT x.rid, x.i, y.i - x.i AS q
  FROM tok x JOIN tok y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT rid, q, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island, i FROM same),
repetitive AS (
  SELECT rid, q, min(i) AS s, count(*) + q AS len FROM stretches GROUP BY rid, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM repetitive r WHERE NOT EXISTS (
    SELECT 1 FROM repetitive o
    WHERE o.rid = r.rid AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)),
listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), ''
         ORDER BY s, q) AS lines,
         arg_min({'s': s, 'len': len, 'q': q}, (-len, s, q)) AS most
  FROM runs GROUP BY rid),
dropped AS (
  SELECT DISTINCT r.rid, t.i FROM runs r JOIN tok t
    ON t.rid = r.rid AND t.i >= r.s + r.q AND t.i < r.s + r.len),
collapsed AS (
  SELECT t.rid, string_agg(w, ' ' ORDER BY t.i) AS kept
  FROM tok t ANTI JOIN dropped d ON t.rid = d.rid AND t.i = d.i GROUP BY t.rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, most.s::BIGINT AS start,
       most.len::BIGINT AS length, most.q::BIGINT AS period,
       (1000 * most.len // most.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (rid) LEFT JOIN collapsed USING (rid)
"""

SQL = {"op2_exact_dedup": EXACT, "op4_secrets": SECRETS, "op6_mixture": MIXTURE,
       "op8_hosts": HOSTS, "op9_quality": QUALITY,
       "op11_filter_audit": AUDIT, "op12_runs": RUNS}
