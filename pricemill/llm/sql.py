"""SQL (DuckDB) for the operators that SQL can express."""

from pricemill.llm import hostrules, jumphash, urlcascade

TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         max(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
  GROUP BY 1, 2
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM r WHERE rank <= 5
"""


def host_rules(limit=0.5, deviations=2.0):
    """Counts by word lists; host rates with the beta prior of ``hostrules.beta_prior``."""
    rules = hostrules.RULES
    sums = ", ".join(f"sum(CAST({r} AS INT)) AS {r}" for r in rules)
    moments = ", ".join(
        f"sum({r}) / sum(n) AS {r}_p, avg({r} / n) AS {r}_m, coalesce(var_samp({r} / n), 0) AS {r}_v"
        for r in rules
    )
    weights = ", ".join(
        f"CASE WHEN hosts < 2 OR {r}_p <= 0 OR {r}_p >= 1 THEN 1 ELSE greatest("
        f"{r}_m * (1 - {r}_m) / greatest(least(greatest({r}_v - {r}_p * (1 - {r}_p) * inv, 0),"
        f" {r}_m * (1 - {r}_m) * 0.999), {r}_m * (1 - {r}_m) * 1e-6) - 1, 1e-3) END AS {r}_w,"
        f" CASE WHEN hosts < 2 OR {r}_p <= 0 OR {r}_p >= 1 THEN {r}_p ELSE {r}_m END AS {r}_c"
        for r in rules
    )
    rates = ", ".join(f"({r} + {r}_c * {r}_w) / (n + {r}_w) AS {r}_r, n + {r}_w AS {r}_n"
                      for r in rules)
    rejected = " OR ".join(
        f"{r}_r - {deviations} * sqrt(greatest({r}_r * (1 - {r}_r), 0) / ({r}_n + 1)) > {limit}"
        for r in rules
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents
),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
grams AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
repeats AS (
  SELECT row_id, i FROM grams
  QUALIFY count(*) OVER (PARTITION BY row_id, gram) > 1
),
covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM repeats, (VALUES (0), (1), (2)) AS o(k) GROUP BY 1
),
c AS (
  SELECT doc_id, source, len(words) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^{hostrules.SYMBOLS}]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN covered USING (row_id)
),
f AS (
  SELECT *, n_words < {hostrules.MIN_WORDS} AS short,
         100 * n_repeat_words > {hostrules.MAX_REPEATED_PERCENT} * n_words AS repeated,
         10 * n_symbols > n_words AS symbols, 2 * n_dup_lines > n_lines AS dup_lines
  FROM c
),
h AS (SELECT source, count(*) AS n, {sums} FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT count(*) AS hosts, avg(1.0 / n) AS inv, {moments} FROM h),
p AS (SELECT *, {weights} FROM m),
q AS (SELECT h.source, {rates} FROM h, p),
v AS (SELECT source, {rejected} AS host_rejected FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       short OR repeated AS base_failed, coalesce(host_rejected, false) AS host_rejected,
       NOT (short OR repeated) AND NOT coalesce(host_rejected, false) AS kept
FROM f LEFT JOIN v USING (source)
"""


def jump_hash(shards=8):
    """At most as many jumps as shards; keys are unsigned 64-bit numbers in HUGEINT."""
    two64 = "CAST(18446744073709551616 AS HUGEINT)"
    steps = [
        f"""j0 AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         (CAST(coalesce(doc_id, 0) AS HUGEINT) + {two64}) % {two64} AS key,
         octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS text,
         CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS a_next,
         CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS b_next
  FROM documents
)"""
    ]
    for k in range(1, shards + 2):
        new_key = f"((key * {jumphash.MULTIPLIER} + 1) % {two64})"
        jump = f"CAST(floor(({{0}} + 1) * (2147483648.0::DOUBLE / CAST({new_key} // 8589934592 + 1 AS DOUBLE))) AS BIGINT)"
        steps.append(
            f"""j{k} AS (
  SELECT row_id, doc_id, size, text, {new_key} AS key,
         CASE WHEN a_next < {shards} THEN a_next ELSE a END AS a,
         CASE WHEN a_next < {shards} THEN {jump.format('a_next')} ELSE a_next END AS a_next,
         CASE WHEN b_next < {shards + 1} THEN b_next ELSE b END AS b,
         CASE WHEN b_next < {shards + 1} THEN {jump.format('b_next')} ELSE b_next END AS b_next
  FROM j{k - 1}
)"""
        )
    # CRC-32 bit by bit would dwarf the rest, so it is a table of 256 steps over the bytes
    return f"""
WITH RECURSIVE bits AS (
  SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
  FROM bits WHERE k < 8
),
steps AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
{", ".join(steps)},
crc AS (
  SELECT row_id,
         xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(regexp_extract_all(hex(encode(text)), '..'),
                            lambda x: CAST('0x' || x AS BIGINT))),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])
         ), 4294967295) AS text_crc32
  FROM j{shards + 1}, steps
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32,
       'key' AS law, CAST(a AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY a ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(b AS INTEGER) AS grown_shard
FROM j{shards + 1} JOIN crc USING (row_id)
"""


def url_filter(rules=urlcascade.RULES, terms=urlcascade.BLOCKED_TERMS):
    """Rules as a case expression; a host is listed by its parts."""
    rule = verdict = ""
    for decision, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{path}')"
        rule += f" WHEN {fits} THEN '{host}{path}'"
        verdict += f" WHEN {fits} THEN '{decision}'"
    listed = ", ".join(f"'{t}'" for t in terms)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3)
                       ELSE '' END AS rest
  FROM pages
),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
)
SELECT page_id, host, path, CASE{rule} END AS rule,
       CASE{verdict} WHEN len(list_intersect(regexp_split_to_array(host, '[.-]'), [{listed}])) > 0
            THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""


# Runs of bytes from \x0A to \x0D and the marks end a piece; positions give all phrases of a piece
COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
  FROM places, (VALUES (1), (2), (3), (4)) AS s(k) WHERE i + k - 1 <= len(w)
  GROUP BY ALL HAVING f >= 30
),
total AS (SELECT lang, count(*) AS n FROM places GROUP BY 1),
c AS (SELECT lang, f, g, string_split(g, ' ') AS w FROM g WHERE k >= 2),
inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS g, max(f) AS longest
  FROM (SELECT lang, w, f, unnest(range(1, len(w) + 1)) AS i FROM c), (VALUES (2), (3)) AS s(k)
  WHERE i + k - 1 <= len(w) AND k < len(w) GROUP BY 1, 2
),
halves AS MATERIALIZED (
  SELECT lang, g, f AS a, k, array_to_string(w[1:k], ' ') AS lg, array_to_string(w[k + 1:], ' ') AS rg
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c)
),
cuts AS (
  SELECT h.lang, h.g, h.a, h.k, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * h.a) // (l.f + r.f) AS score
  FROM halves AS h JOIN g AS l ON l.lang = h.lang AND l.g = lg JOIN g AS r ON r.lang = h.lang AND r.g = rg
),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
),
kept AS (
  SELECT lang, g AS phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM best LEFT JOIN inside USING (lang, g)
  WHERE longest IS NULL OR 100 * longest < 80 * a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank,
       phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""


def centroids(clusters=8, rounds=10):
    """Lloyd's rounds unrolled: assign to the nearest centroid, then floor the means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (
  SELECT v.row_id, arg_min(c, (distance, c)) AS c, min(distance) AS distance
  FROM (
    SELECT v.row_id, k.c, list_sum(list_transform(list_zip(v.e, k.e),
           lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
    FROM v, c{i} AS k
  ) AS v GROUP BY 1
)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.e, k.e) AS e
  FROM c{i} AS k LEFT JOIN (
    SELECT c, list(x ORDER BY j) AS e FROM (
      SELECT c, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
      FROM (SELECT d.c, unnest(v.e) AS x, unnest(range(1, 65)) AS j FROM v JOIN d{i} AS d USING (row_id))
      GROUP BY c, j) GROUP BY c
  ) AS m USING (c)
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, e
  FROM v ORDER BY c LIMIT {clusters}
),{",".join(steps)}
SELECT vec_id, c AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.e, ',')) AS centroid_sha256
FROM d{rounds} JOIN v USING (row_id) JOIN c{rounds} AS k USING (c)
"""


# Base32: each five hexadecimal digits are four letters
WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS row_id FROM pages
),
d AS (
  SELECT page_id, row_id, html, strlen(html) AS payload_bytes, sha1(html) AS h FROM p
),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
             (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT)
              >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest
  FROM d
),
m AS (
  SELECT html, max(page_id) AS original, arg_max(row_id, page_id) AS first_row FROM b GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN row_id = first_row THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN row_id <> first_row THEN original END AS refers_to, 
       CASE WHEN row_id = first_row THEN true END AS intact
FROM b JOIN m USING (html)
"""
