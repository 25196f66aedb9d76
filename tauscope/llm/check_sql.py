"""Check SQL of the divergence audit and of the vector codes, for DuckDB."""

from __future__ import annotations

AUDIT = """
WITH named AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM named
), counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM named) g
  LEFT JOIN (SELECT c.* FROM counts c SEMI JOIN kept k ON c.lang = k.lang AND c.term = k.term) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), priced AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM priced WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS k FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, k::INTEGER AS rank FROM ranked WHERE part = 'pair' OR k <= 10
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignment and averaging written out round by round."""
    steps = [f"""
rows AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p::INTEGER AS p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM rows, range({parts}) t(p)
), book0 AS MATERIALIZED (SELECT p, (r - 1)::INTEGER AS e, x FROM parts WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min_by(e, d * {entries} + e) AS e, min(d) AS d, any_value(x) AS x
  FROM (SELECT a.r, a.p, b.e, a.x, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN book{k} b USING (p)) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS x FROM (
      SELECT p, e, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*))::HUGEINT // count(*) AS s
      FROM (SELECT p, e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (
  SELECT w.vec_id, w.label, n.code, n.error FROM rows w JOIN (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r) n ON n.r = w.r
), sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM book{rounds})) AS codebooks_sha256
FROM coded c JOIN sums s ON c.label IS NOT DISTINCT FROM s.label
"""


def _hash(*parts: str) -> str:
    """The 60-bit hash of joined parts that the operators take from md5."""
    text = " || '|' || ".join(f"coalesce(cast({p} AS varchar), 'null')" for p in parts)
    return f"cast('0x' || substr(md5({text}), 1, 15) AS bigint)"


#: The mix by its rule: every seat of a shard by its quotient, every block by its turn.
MIX = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, {_hash('text')} AS hash FROM documents
), lone AS (
  SELECT *, size * copies AS words, {_hash('17', 'doc_id', 'hash')} AS h FROM (SELECT doc_id, source, size, hash, count(*) AS copies FROM sized GROUP BY ALL)
), named AS (
  SELECT *, [3e0, 1e0, 2e0][(s - 1) % 3 + 1] AS w, 2e0 * source_size AS cap, 15e-1 * sum(source_size) OVER () AS whole
  FROM (SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS s FROM lone GROUP BY source)
), levels AS (
  SELECT *, (whole - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM named WINDOW o AS (ORDER BY cap / w, s)
), targets AS (
  SELECT source, source_size, s, CASE WHEN rate > cap / w THEN cap ELSE w * coalesce((SELECT arg_min(rate, cap / w) FROM levels WHERE NOT rate > cap / w), 0e0) END AS target FROM levels
), placed AS (
  SELECT l.*, t.s, t.source_size, t.target, (h // 64) % (SELECT greatest(1, ceil(sum(words) / 1048576e0), ceil(count(*) / 65536e0))::BIGINT FROM lone) AS shard
  FROM lone l JOIN targets t ON t.source IS NOT DISTINCT FROM l.source
), cells AS (
  SELECT shard, s, sum(words)::BIGINT AS line, round(any_value(target) * sum(words) / greatest(any_value(source_size), 1), 6) AS claim, CASE WHEN sum(words) < 1024 THEN 1 ELSE 64 END AS unit
  FROM placed GROUP BY shard, s HAVING sum(words) > 0
), seats AS (
  SELECT *, round(round((sum(claim) OVER (PARTITION BY shard, unit)) / unit, 6)) AS given FROM cells
), asked AS (SELECT shard, s, unit, given, unnest(generate_series(1, (2 * ceil(claim / unit) + 4)::BIGINT)) AS j, claim FROM seats),
won AS (
  SELECT shard, s, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY shard, unit ORDER BY claim / (2 * j - 1) DESC, s, j) AS k FROM asked WHERE claim > 0) WHERE k <= given GROUP BY ALL
), lines AS (
  SELECT c.shard, c.s, unit, n, least(coalesce(quota, 0), 2 * n) AS quota, CASE WHEN n % 7919 <> 0 THEN 7919 WHEN n % 104729 <> 0 THEN 104729 ELSE 1299709 END AS stride, {_hash('17', 'c.s', 'c.shard')} % n AS turn
  FROM (SELECT *, (line + unit - 1) // unit AS n FROM cells) c LEFT JOIN won ON won.shard = c.shard AND won.s = c.s
), laid AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY s, shard ORDER BY h, doc_id NULLS FIRST, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM placed
), copied AS (SELECT *, first + number * size AS a, first + (number + 1) * size AS z FROM (SELECT *, unnest(range(0, copies)) AS number FROM laid)),
parts AS (
  SELECT doc_id, hash, number, c.s, unit, a, z, quota, n, stride, turn, unnest(generate_series(a // unit, (z - 1) // unit)) AS k FROM copied c JOIN lines l ON l.s = c.s AND l.shard = c.shard WHERE size > 0
), taken AS (
  SELECT doc_id, hash, s, number, sum((least(z, (k + 1) * unit) - greatest(a, k * unit)) * (quota // n + CASE WHEN (k * stride + turn) % n < quota % n THEN 1 ELSE 0 END))::BIGINT AS taken FROM parts GROUP BY ALL
)
SELECT c.doc_id, size::BIGINT AS size, c.source, source_size, round(target, 6) AS target, coalesce(t.taken, 0) AS taken
FROM copied c LEFT JOIN taken t ON t.doc_id IS NOT DISTINCT FROM c.doc_id AND t.hash = c.hash AND t.s = c.s AND t.number = c.number
"""

#: Whole shingle sets, every pair that shares one, and what links reach.
NEAR_DUPLICATES = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
digests AS (SELECT doc_id, n, md5(string_agg(g, chr(10) ORDER BY g)) AS d FROM grams JOIN sizes USING (doc_id) GROUP BY ALL),
lone AS (SELECT min(doc_id) AS doc_id, d, any_value(n) AS n FROM digests GROUP BY d),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM (SELECT g.* FROM grams g SEMI JOIN lone USING (doc_id)) a JOIN (SELECT g.* FROM grams g SEMI JOIN lone USING (doc_id)) b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN lone x ON x.doc_id = a JOIN lone y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
roots AS (SELECT l.d, least(l.doc_id, coalesce(min(r.b), l.doc_id)) AS root FROM lone l LEFT JOIN reach r ON r.a = l.doc_id GROUP BY l.d, l.doc_id)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, w.doc_id) AS component_id, coalesce(r.root, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN digests d ON d.doc_id = w.doc_id LEFT JOIN roots r ON r.d = d.d
"""


def language_models(order: int = 5, strength: str = "5e0") -> str:
    """Byte n-grams as hexadecimal strings; both models level by level, in one case for all trusted texts and one without each fold."""
    n = 2 * order
    steps = [f"""
marked AS MATERIALIZED (
  SELECT row_number() OVER () AS r, d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN {_hash('d.doc_id')} % 2 + 1 ELSE 0 END AS fold, '{'0' * (n - 2)}' || hex(encode(coalesce(text, ''))) AS h
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id
), grams AS MATERIALIZED (
  SELECT r, fold, unnest(list_transform(range(0, (len(h) - {n - 2}) // 2), lambda i: substr(h, 2 * i + 1, {n}))) AS g FROM marked
), own AS MATERIALIZED (SELECT r, fold, g, count(*) AS times FROM grams GROUP BY ALL),
counts AS MATERIALIZED (
  SELECT c, g, sum(times)::DOUBLE AS b, coalesce(sum(times) FILTER (fold > 0 AND fold <> c), 0)::DOUBLE AS t FROM own, range(0, 3) cases(c) GROUP BY ALL
), ratios AS MATERIALIZED (SELECT c, sum(t) / sum(b) AS ratio FROM counts GROUP BY c),
p0 AS MATERIALIZED (SELECT c, '' AS g, 1 / 256e0 AS pt, 1 / 256e0 AS pb FROM ratios)"""]
    for k in range(1, order + 1):
        steps.append(f"""
level{k} AS MATERIALIZED (SELECT c, right(g, {2 * k}) AS g, sum(t) AS t, sum(b) AS b FROM counts GROUP BY ALL),
p{k} AS MATERIALIZED (
  SELECT l.c, l.g, (l.t + {strength} * p.pt) / (x.t + {strength}) AS pt, (l.b * ratio + {strength} * p.pb) / (x.b * ratio + {strength}) AS pb
  FROM level{k} l JOIN (SELECT c, left(g, {2 * k - 2}) AS head, sum(t) AS t, sum(b) AS b FROM level{k} GROUP BY ALL) x ON x.c || ':' || x.head = l.c || ':' || left(l.g, {2 * k - 2})
  JOIN p{k - 1} p ON p.c || ':' || p.g = l.c || ':' || right(l.g, {2 * k - 2}) JOIN ratios ON ratios.c = l.c
)""")
    return "WITH " + ",".join(steps) + f""",
scores AS (SELECT r, sum(times * (ln(pb) - ln(pt))) / sum(times) AS s FROM own JOIN p{order} p ON p.c || ':' || p.g = own.fold || ':' || own.g GROUP BY r)
SELECT doc_id, ((len(h) - {n - 2}) // 2)::BIGINT AS n_tokens, round(coalesce(s, 0e0), 6) + 0e0 AS ce_diff FROM marked LEFT JOIN scores USING (r)
"""


#: Distances of sign bits between every query and every vector.
CODE_SEARCH = """
WITH bits AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
far AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id, list_sum(list_transform(list_zip(q.b, v.b), lambda z: abs(z[1] - z[2])))::BIGINT AS distance
  FROM bits q, bits v WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM far) WHERE rank <= 10
"""
