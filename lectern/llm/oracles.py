"""DuckDB SQL for the operators that SQL can express; tables are views named as their files."""

from __future__ import annotations

from lectern.llm import centroids, shards

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = r"""WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
 w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM l),
 g AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER x AS k, count(*) OVER x AS n FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
 f AS (SELECT k, min(doc_id) AS first FROM g WHERE n = 13 GROUP BY k),
 m AS (SELECT g.doc_id, pos, word, coalesce(first < g.doc_id, false) AS mark FROM g LEFT JOIN f ON g.n = 13 AND g.k = f.k),
 c AS (SELECT doc_id, pos, word, bool_or(mark) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m)
 SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
 FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id"""

OP2 = """WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
 b AS (SELECT doc_id, unnest(h) AS byte, generate_subscripts(h, 1) AS pos FROM h),
 g AS (SELECT doc_id, pos, byte, string_agg(byte, '') OVER x AS k, count(*) OVER x AS n FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
 f AS (SELECT k, min(doc_id) AS first FROM g WHERE n = 50 GROUP BY k),
 m AS (SELECT g.doc_id, pos, byte, coalesce(first < g.doc_id, false) AS mark FROM g LEFT JOIN f ON g.n = 50 AND g.k = f.k),
 c AS (SELECT doc_id, pos, byte, bool_or(mark) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
 s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM c)
 SELECT d.doc_id, count(byte) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
 sha256(unhex(coalesce(string_agg(byte, '' ORDER BY pos) FILTER (WHERE NOT gone), ''))) AS kept_sha256
 FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""

OP5 = rf"""WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS l FROM documents),
 w AS (SELECT doc_id, len(l) AS words, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM l),
 g AS (SELECT doc_id, words, string_agg(word, ' ') OVER x AS k, count(*) OVER x AS n, pos FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
 s AS (SELECT DISTINCT doc_id, k FROM g WHERE n = 5 OR (words < 5 AND pos = 1)),
 c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT i.a, i.b FROM i JOIN c x ON i.a = x.doc_id JOIN c y ON i.b = y.doc_id WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
 SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.least AS component_id FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id JOIN m ON d.doc_id = m.a"""

OP7 = rf"""WITH l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
 q AS (SELECT item_id, l, unnest(range(1, greatest(len(l) - 8, 2))) AS i FROM b WHERE len(l) > 0),
 x AS (SELECT DISTINCT item_id, l[i : i + 9] AS k FROM q),
 w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM l),
 g AS (SELECT doc_id, pos, list(word) OVER y AS k FROM w WINDOW y AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
 o AS (SELECT g.doc_id, g.pos, x.item_id, len(x.k) AS n FROM g JOIN x ON len(x.k) = 10 AND g.k = x.k
  UNION ALL SELECT g.doc_id, g.pos, x.item_id, len(x.k) FROM g JOIN x ON len(x.k) < 10 AND g.k[1] = x.k[1] AND g.k[1 : len(x.k)] = x.k),
 t AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM o) GROUP BY doc_id),
 u AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
 SELECT l.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM l LEFT JOIN t ON l.doc_id = t.doc_id LEFT JOIN u ON l.doc_id = u.doc_id"""

#: The checksum by a table that a recursion fills; then the rounds of the permutation, begun anew while the place is not below n.
OP11 = f"""WITH RECURSIVE g AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
 t AS (SELECT list(c ORDER BY i) AS t FROM g WHERE k = 8),
 h AS (SELECT doc_id, coalesce(text, '') AS text, [4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
 d AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM h, t),
 o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, crc, size) - 1 AS row FROM d),
 n AS (SELECT count(*) AS n, greatest(1, (length(ltrim(bin(greatest(count(*), 2) - 1), '0')) + 1) // 2)::INTEGER AS bits, {shards.round_keys(shards.SEED)} AS keys FROM d),
 s AS (SELECT row, (row >> bits)::HUGEINT AS l, (row & ((1::BIGINT << bits) - 1))::HUGEINT AS r, 0 AS k, n, bits, keys FROM o, n
  UNION ALL SELECT row, r AS l, xor(l, (xor(y, y >> 32) * {shards.MIX[1]}::HUGEINT % {1 << 64}::HUGEINT) >> (64 - bits)) AS r, k % {shards.ROUNDS} + 1 AS k, n, bits, keys
  FROM (SELECT *, (r + keys[k % {shards.ROUNDS} + 1]) * {shards.MIX[0]}::HUGEINT % {1 << 64}::HUGEINT AS y FROM s WHERE k < {shards.ROUNDS} OR l * (1::HUGEINT << bits) + r >= n)),
 p AS (SELECT row, (l * (1::HUGEINT << bits) + r)::BIGINT AS place FROM s WHERE k = {shards.ROUNDS} AND l * (1::HUGEINT << bits) + r < n)
 SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (place % {shards.SHARDS})::INTEGER AS shard, place // {shards.SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM o JOIN p USING (row)"""

OP12 = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 q AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * list_unique(w) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
  regexp_matches(text, '[#$%&*|]'), w.doc_id > min(w.doc_id) OVER (PARTITION BY text)] AS f FROM w LEFT JOIN q USING (doc_id)),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
 o AS (SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
 s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
 u AS (SELECT part, good, toxic, f, count(*) AS n FROM m GROUP BY ALL),
 c AS (SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS l, n, good, toxic, f[ascii(o[step]) - 64] AS fails, len(list_filter(o[1:step - 1], lambda x: f[ascii(x) - 64])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS fs FROM u, s),
 r AS (SELECT part, filter_order, step, l, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails AND fs = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost FROM c GROUP BY ALL)
 SELECT * EXCLUDE (l), sum(removed) OVER (PARTITION BY part, l)::BIGINT AS shapley FROM r"""


def _rounds() -> str:
    """All rounds of the clustering, one after the other; the last assignment is a{centroids.ROUNDS}."""
    out = []
    for k in range(centroids.ROUNDS + 1):
        out.append(f"""a{k} AS (SELECT rid, id, v, c.k AS cluster, list_sum(list_transform(list_zip(v, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance
 FROM e, c{k} c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c.k) = 1)""")
        if k < centroids.ROUNDS:
            out.append(f"""m{k} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
 FROM (SELECT cluster, unnest(v) AS x, unnest(range({centroids.COMPONENTS})) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster), c{k + 1} AS (SELECT k, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON cluster = k)""")
    return ",\n ".join(out)


OP13 = f"""WITH e AS (SELECT row_number() OVER () AS rid, vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: floor({centroids.SCALE} * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {centroids.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.COMPONENTS}),
 c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{centroids.SEED}:' || coalesce(id::VARCHAR, '')) AS h, v FROM e ORDER BY h, v LIMIT {centroids.CENTROIDS})),
 {_rounds()}
 SELECT id AS vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
 FROM a{centroids.ROUNDS} a JOIN c{centroids.ROUNDS} c ON c.k = a.cluster"""

SQL = {"op1_substrings": OP1, "op2_suffixes": OP2, "op5_jaccard": OP5, "op7_decontaminate": OP7, "op11_shards": OP11, "op12_audit": OP12, "op13_centroids": OP13}
