"""DuckDB SQL of the registered queries that SQL can express."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
    2.0 * source_size AS bound, 1.5 * sum(source_size) OVER () AS wanted FROM s
), f AS (
  SELECT *, (wanted - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY bound / weight, source NULLS LAST) AS k FROM w
), g AS (
  SELECT source, source_size, CASE WHEN bound <= l * weight THEN bound ELSE l * weight END AS target
  FROM f, (SELECT coalesce(arg_min(level, k) FILTER (bound / weight > level), max(bound / weight)) AS l FROM f)
), h AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole FROM g
), n AS (
  SELECT *, greatest(round(target)::BIGINT - whole * source_size, 0) AS need FROM h
), t AS (
  SELECT d.doc_id, d.source, d.size, n.source_size, n.target, n.whole, n.need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, source, size, source_size, target, (whole * size + greatest(least(size, need - before), 0))::BIGINT AS taken FROM t
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(h, (1 + 5 * (k // 4))::BIGINT, 5))::BIGINT >> (5 * (3 - k % 4))::BIGINT) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM r
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

NEAR = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d
), e AS (
  SELECT doc_id, len(g)::BIGINT AS n, unnest(g) AS g FROM x
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
    AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, k.b FROM reach r JOIN both_ways k ON r.b = k.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM x JOIN c USING (doc_id)
"""


def _quality() -> str:
    from trawlspark.llm import quality

    words = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.COMMON_WORDS))
    left, steps, sizes = "t", [], []
    for name, pattern in quality.CLASSES:
        pattern = pattern.replace("'", "''")
        steps.append(f"regexp_replace({left}, '{pattern}', '', 'g') AS r_{name}")
        sizes.append(f"length({left}) - length(r_{name})")
        left = f"r_{name}"
    sizes.append(f"length({left})")
    chain, before = "", "d"
    for i, step in enumerate(steps):
        chain += f"e{i} AS (SELECT *, {step} FROM {before}),\n"
        before = f"e{i}"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), {chain}
c AS (
  SELECT row_id, doc_id, lang, len(w)::BIGINT AS n_words, [{', '.join(sizes)}] AS q, w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {before}
), g AS (
  SELECT row_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g
  FROM c WHERE len(w) >= 5
), rep AS (
  SELECT row_id, i FROM g QUALIFY count(*) OVER (PARTITION BY row_id, g) > 1
), cover AS (
  SELECT row_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM rep, range(5) AS r(k) GROUP BY row_id
), cls AS (
  SELECT row_id, lang, unnest(range(len(q))) AS bin, unnest(q)::BIGINT AS n FROM c
), word AS (
  SELECT row_id, lang, x AS bin, count(*)::BIGINT AS n FROM (
    SELECT row_id, lang, CASE WHEN (v = lower(v) OR v = upper(v[1]) || lower(v[2:])) AND lower(v) IN ({words}) THEN lower(v) ELSE '' END AS x
    FROM (SELECT row_id, lang, unnest(w) AS v FROM c)) GROUP BY ALL
), big AS (
  SELECT lang FROM c WHERE lang IS NOT NULL GROUP BY lang
  HAVING sum(n_words) > 0 AND sum(n_words) >= {quality.MIN_REFERENCE_SHARE} * (SELECT sum(n_words) FROM c WHERE lang IS NOT NULL)
), cref AS (
  SELECT lang, bin, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS s FROM cls WHERE lang IN (FROM big) GROUP BY lang, bin
), wref AS (
  SELECT lang, bin, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS s FROM word WHERE lang IN (FROM big) GROUP BY lang, bin
), cp AS (
  SELECT row_id, bin, n / greatest(sum(n) OVER (PARTITION BY row_id), 1) AS p FROM cls
), wp AS (
  SELECT row_id, bin, n / greatest(sum(n) OVER (PARTITION BY row_id), 1) AS p FROM word
), cd AS (
  SELECT row_id, min(js) AS class_distance FROM (
    SELECT a.row_id, r.lang, sqrt(greatest((1 + sum(CASE WHEN a.p > 0 THEN
      a.p * log2(a.p / ((a.p + r.s) / 2)) + CASE WHEN r.s > 0 THEN r.s * log2(r.s / ((a.p + r.s) / 2)) ELSE 0 END - r.s ELSE 0 END)) / 2, 0)) AS js
    FROM cp a JOIN cref r ON a.bin = r.bin GROUP BY a.row_id, r.lang) GROUP BY row_id
), wd AS (
  SELECT row_id, min(js) AS word_distance FROM (
    SELECT a.row_id, b.lang, sqrt(greatest((1 + sum(a.p * log2(a.p / ((a.p + coalesce(r.s, 0)) / 2))
      + CASE WHEN r.s > 0 THEN r.s * log2(r.s / ((a.p + r.s) / 2)) - r.s ELSE 0 END)) / 2, 0)) AS js
    FROM wp a CROSS JOIN big b LEFT JOIN wref r ON r.lang = b.lang AND r.bin = a.bin GROUP BY a.row_id, b.lang) GROUP BY row_id
), o AS (
  SELECT c.doc_id, c.n_words, list_sum(list_transform(c.w, lambda v: length(v)))::BIGINT AS chars, c.q,
    (len(c.lines) - len(list_distinct(c.lines)))::BIGINT AS n_dup_lines, coalesce(cover.n_repeat_words, 0) AS n_repeat_words,
    class_distance, word_distance
  FROM c LEFT JOIN cover USING (row_id) LEFT JOIN cd USING (row_id) LEFT JOIN wd USING (row_id)
), b AS (
  SELECT *, coalesce(chars, 0) AS word_chars, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o
)
SELECT doc_id, n_words, word_chars, q[{len(quality.CLASSES)}]::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((word_chars >= {quality.MIN_CLASS_CHARS} AND class_distance > {quality.MAX_CLASS_DISTANCE})
    OR (n_words >= {quality.MIN_COMMON_WORDS} AND word_distance > {quality.MAX_WORD_DISTANCE}), false) AS kept
FROM b
"""


#: crc32 table, and crc32 of a list of bytes b with the table tab.
CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(i))
)"""
CRC = "xor(list_reduce(list_prepend(4294967295, {b}), lambda c, k: xor(c >> 8, tab[1 + (xor(c, k) & 255)])), 4294967295)"

TRIE = f"""
WITH {CRC_TABLE}, t AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, {CRC.format(b="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9 AS h FROM t, crc
), r AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5
), m AS (
  SELECT conv_id, d, list_slice(turns, 1, d) AS p, d = len(turns) AS at_end
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)
), n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(p[d].text)) END AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
  FROM m GROUP BY p, d
), c AS (
  SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), a AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (p)
), s AS (
  SELECT list_slice(p, 1, k) AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM a) GROUP BY 1
)
SELECT a.conv_id, a.d AS depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
FROM a JOIN s USING (p) LEFT JOIN n u ON a.d > 0 AND u.d = a.d - 1 AND u.p = list_slice(a.p, 1, a.d - 1)
"""
VARIANTS = rf"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS raw FROM documents
), c AS (
  SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM d WHERE length(raw) >= 7 GROUP BY 1, 2
), b AS (
  SELECT run, c, hex(encode(id || ':' || run)) AS x FROM c
), h AS (
  SELECT run, c, {CRC.format(b="list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)")} AS h FROM b, crc
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2
), e AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w
), k AS (
  SELECT DISTINCT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS less FROM e
), p AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM k a JOIN k b ON a.hole = b.hole AND a.word <> b.word
), l AS (
  SELECT DISTINCT k.word, k.n, w.word AS other, w.n AS m FROM k JOIN w ON w.word = k.less
), q AS (
  SELECT * FROM p UNION ALL SELECT * FROM l UNION ALL SELECT other, m, word, n FROM l
), f AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM q GROUP BY word
), o AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM w LEFT JOIN f USING (word)
), r AS (
  SELECT word, word AS root, form AS next FROM o
  UNION ALL SELECT r.word, o.word, o.form FROM r JOIN o ON o.word = r.next
)
SELECT o.word, o.n, o.n_near, o.form, o.form_n, r.root FROM o JOIN r ON r.word = o.word AND r.next IS NULL
"""

ORACLES: dict[str, str] = {
    "op4_mix_sources": MIX,
    "op5_warc_chunks": WARC,
    "op6_quality_rules": _quality(),
    "op8_top_k_search": TOP_K,
    "op9_near_duplicates": NEAR,
    "op12_spelling_variants": VARIANTS,
    "op13_prefix_trie": TRIE,
}
