"""DuckDB SQL that gives the rows of the operators' queries."""


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32, by its rule."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def crc32(text: str) -> str:
    """SQL text for the CRC-32 of the UTF-8 bytes of an expression."""
    hexed = f"hex(encode({text}))"
    byte = f"list_transform(range(0, length({hexed}) // 2), lambda b: ('0x' || substr({hexed}, 2 * b + 1, 2))::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), {step}), 4294967295::BIGINT)"


LANGUAGE_ID = f"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS r, {crc32("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 AS held_out,
                  string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g'), ' ') || ' ', '') AS c
           FROM documents),
p AS (SELECT r, lang, held_out, unnest(range(1, len(c) + 1)) AS i, c FROM d WHERE len(c) > 2),
g AS (SELECT r, lang, held_out, unnest(CASE WHEN i + 1 > len(c) THEN [NULL]
                 WHEN i + 2 > len(c) THEN [c[i], c[i] || c[i + 1]]
                 WHEN c[i] = ' ' THEN [c[i] || c[i + 1], c[i] || c[i + 1] || c[i + 2]]
                 WHEN c[i + 1] = ' ' THEN [c[i], c[i] || c[i + 1]]
                 ELSE [c[i], c[i] || c[i + 1], c[i] || c[i + 1] || c[i + 2]] END) AS gram FROM p),
n AS (SELECT r, lang, held_out, gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY ALL),
own AS (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS rank FROM n QUALIFY rank < 300),
lists AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank
          FROM n WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank < 300),
sizes AS (SELECT r, count(*) AS m FROM own GROUP BY r),
langs AS (SELECT DISTINCT lang FROM lists),
near AS (SELECT s.r, l.lang, s.m, s.m * 300 - coalesce(sum(300 - abs(o.rank - x.rank)), 0) AS distance
         FROM sizes s CROSS JOIN langs l LEFT JOIN own o ON o.r = s.r LEFT JOIN lists x ON x.lang = l.lang AND x.gram = o.gram
         GROUP BY s.r, l.lang, s.m),
best AS (SELECT r, lang, 1.0::DOUBLE - distance::DOUBLE / (300 * m)::DOUBLE AS score FROM near
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, lang) = 1)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(b.score, 0) AS score
FROM d LEFT JOIN best b ON b.r = d.r
"""

MIXTURE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, sum(words) OVER () AS total, coalesce(sum(3 * words) OVER u, 0) AS used,
             sum(weight) OVER () - coalesce(sum(weight) OVER u, 0) AS rest, row_number() OVER (ORDER BY 3 * words / weight, k) AS place
      FROM w WINDOW u AS (ORDER BY 3 * words / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT coalesce(min(place), 1000000000) AS place FROM o WHERE (total - used) * weight <= 3 * words * rest),
level AS (SELECT (total - used)::DOUBLE / rest::DOUBLE AS level FROM o WHERE place = (SELECT place FROM stop)),
t AS (SELECT source, k, words, total, CASE WHEN place < (SELECT place FROM stop) THEN (3 * words)::DOUBLE ELSE (SELECT level FROM level) * weight END AS target FROM o),
u AS (SELECT *, floor(target * 1024)::HUGEINT AS units FROM t),
b AS (SELECT *, coalesce(sum(units) OVER (ORDER BY k) * 2147483648 // nullif(sum(units) OVER (), 0), 0) AS till FROM u),
c AS (SELECT *, coalesce(lag(till) OVER (ORDER BY k), 0) AS since FROM b),
slot AS (SELECT ((i % 2147483648) * 1327217885) % 2147483648 AS point FROM range((SELECT ((sum(words) + 31) // 32)::BIGINT FROM s)) AS r(i)),
n AS (SELECT c.k, count(*) AS n FROM slot JOIN c ON point >= since AND point < till GROUP BY c.k),
g AS (SELECT t.*, least(coalesce(n.n, 0) * 32, 3 * words) AS taken FROM t LEFT JOIN n ON n.k = t.k),
p AS (SELECT d.doc_id, d.size, g.words, g.target, g.taken,
             coalesce(sum(d.size) OVER (PARTITION BY g.k ORDER BY md5(concat_ws(':', d.doc_id, d.size)), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, words AS source_size, target,
       CASE WHEN size > 0 THEN (taken // words) * size + least(greatest(taken % words - start, 0), size) ELSE 0 END::BIGINT AS taken
FROM p
"""

SHARDS = f"""
WITH RECURSIVE d AS (SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, {crc32("coalesce(text, '')")} AS text_crc32, md5(coalesce(text, '')) AS digest FROM documents),
g AS (SELECT digest, sum(size)::BIGINT AS bytes FROM d GROUP BY digest),
i AS (SELECT CASE WHEN bytes * 4096 >= (SELECT sum(bytes) FROM g) THEN digest ELSE substr(digest, 1, 3) END AS item, digest, bytes FROM g),
o AS (SELECT item, bytes, row_number() OVER (ORDER BY bytes DESC, item) AS place FROM (SELECT item, sum(bytes)::BIGINT AS bytes FROM i GROUP BY item)),
l AS (SELECT 0::BIGINT AS place, NULL::VARCHAR AS item, 0::BIGINT AS shard, list_transform(range(16), lambda x: 0::BIGINT) AS load
      UNION ALL
      SELECT o.place, o.item, list_position(l.load, list_min(l.load)) - 1,
             list_transform(l.load, lambda x, n: CASE WHEN n = list_position(l.load, list_min(l.load)) THEN x + o.bytes ELSE x END)
      FROM l JOIN o ON o.place = l.place + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, text_crc32)), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM d JOIN i USING (digest) JOIN l ON l.item = i.item
"""


def licenses() -> str:
    """The license rules and base phrases over spaced words."""
    from .licenses import BASE, SEPARATORS, rules
    values = ", ".join(f"({place}, '{label}', '{keyword}', {certainty}::DOUBLE, '{pattern}')" for place, label, keyword, certainty, pattern in rules())
    phrases = ", ".join(f"('{phrase}', '{label}', ' {phrase.replace(' ', '  ')} ')" for phrase, label in BASE)
    return f"""
WITH r(place, label, keyword, score, regex) AS (VALUES {values}),
b(phrase, label, spaced_phrase) AS (VALUES {phrases}),
d AS (SELECT doc_id, row_number() OVER () AS n, len(regexp_extract_all(lower(coalesce(text, '')), '{SEPARATORS.replace('[', '[^', 1)}'))::BIGINT AS n_words,
             ' ' || replace(trim(regexp_replace(lower(coalesce(text, '')), '{SEPARATORS}', ' ', 'g'), ' '), ' ', '  ') || ' ' AS t FROM documents),
h AS (SELECT n, place, label, score, regexp_extract_all(t, regex) AS hits, string_split_regex(t, regex) AS rest FROM d JOIN r ON list_bool_or(list_transform(string_split(keyword, '|'), lambda k: contains(t, k))) AND regexp_matches(t, regex)),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM h),
f AS (SELECT n, place, label, score, list_sum(list_transform(rest[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS since, length(hits[k]) AS size FROM e),
s AS (SELECT * FROM f QUALIFY since + size > coalesce(max(since + size) OVER (PARTITION BY n ORDER BY since, size DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
p AS (SELECT d.n, b.label, string_split(t, spaced_phrase) AS rest, len(string_split(phrase, ' ')) AS words, n_words FROM d JOIN b ON contains(t, spaced_phrase)),
q AS (SELECT n, sum(len(rest) - 1)::BIGINT AS n_base, min((length(rest[1]) - length(replace(rest[1], ' ', ''))) // 2) AS first_word,
             max(n_words - (length(rest[-1]) - length(replace(rest[-1], ' ', ''))) // 2 - words) AS last_word, list(label) AS labels FROM p GROUP BY n),
m AS (SELECT n, list(label) AS labels, max(score) AS score FROM s GROUP BY n)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(q.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(q.labels, []), coalesce(m.labels, [])))), ','), '') AS labels, coalesce(m.score, 0)::DOUBLE AS score
FROM d LEFT JOIN q ON q.n = d.n LEFT JOIN m ON m.n = d.n
"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

#: The graphical model has no SQL form.
MAIN_TEXT = None


LEXICAL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM n),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
a AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, docs),
s AS (SELECT a.q, a.item_id, n.doc_id, n.r, sum(a.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * n.n * g.docs) // g.words))))::BIGINT AS score
      FROM a JOIN f USING (term) JOIN p USING (term) JOIN n USING (r), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
o AS (SELECT lang, 1 AS k, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i])) AS p FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) FROM w),
f AS (SELECT lang, k, p, count(*)::BIGINT AS n FROM o GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
s AS (SELECT c.lang, c.p, c.k, c.n AS a, cut, x.n AS l, y.n AS r, ((1000000 * c.n::HUGEINT * c.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
      FROM c, (VALUES (1), (2)) v(cut), f x, f y
      WHERE cut < c.k AND x.lang = c.lang AND x.p = c.p[:cut] AND y.lang = c.lang AND y.p = c.p[cut + 1:]
      QUALIFY row_number() OVER (PARTITION BY c.lang, c.p ORDER BY score, cut) = 1),
m AS (SELECT lang, p, max(n) AS most FROM (SELECT lang, p[:2] AS p, n FROM c WHERE k = 3 UNION ALL SELECT lang, p[2:], n FROM c WHERE k = 3) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.p, ' ')) AS rank, array_to_string(s.p, ' ') AS phrase, a, l, r, t.n, score
FROM s JOIN t ON t.lang = s.lang LEFT JOIN m ON m.lang = s.lang AND m.p = s.p
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000
"""
