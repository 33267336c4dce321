"""SQL of the operators whose results can be said in SQL with little more than joins over words."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"
#: The table of the reflected CRC-32 polynomial, by its rule.
CRC_TABLE = "k AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i))"


def crc32(bytes_: str) -> str:
    """Unsigned crc32 of a VARCHAR expression's UTF-8, with the column `crc` of CRC_TABLE in reach."""
    codes = f"list_transform(range(octet_length(encode({bytes_}))), lambda i: CAST('0x' || substr(hex(encode({bytes_})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(crc[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8)), CAST(4294967295 AS BIGINT))"


PERIODIC_RUNS = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS words, {crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, k),
e AS (SELECT *, len(words) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM e),
w AS (SELECT doc_id, n, CASE WHEN a < n THEN list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE words END AS words FROM f),
o AS (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM w),
p AS (SELECT doc_id, n, unnest(list_transform(range(greatest(n - 15, 0)), lambda i: md5(array_to_string(words[i + 1:i + 16], ' ')))) AS passage, unnest(range(greatest(n - 15, 0))) AS i FROM w),
q AS (SELECT DISTINCT x.doc_id, y.i - x.i AS period FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.passage = y.passage AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
m AS (SELECT q.doc_id, period, x.i, x.i - row_number() OVER (PARTITION BY q.doc_id, period ORDER BY x.i) AS stretch
      FROM q JOIN o x ON x.doc_id = q.doc_id JOIN o y ON y.doc_id = q.doc_id AND y.i = x.i + period AND y.word = x.word),
s AS (SELECT doc_id, period, min(i) AS start, count(*) + period AS length FROM m GROUP BY doc_id, period, stretch HAVING count(*) + period >= greatest(24, 3 * period)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.period < s.period AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
             first(struct_pack(start := start, length := length, period := period) ORDER BY length * 1000000000000 // period DESC, start, period) AS best FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT o.doc_id, o.i FROM o JOIN r ON o.doc_id = r.doc_id AND o.i >= r.start + r.period AND o.i < r.start + r.length),
c AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.i) AS kept FROM o LEFT JOIN x ON o.doc_id = x.doc_id AND o.i = x.i WHERE x.i IS NULL GROUP BY o.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN c ON w.doc_id = c.doc_id"""


SPELLING_VARIANTS = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, times, {crc32("id || ':' || run")} AS h FROM l, k),
t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
m AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || '_' || substr(word, CAST(i AS INT) + 1) AS hole, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS less FROM g),
p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM m x JOIN m y ON x.hole = y.hole AND x.i = y.i AND x.word <> y.word
      UNION SELECT x.word, y.word, y.n FROM m x JOIN v y ON x.less = y.word UNION SELECT y.word, x.word, x.n FROM m x JOIN v y ON x.less = y.word),
b AS (SELECT word, count(*) AS n_near, first(struct_pack(near := near, n := near_n) ORDER BY near_n DESC, encode(near)) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * v.n THEN best.near END AS form, CASE WHEN best.n >= 10 * v.n THEN best.n END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM c WHERE next IS NULL) USING (word)"""
