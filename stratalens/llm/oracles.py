"""DuckDB SQL for the queries that SQL can express. The others are held against brute force in the tests."""

from __future__ import annotations

from . import hilbert_shards, line_suffixes, pfair_mix, span_graph
from .quality_rules import Rules

_WORD = r"[^\x20\x09-\x0D]"
_R = Rules()

RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents
), l AS (
  SELECT doc_id, sum(n - 1) AS dups FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL) GROUP BY ALL
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a) AS n FROM (
    SELECT doc_id, i, md5(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS a
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS reps FROM g, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY ALL
), c AS (
  SELECT d.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed,
    base_failed OR 100 * n_symbols > {_R.max_symbol_percent} * word_chars
      OR 100 * n_dup_lines > {_R.max_dup_line_percent} * n_words
      OR word_chars > {_R.max_mean_word_chars} * n_words AS failed FROM c
), h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS k FROM f GROUP BY ALL
), t AS (
  SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) - m * m - m * (1 - m) * count(*) / sum(n) AS between_,
    least(greatest(CASE WHEN between_ > 0 THEN m * (1 - m) / between_ - 1 ELSE {_R.max_prior_rows} END, 1), {_R.max_prior_rows}) AS s
  FROM h
), v AS (SELECT source, round((k + m * s) / (n + m * s + (1 - m) * s), 6) AS host_rate FROM h, t)
SELECT doc_id, f.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate,
  host_rate > {_R.max_host_rate} AS bad_host, NOT base_failed AND NOT (bad_host AND failed) AS kept
FROM f JOIN v ON v.source IS NOT DISTINCT FROM f.source
"""

SPANS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS p FROM (
    SELECT doc_id, i, md5(array_to_string(ws[i:i + {span_graph.WINDOW - 1}], ' ')) AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {span_graph.WINDOW - 2})) AS i FROM d))
), x AS (SELECT DISTINCT doc_id, i + j AS i FROM g, (SELECT unnest(range({span_graph.WINDOW})) AS j) WHERE p > 1
), k AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM (
    SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) ANTI JOIN x USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

LINES_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, list(l ORDER BY i) AS ws, list(i ORDER BY i) AS pos FROM (
    SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id
), g AS (
  SELECT doc_id, i, n, pos, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS p FROM (
    SELECT doc_id, i, n, pos, md5(array_to_string(ws[i:i + n - 1], chr(10))) AS k FROM (
      SELECT doc_id, ws, pos, n, unnest(range(1, len(ws) - n + 2)) AS i
      FROM w, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) AS n) WHERE n <= len(ws)))
), x AS (
  SELECT DISTINCT doc_id, pos[i + j] AS i FROM g, (SELECT unnest(range({line_suffixes.MIN_LINES})) AS j)
  WHERE n = {line_suffixes.MIN_LINES} AND p > 1
), m AS (SELECT doc_id, max(n) AS deepest FROM g WHERE p > 1 GROUP BY doc_id
), c AS (SELECT doc_id, count(*) AS n_removed FROM x GROUP BY doc_id
), k AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS kept FROM (
    SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM d) ANTI JOIN x USING (doc_id, i) GROUP BY doc_id
)
SELECT a.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(CASE WHEN n_removed > 0 THEN deepest ELSE 0 END AS INT) AS deepest, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents a LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""


# Table of the checksum by bytes, and the checksum of a string by that table (t).
_CRC_TABLE = """
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(x AS UBIGINT) FOR x IN range(8)]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS v FROM range(256) g(i))"""


def _crc(text: str) -> str:
    return (
        f"xor(CAST(4294967295 AS UBIGINT), list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST('0x' || h AS UBIGINT) "
        f"FOR h IN regexp_extract_all(hex(encode({text})), '..')]), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])))"
    )


def _leaf(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    return f"sha256({' || '.join(field.format(v) for v in values)})"


def _levels(name: str, start: str) -> str:
    """Nodes (tree, lvl, pos, digest) of all trees; ``start`` gives the leaves."""
    return f"""{name}(tree, lvl, pos, digest) AS (
  {start}
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM (
    SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}) WHERE c > 1 GROUP BY tree, lvl, pos // 2
)"""


MANIFEST_SQL = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}
), d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE leaf END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM documents, tab
), {_levels('low', "SELECT tree, 0, pos, leaf FROM d")
}, tops AS (
  SELECT tree, max(lvl) AS height, arg_max(digest, lvl) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM low GROUP BY tree
), {_levels('high', "SELECT '', 0, pos, subroot FROM tops")
}, nodes AS (
  SELECT * FROM low UNION ALL SELECT * FROM high
), fold(doc_id, tree, home, lvl, pos, digest, others) AS (
  SELECT doc_id, tree, tree, 0, pos, changed, '' FROM d
  UNION ALL
  SELECT doc_id,
    CASE WHEN f.tree <> '' AND f.lvl = height THEN '' ELSE f.tree END, home,
    CASE WHEN f.tree <> '' AND f.lvl = height THEN 0 ELSE f.lvl + 1 END,
    CASE WHEN f.tree <> '' AND f.lvl = height THEN t.pos ELSE f.pos // 2 END,
    CASE WHEN f.tree <> '' AND f.lvl = height THEN f.digest WHEN f.pos % 2 = 1 THEN sha256(n.digest || f.digest)
      ELSE sha256(f.digest || coalesce(n.digest, '')) END,
    CASE WHEN f.tree <> '' AND f.lvl = height THEN others ELSE others || coalesce(n.digest, '') END
  FROM fold f JOIN tops t ON t.tree = home LEFT JOIN nodes n ON n.tree = f.tree AND n.lvl = f.lvl AND n.pos = xor(f.pos, 1)
  WHERE f.tree <> '' OR f.lvl < (SELECT max(lvl) FROM high)
)
SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM fold JOIN d USING (doc_id) JOIN tops ON tops.tree = home,
  (SELECT max(lvl) AS last, arg_max(digest, lvl) AS root FROM high)
WHERE fold.tree = '' AND lvl = last
"""


VARIANTS_SQL = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}
), r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
    FROM documents) WHERE length(run) >= 7 GROUP BY ALL
), h AS (
  SELECT run, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r, tab
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2:] ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), x AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS without FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word AS u, b.word AS v FROM x a JOIN x b ON a.i = b.i AND a.without = b.without AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.without = w.word
  UNION SELECT w.word, x.word FROM x JOIN w ON x.without = w.word
), b AS (
  SELECT u AS word, count(*) AS n_near, max(n) AS near_n, arg_min(v, (-n, v)) AS near FROM p JOIN w ON w.word = v GROUP BY u
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM w LEFT JOIN b USING (word)
), t(word, now, far) AS (
  SELECT word, word, 0 FROM w
  UNION ALL SELECT t.word, f.form, far + 1 FROM t JOIN f ON f.word = t.now WHERE f.form IS NOT NULL
), root AS (SELECT word, arg_max(now, far) AS root FROM t GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""


def shards_sql(shards: int) -> str:
    bits, side = hilbert_shards.BITS, 1 << hilbert_shards.BITS
    digits, states = hilbert_shards.curve_tables(3)
    bins = ", ".join(
        f"bin_{c} AS (SELECT {c} AS v, CAST((sum(n) OVER (ORDER BY {c} NULLS FIRST) - n) * {side} // (SELECT count(*) FROM documents)"
        f" AS INT) AS b FROM (SELECT {c}, count(*) AS n FROM documents GROUP BY ALL))"
        for c in ("lang", "source", "n_chars")
    )
    corner = " + ".join(f"(((c{i} >> b) & 1) << {i})" for i in range(3))
    return f"""
WITH RECURSIVE {bins}, tab AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(x AS UBIGINT) FOR x IN range(8)]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS v FROM range(256) g(i))
), r AS (
  SELECT doc_id, strlen(coalesce(text, '')) + {hilbert_shards.ROW_BYTES} AS size, coalesce(text, '') AS body,
    l.b AS bin_lang, s.b AS bin_source, n.b AS bin_n_chars
  FROM documents d JOIN bin_lang l ON l.v IS NOT DISTINCT FROM lang JOIN bin_source s ON s.v IS NOT DISTINCT FROM source
    JOIN bin_n_chars n ON n.v IS NOT DISTINCT FROM n_chars
), walk(c0, c1, c2, b, state, curve) AS (
  SELECT DISTINCT bin_lang, bin_source, bin_n_chars, {bits - 1}, 0, CAST(0 AS BIGINT) FROM r
  UNION ALL
  SELECT c0, c1, c2, b - 1, {states}[state * 8 + {corner} + 1], curve * 8 + {digits}[state * 8 + {corner} + 1]
  FROM walk WHERE b >= 0
), o AS (
  SELECT r.*, curve, sum(size) OVER w - size AS before_, row_number() OVER w AS p FROM r
  JOIN walk ON c0 = bin_lang AND c1 = bin_source AND c2 = bin_n_chars AND b = -1
  WINDOW w AS (ORDER BY curve, doc_id ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT *, CAST(least((2 * before_ + size) * {shards} // (2 * (SELECT sum(size) FROM r)), {shards - 1}) AS INT) AS shard FROM o
)
SELECT doc_id, CAST(size AS BIGINT) AS size, bin_lang, bin_source, bin_n_chars, curve, shard,
  p - min(p) OVER (PARTITION BY shard) AS slot, 'bytes' AS law, CAST(NULL AS INT) AS grown_shard, CAST(xor(CAST(4294967295 AS UBIGINT), list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), [CAST('0x' || h AS UBIGINT) FOR h IN regexp_extract_all(hex(encode(body)), '..')]),
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]))) AS BIGINT) AS text_crc32
FROM s, tab
"""


def mix_sql() -> str:
    slots = pfair_mix.SLOTS
    return f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + {pfair_mix.ROW_BYTES} AS size FROM documents
), s AS (
  SELECT source, sqrt(CAST(sum(size) AS DOUBLE)) AS weight, row_number() OVER (ORDER BY source NULLS FIRST) AS number FROM r GROUP BY source
), sh AS (
  SELECT *, ({slots} - count(*) OVER ()) * weight / sum(weight) OVER () AS share, 1 + floor(share) AS base FROM s
), q AS (
  SELECT source, number, CAST(base + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, number)
    <= {slots} - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS q FROM sh
), ql AS (SELECT list(q ORDER BY number) AS q FROM q
), run(t, done, pick) AS (
  SELECT -1, [0 FOR x IN q], 0 FROM ql
  UNION ALL
  SELECT t, [d + CASE WHEN i = p THEN 1 ELSE 0 END FOR d, i IN done], p FROM (
    SELECT t + 1 AS t, done, list_min([CASE WHEN done[i] * {slots} // q[i] <= t + 1
      THEN ((done[i] + 1) * {slots} + q[i] - 1) // q[i] * 100000 + i END FOR i IN range(1, len(q) + 1)]) % 100000 AS p
    FROM run, ql WHERE t < {slots - 1})
), e AS (SELECT pick AS number, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) AS i FROM run WHERE t >= 0
), b AS (
  SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size)
    // {pfair_mix.BLOCK_BYTES} AS block FROM r
)
SELECT doc_id, b.source, CAST(size AS BIGINT) AS size, CAST(block AS BIGINT) AS block,
  CAST((i - 1) * {slots} // q + block // q * {slots} AS BIGINT) AS released,
  CAST((i * {slots} + q - 1) // q + block // q * {slots} AS BIGINT) AS due, CAST(slot + block // q * {slots} AS BIGINT) AS slot
FROM b JOIN q ON q.source IS NOT DISTINCT FROM b.source JOIN e ON e.number = q.number AND e.i = block % q + 1
"""
