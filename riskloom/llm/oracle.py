"""DuckDB SQL for the operators that SQL can express, with its own fixed values."""

SPACE = r"[\x20\x09-\x0D]+"

QUALITY = r"""
WITH lists(lang, vocabulary) AS (VALUES
  ('en', string_split('the of and to in is that for with on as are this be by from a was', ' ')),
  ('fr', string_split('de la le et les des en un du une que est pour qui dans par au sur', ' ')),
  ('de', string_split('der die und in den von zu das mit sich des auf für ist im dem nicht ein', ' ')),
  ('es', string_split('de la que el en y a los se del las un por con no una su para', ' '))
), texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM texts)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS k FROM repeated) GROUP BY rid
), base AS (
  SELECT x.rid, doc_id, x.lang, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n, 0) AS n_repeat_words,
    regexp_replace(t, '[\p{L}\x20\x09-\x0D]+', '', 'g') AS marks, length(t) AS n_chars, vocabulary
  FROM texts x LEFT JOIN covered USING (rid) LEFT JOIN lists ON x.lang = lists.lang
), counted AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_transform(vocabulary, lambda v: len(list_filter(ws, lambda w: w = v))) AS found,
    len(regexp_extract_all(marks, '\p{Nd}')) AS digits, len(regexp_extract_all(marks, '[.,;:!?''"()-]')) AS stops
  FROM base
), shaped AS (
  SELECT rid, doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    [word_chars - length(marks), digits, stops, n_symbols, length(marks) - n_symbols - digits - stops, n_chars - word_chars] AS chars,
    CASE WHEN vocabulary IS NOT NULL THEN list_append(found, n_words - list_sum(found)::BIGINT) END AS common
  FROM counted
), known AS (
  SELECT row_number() OVER () AS kid, * FROM (SELECT DISTINCT lang, n_words, chars, common FROM shaped WHERE NOT base_failed AND lang IS NOT NULL)
), enough AS (
  SELECT lang FROM known GROUP BY lang HAVING sum(n_words) >= 10000
), cells AS (
  SELECT kid, lang, n_words, 'chars' AS kind, unnest(range(6)) AS k, unnest(chars) AS v FROM known SEMI JOIN enough USING (lang)
  UNION ALL
  SELECT kid, lang, n_words, 'common', unnest(range(19)), unnest(common) FROM known SEMI JOIN enough USING (lang) WHERE common IS NOT NULL
), weighed AS (
  SELECT *, floor(v * least(n_words, 1000) * 1000000 / sum(v) OVER (PARTITION BY kid, kind))::BIGINT AS share FROM cells
), first_reference AS (
  SELECT lang, kind, k, sum(share) AS r FROM weighed GROUP BY ALL
), first_distances AS (
  SELECT kid, lang, kind, floor(1000 * sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)))::INTEGER AS bin
  FROM (SELECT kid, lang, kind, v / sum(v) OVER (PARTITION BY kid, kind) AS p, r / sum(r) OVER (PARTITION BY kid, kind) AS q FROM weighed JOIN first_reference USING (lang, kind, k))
  GROUP BY kid, lang, kind
), medians AS (
  SELECT lang, kind, quantile_disc(bin, 0.5) AS middle FROM first_distances GROUP BY lang, kind
), near AS (
  SELECT kid FROM first_distances JOIN medians USING (lang, kind) GROUP BY kid HAVING bool_and(bin <= middle)
), second_reference AS (
  SELECT lang, kind, k, sum(share) AS r2 FROM weighed SEMI JOIN near USING (kid) GROUP BY ALL
), reference AS (
  SELECT lang, kind, k, coalesce(r2, r) AS r FROM first_reference LEFT JOIN second_reference USING (lang, kind, k)
), judged AS (
  SELECT rid, lang, n_words, 'chars' AS kind, unnest(range(6)) AS k, unnest(chars) AS v FROM shaped
  UNION ALL
  SELECT rid, lang, n_words, 'common', unnest(range(19)), unnest(common) FROM shaped WHERE common IS NOT NULL
), shares AS (
  SELECT rid, kind, n_words, v / sum(v) OVER (PARTITION BY rid, kind) AS p, r / sum(r) OVER (PARTITION BY rid, kind) AS q
  FROM judged JOIN reference USING (lang, kind, k)
), distances AS (
  SELECT rid, kind, any_value(n_words) AS n_words, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM shares GROUP BY rid, kind
), far AS (
  SELECT DISTINCT rid FROM distances
  WHERE NOT isnan(d) AND d > sqrt(CASE kind WHEN 'chars' THEN 0.008::DOUBLE + 2.9::DOUBLE / greatest(n_words, 1) ELSE 0.012::DOUBLE + 7::DOUBLE / greatest(n_words, 1) END)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM far) AS kept
FROM shaped
"""

DECONTAMINATE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark
), grams AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM grams
), probes AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hits AS (
  SELECT rid, p.n, i, item FROM probes p JOIN grams USING (n, g)
), places AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
"""

SHARDS = """
WITH RECURSIVE shards AS (
  SELECT list(('0x' || substr(md5('offset shard-' || k), 1, 8))::BIGINT % 4099 ORDER BY k) AS first,
    list(('0x' || substr(md5('skip shard-' || k), 1, 8))::BIGINT % 4098 + 1 ORDER BY k) AS skip
  FROM range(32) t(k)
), turns(turn, owner, first, skip) AS (
  SELECT 0, list_transform(range(4099), lambda j: -1), first, skip FROM shards
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda o, j: CASE WHEN j = slot + 1 THEN turn % 32 ELSE o END), first, skip
  FROM (
    SELECT *, list_filter(list_transform(range(4099), lambda j: (first[turn % 32 + 1] + j * skip[turn % 32 + 1]) % 4099), lambda s: owner[s + 1] = -1)[1] AS slot
    FROM turns WHERE turn < 4099
  )
), filled AS (
  SELECT unnest(range(4099)) AS slot, unnest(owner) AS shard FROM turns WHERE turn = 4099
)
SELECT doc_id, slot::INTEGER AS slot, shard::INTEGER AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % 4099 AS slot FROM documents) JOIN filled USING (slot)
"""

SUBSTRINGS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM texts)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM windows) WHERE c > 1
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS place FROM repeated
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY place) AS words, count(*) AS n
  FROM (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS place FROM texts) ANTI JOIN gone USING (rid, place) GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""

STRINGS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT rid, start, length(h) // 2 - 399 - start AS left_over, substr(h, (2 * start + 1)::BIGINT, 2 * (512 + 399)) AS piece
  FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399, 512)) AS start FROM texts)
), windows AS (
  SELECT rid, start + j AS i, md5_number(substr(piece, (2 * j + 1)::BIGINT, 800)) AS g FROM (SELECT rid, start, piece, unnest(range(0, least(512, left_over))) AS j FROM pieces)
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM windows) WHERE c > 1
), runs AS (
  SELECT rid, min(i) AS a, max(i) + 400 AS b FROM (
    SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
      SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM repeated)) GROUP BY rid, run
), spans AS (
  SELECT rid, a, b, coalesce(lead(a) OVER (PARTITION BY rid ORDER BY a), 1000000000) AS next FROM runs
), kept AS (
  SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, substr(any_value(h), 1, 2 * min(a)) || string_agg(substr(h, 2 * b + 1, 2 * (next - b)), '' ORDER BY a) AS rest
  FROM spans JOIN texts USING (rid) GROUP BY rid
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""

CHATS = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(t, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

RUNS = r"""
WITH checked AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295) AS h
  FROM documents
), placed AS (
  SELECT *, (h // 10) % len(ws) AS a, 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS p FROM checked
), texts AS (
  SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN list_transform(ws, lambda w, i: CASE WHEN i - 1 < a THEN w ELSE ws[a + (i - 1 - a) % p + 1] END) ELSE ws END AS ws
  FROM placed
), grams AS (
  SELECT rid, i, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM texts)
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.g = y.g AND y.i > x.i
), stretches AS (
  SELECT rid, q, min(i) - 1 AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island
), long_ones AS (
  SELECT * FROM stretches WHERE length >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM long_ones x WHERE NOT EXISTS (SELECT 1 FROM long_ones y WHERE x.rid = y.rid AND y.q < x.q AND x.q % y.q = 0 AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), gone AS (
  SELECT DISTINCT rid, unnest(range(start + q + 1, start + length + 1)) AS place FROM runs
), rest AS (
  SELECT rid, string_agg(w, ' ' ORDER BY place) AS kept FROM (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS place FROM texts) ANTI JOIN gone USING (rid, place) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, max(struct_pack(l := length, s := -start, q := -q)) AS best FROM runs GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.q AS period, 1000 * best.l // -best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (rid) LEFT JOIN rest USING (rid)
"""

NEGATIVES = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid)::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
