"""The same results in DuckDB SQL, where SQL can express them."""

LOWER_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWER_ASCII + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {}

SQL["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS id, {WORDS.format('text')} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT id, array_to_string(list_slice(w, p, p + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, dw.n, id FROM dw JOIN iw USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT id)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SQL["op5_substrings"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
first AS (SELECT x, min(doc_id) AS least FROM win GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, p FROM win JOIN first USING (x) WHERE least < doc_id),
words AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM gone),
lists AS (SELECT doc_id, list(q) AS qs FROM words GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(qs), 0) AS m, w, qs FROM d LEFT JOIN lists USING (doc_id)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
left_over AS (
  SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.q) AS text
  FROM each LEFT JOIN words ON words.doc_id = each.doc_id AND words.q = each.q WHERE words.q IS NULL GROUP BY each.doc_id)
SELECT kept.doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM kept LEFT JOIN left_over USING (doc_id)
"""

SQL["op6_lines"] = r"""
WITH d AS (SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS w FROM documents),
c AS (SELECT doc_id, w, list_transform(w, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS c FROM d),
sized AS (SELECT doc_id, w, c, n, unnest(range(1, len(w) - n + 2)) AS p FROM c, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
win AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), chr(10)) AS x FROM sized
  WHERE n = 3 OR list_sum(list_slice(c, p, p + n - 1)) > 50),
ranked AS (SELECT doc_id, p, n, row_number() OVER (PARTITION BY n, x ORDER BY doc_id, p) AS r FROM win),
words AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM ranked WHERE r > 1),
each AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (
  SELECT each.doc_id, count(words.q) AS m, string_agg(line, chr(10) ORDER BY each.q) FILTER (words.q IS NULL) AS text
  FROM each LEFT JOIN words ON words.doc_id = each.doc_id AND words.q = each.q GROUP BY each.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_lines, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_ESCAPED = r"regexp_replace(regexp_replace({}, '(<)(\\*)(/?s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')"

SQL["op8_chat"] = f"""
WITH q AS (SELECT '</s>[INST] ok [/INST]' AS text),
c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', text FROM q UNION ALL SELECT -1, 1, 'assistant', text FROM q)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {len('<s>[INST][/INST]</s>')})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_TEXT_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
_WINDOW = "string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"

SQL["op11_repeats"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_TEXT_WORDS} AS w FROM documents),
each AS (SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
strings AS (
  SELECT r, p, n, {_WINDOW.format(3)} AS x4, {_WINDOW.format(7)} AS x8, {_WINDOW.format(50)} AS x51 FROM each),
win AS (
  SELECT r, p, 4 AS k, count(*) OVER (PARTITION BY r, x4) > 1 AS again FROM strings WHERE p + 3 <= n
  UNION ALL SELECT r, p, 8, count(*) OVER (PARTITION BY r, x8) > 1 FROM strings WHERE p + 7 <= n
  UNION ALL SELECT r, p, 51, count(*) OVER (PARTITION BY r, x51) > 1 FROM strings WHERE p + 50 <= n),
inside AS (SELECT r, k, count(DISTINCT q) AS n FROM (SELECT r, k, unnest(range(p, p + k)) AS q FROM win WHERE again) GROUP BY r, k),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM d),
dup AS (
  SELECT r, count(*) AS n FROM (SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY p) AS c FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE c > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(i8.n, 0)::BIGINT AS n_repeat_words,
    coalesce(i4.n, 0)::BIGINT AS n_covered,
    coalesce(i51.n, 0) AS n_long
  FROM d LEFT JOIN dup USING (r) LEFT JOIN (SELECT r, n FROM inside WHERE k = 4) i4 USING (r) LEFT JOIN (SELECT r, n FROM inside WHERE k = 8) i8 USING (r) LEFT JOIN (SELECT r, n FROM inside WHERE k = 51) i51 USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_covered <= 40 * n_words AND n_long = 0 AS kept
FROM m
"""

SQL["op12_audit"] = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_TEXT_WORDS} AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1)::INT AS good, max(toxic = 1)::INT AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END) AS failed
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a b, a c, a d, a e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
j AS (
  SELECT *, contains(failed, x) AS fails, before <> '' AND regexp_matches(failed, '[' || before || 'x]') AS gone FROM s, c),
r AS (
  SELECT part, filter_order, step::INT AS step, x AS filter, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed,
    sum(n) FILTER (gone AND fails) AS redundant, sum(n) FILTER (failed = x) AS unique_fails,
    sum(good) FILTER (NOT gone AND fails) AS good_lost, sum(toxic) FILTER (NOT gone AND fails) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step, filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM r
"""

SQL["op13_repair"] = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab
  FROM (SELECT unnest(range(256)) AS n)),
luck AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, tab),
rows AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM luck WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM rows),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) || role[1] AS pair
  FROM placed),
ins(p, m, c, e, t) AS (VALUES
  (0, 0, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']),
  (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
edit(m, q, need, c, e, name) AS (VALUES
  (0, 1, 's', 0, 'K', ''), (0, 2, 'u', 0, 'K', ''), (1, 2, 'u', 0, 'K', ''), (3, 2, 'u', 0, 'K', ''), (2, 3, 'a', 0, 'K', ''),
  (0, 2, '', 2, 'R', 'user'), (1, 2, '', 2, 'R', 'user'), (3, 2, '', 2, 'R', 'user'), (2, 3, '', 2, 'R', 'assistant'),
  (0, 0, '', 3, 'D', ''), (1, 1, '', 3, 'D', ''), (2, 2, '', 3, 'D', ''), (3, 3, '', 3, 'D', '')),
step AS (
  SELECT ins.p AS s, edit.q, edit.need, edit.e AS edit, ins.c + edit.c AS c, ins.e || edit.e AS e, ins.t, edit.name FROM ins JOIN edit ON ins.m = edit.m),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS p, 0 AS s, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS best FROM conversations
  UNION ALL
  SELECT conv_id, any_value(p), q, min(best) FROM (
    SELECT walk.conv_id, j.p, step.q, {
      'c': (best.c + step.c + CASE WHEN j.fault = 'truncated' AND edit <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'a': best.a || step.e,
      't': list_concat(best.t, step.t, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [step.name || ':' || j.text] END)} AS best
    FROM walk JOIN judged j ON walk.conv_id IS NOT DISTINCT FROM j.conv_id AND j.p = walk.p + 1
    JOIN step ON step.s = walk.s AND (need = '' OR need = j.role[1]) AND (edit = 'D' OR j.fault NOT IN ('blank', 'duplicate')))
  GROUP BY conv_id, q),
counts AS (
  SELECT c.conv_id, count(j.p) AS n, coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
    count(*) FILTER (fault = 'truncated')::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
last AS (
  SELECT walk.conv_id, min({
    'c': (best.c + [0, 4, 2, 0][s + 1])::BIGINT, 'a': best.a || ['', 'II', 'I', ''][s + 1],
    't': list_concat(best.t, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS best
  FROM walk JOIN counts ON counts.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.p = counts.n GROUP BY walk.conv_id)
SELECT counts.conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit,
  sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM counts JOIN last ON counts.conv_id IS NOT DISTINCT FROM last.conv_id
"""
