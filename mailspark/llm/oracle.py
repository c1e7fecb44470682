"""DuckDB SQL for the results of those operators that SQL can express on whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"""regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept
FROM least LEFT JOIN n ON a = id"""

#: The pages of these tables mark their article; its blocks are headings, paragraphs and lines.
PAGES = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(h, '</?(?:p|h1|br)[^>]*>'),
  lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'),
       '&amp;?', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), chr(1), '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""

BENCHMARK = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM runs JOIN windows USING (n, s)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)))"""


def _way(state: str, cost: str, initial: str, text: str | None, allowed: str = "TRUE") -> str:
    """The way ``state`` longer by one edit; without a cost bound where it is not allowed."""
    added = f"{state}.t" if text is None else f"concat({state}.t, chr(10), {text})"
    return (f"{{'c': CASE WHEN {allowed} THEN {state}.c + {cost} ELSE 1000000000 END, 'a': {state}.a || '{initial}', 't': {added}}}")


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


_FIRST, _LIVE, _CUT = "substr(role, 1, 1)", "fault NOT IN (1, 2)", "CASE WHEN fault = 3 THEN 3 ELSE 0 END"
_OWN, _AS_USER, _AS_ASSISTANT = "role || ':' || text", "'user:' || text", "'assistant:' || text"
_TO_USER = _least("s2", *(_way(s, "3", "I", "'user:'") for s in ("s0", "s1", "s3")))
_TO_ASSISTANT = _least("s3", _way("u", "3", "I", "'assistant:'"))
_NONE = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"

#: Forward search over the rows of a conversation, with whole strings of edits and texts.
CONVERSATIONS = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS k FROM k),
r AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
  rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS tail,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM r),
f AS (SELECT conv_id, turn, i, role, text, before,
  CASE WHEN tail = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(tail, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM o),
steps(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}}, {_NONE}, {_NONE}, {_NONE} FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, {_way('s0', '4', 'D', None)},
    {_least(_way('s1', '4', 'D', None), _way('s0', _CUT, 'K', _OWN, f"{_LIVE} AND {_FIRST} = 's'"))},
    {_least(_way('u', '4', 'D', None), *(_way(s, f'3 + {_CUT}', 'R', _AS_USER, _LIVE) for s in ('s0', 's1', 'a')),
            *(_way(s, _CUT, 'K', _OWN, f"{_LIVE} AND {_FIRST} = 'u'") for s in ('s0', 's1', 'a')))},
    {_least(_way('a', '4', 'D', None), _way('u', f'3 + {_CUT}', 'R', _AS_ASSISTANT, _LIVE),
            _way('u', _CUT, 'K', _OWN, f"{_LIVE} AND {_FIRST} = 'a'"))}
  FROM (SELECT *, {_TO_ASSISTANT} AS a FROM (SELECT f.conv_id, f.i, f.role, f.text, f.fault, s0, s1, s3, {_TO_USER.replace('s2', 'steps.s2')} AS u
    FROM steps JOIN f ON f.conv_id IS NOT DISTINCT FROM steps.conv_id AND f.i = steps.i + 1))),
last AS (SELECT conv_id, {_least('s0', 'a')} AS w FROM (SELECT *, {_TO_ASSISTANT} AS a FROM (SELECT conv_id, s0, s3, {_TO_USER} AS u
  FROM steps WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM steps GROUP BY conv_id)))),
n AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
  count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit,
  sha256(coalesce(substr(w.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id"""

PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, k, phrase, a, w, array_to_string(w[:j], ' ') AS left_part, array_to_string(w[j + 1:], ' ') AS rest, j
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)),
scores AS (SELECT x.*, l.a AS l, r.a AS r, 1000000 * x.a * x.a // (l.a * r.a) AS score FROM cuts x
  JOIN f l ON l.lang = x.lang AND l.phrase = left_part JOIN f r ON r.lang = x.lang AND r.phrase = rest),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part, a
  FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND part = phrase AND 100 * longer.a >= 50 * best.a WHERE part IS NULL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
