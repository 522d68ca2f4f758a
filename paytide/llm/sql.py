"""DuckDB SQL for the queries that SQL can state."""
from __future__ import annotations

from .decontam import THRESHOLD
from .filter_audit import MAX_CAPITALS, MIN_DISTINCT
from .filter_audit import MIN_WORDS as MIN_FILTER_WORDS
from .license_texts import LICENSES
from .licenses import COPYRIGHT, EQUIVALENT
from .quality import CLASSES, COMMON, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CLASS_CHARS, MIN_WORDS
from .urlfilter import OTHERWISE, RULES

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _chars(text: str, pattern: str) -> str:
    return f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"


def _distance(p: str, q: str) -> str:
    half = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"sqrt(greatest(sum({half.format(a=p, p=p, q=q)} + {half.format(a=q, p=p, q=q)}) / 2, 0))"


_NAMES = list(CLASSES)
_COUNTS = ", ".join(f"{_chars('j', p)} AS {k}" for k, p in CLASSES.items())
_LISTED = ", ".join([*_NAMES, f"n_chars_in_words - {' - '.join(_NAMES)}"])

ORACLES["op7_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
j AS (SELECT *, len(ws) AS n_words, array_to_string(ws, '') AS j FROM w),
c AS (SELECT *, length(j) AS n_chars_in_words, {_COUNTS} FROM j),
h AS (SELECT *, [{_LISTED}] AS cs FROM c),
refs AS (SELECT lang, i, sum(cs[i]) / greatest(sum(n_chars_in_words), 1) AS q FROM h, range(1, {len(CLASSES) + 2}) r(i)
  WHERE lang IS NOT NULL GROUP BY lang, i),
dc AS (SELECT doc_id, {_distance('p', 'q')} AS dc FROM
  (SELECT doc_id, cs[refs.i] / greatest(n_chars_in_words, 1) AS p, q FROM h JOIN refs USING (lang) WHERE n_chars_in_words >= {MIN_CLASS_CHARS})
  GROUP BY doc_id),
e AS (SELECT doc_id, lang, n_words, lower(unnest(ws)) AS word FROM h WHERE lang IS NOT NULL),
top AS (SELECT lang, word, n, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, word, count(*) AS n FROM e GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON}),
hist AS (SELECT d.doc_id, t.word, t.n / t.total AS q, coalesce(k.n, 0) / d.n_words AS p
  FROM (SELECT doc_id, lang, n_words FROM h WHERE n_words >= {MIN_WORDS}) d JOIN top t USING (lang)
  LEFT JOIN (SELECT doc_id, word, count(*) AS n FROM e GROUP BY ALL) k ON k.doc_id = d.doc_id AND k.word = t.word),
bins AS (SELECT doc_id, p, q FROM hist UNION ALL SELECT doc_id, 1 - sum(p), 1 - sum(q) FROM hist GROUP BY doc_id),
dw AS (SELECT doc_id, {_distance('p', 'q')} AS dw FROM bins GROUP BY doc_id),
win AS (SELECT doc_id, i, ws[i : i + 7] AS g FROM h, LATERAL (SELECT unnest(range(1, n_words - 6)) AS i)),
starts AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM starts, range(0, 8) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM h),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, n_chars_in_words::BIGINT AS word_chars,
  ({_chars('text', '[#*$%&|<>]')})::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words) AND coalesce(dc, 0) <= {MAX_CLASS_DISTANCE}
    AND coalesce(dw, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM h LEFT JOIN dc USING (doc_id) LEFT JOIN dw USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
"""

_RULES = ", ".join(f"('{r}', split_part('{r}', '/', 1), '{r[r.index('/'):]}', '{v}')" for r, v in RULES)

ORACLES["op6_url_filters"] = rf"""
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, rule_host, rule_path, verdict) AS (VALUES {_RULES})
SELECT page_id, host, path, rule, coalesce(verdict, '{OTHERWISE}') AS verdict FROM u LEFT JOIN r
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(rule_host) DESC) = 1
"""

ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '(?m){COPYRIGHT}', ' ', 'g')"
    out = rf"trim(regexp_replace(replace({out}, '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
    for old, new in EQUIVALENT:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LICENSES = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in LICENSES.items())

ORACLES["op9_license_scans"] = f"""
WITH known AS (SELECT sha256({_canonical('t')}) AS digest, min(id) AS license_id FROM (VALUES {_LICENSES}) k(id, t) GROUP BY 1),
d AS (SELECT doc_id, text, {_canonical('text')} AS form FROM documents),
w AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS text_digest FROM d),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, list_sort(list(DISTINCT license_id)) AS l FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM line) JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, text_digest, license_id, coalesce(l, CAST([] AS VARCHAR[])) AS line_licenses
FROM w LEFT JOIN known ON text_digest = digest LEFT JOIN hits USING (doc_id)
"""

_ITEM_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _shingles(source: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, CASE WHEN n < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS s
  FROM (SELECT {key}, ws, n, unnest(range(1, greatest(n - 4, 1) + 1)) AS i FROM (SELECT {key}, {_ITEM_WORDS} AS ws, len({_ITEM_WORDS}) AS n FROM {source}) WHERE n > 0)"""


ORACLES["op2_decontamination"] = f"""
WITH q AS ({_shingles('benchmark', 'item_id')}), d AS ({_shingles('documents', 'doc_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM q JOIN d USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n_item::BIGINT AS n_item FROM hit JOIN n USING (item_id)
WHERE 100 * n_shared >= {THRESHOLD} * n_item
"""

_PERMS = "SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5"
_AT = "least({})".format(", ".join(f"CASE WHEN {x} THEN strpos(filter_order, '{x.upper()}') ELSE 6 END" for x in "abcde"))

ORACLES["op12_filter_audit"] = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT doc_id, part, len(ws) < {MIN_FILTER_WORDS} AS a, 100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws) AS b,
  100 * ({_chars('text', '[A-Z]')}) > {MAX_CAPITALS} * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
w AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), p AS ({_PERMS}), s(step) AS (SELECT unnest(range(1, 6))),
x AS (SELECT w.*, filter_order, {_AT} AS out_at FROM w, p),
y AS (SELECT x.*, step, substr(filter_order, step, 1) AS l, CASE l WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails FROM x, s),
g AS (SELECT part, filter_order, step::INT AS step, l, sum(CASE WHEN out_at > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN out_at = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND out_at < step THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails AND a::INT + b::INT + c::INT + d::INT + e::INT = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN out_at = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN out_at = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM g
"""

_NEVER = "{{'c': 999999999, 'a': '', 't': CAST([] AS VARCHAR[])}}"


def _edit(frm: str, letter: str, cost: str, turn: str | None, when: str = "true") -> str:
    turns = f"{frm}.t" if turn is None else f"list_append({frm}.t, {turn})"
    return f"CASE WHEN {when} THEN {{'c': {frm}.c + {cost}, 'a': {frm}.a || '{letter}', 't': {turns}}} ELSE {_NEVER.format()} END"


def _states() -> str:
    """The four states after a turn, from those before it (without insertions after it)."""
    keep, user, bot = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    gone = [_edit(f"s{i}", "D", "4", None) for i in range(4)]
    stays = "NOT gone"
    to_1 = [gone[1], _edit("s0", "K", "extra", keep, f"{stays} AND initial = 's'")]
    to_2 = [gone[2]] + [e for i in (0, 1, 3) for e in (_edit(f"s{i}", "K", "extra", keep, f"{stays} AND initial = 'u'"), _edit(f"s{i}", "R", "3 + extra", user, stays))]
    to_3 = [gone[3], _edit("s2", "K", "extra", keep, f"{stays} AND initial = 'a'"), _edit("s2", "R", "3 + extra", bot, stays)]
    return ", ".join(f"list_min([{', '.join(c)}]) AS s{i}" for i, c in enumerate(([gone[0]], to_1, to_2, to_3)))


def _inserted(source: str, keys: str) -> str:
    """The same states after insertions."""
    two = f"list_min([s2, {', '.join(_edit(f's{i}', 'I', '3', chr(39) + 'user:' + chr(39)) for i in (0, 1, 3))}])"
    return f"SELECT {keys}, s0, s1, s2, list_min([s3, {_edit('s2', 'I', '3', chr(39) + 'assistant:' + chr(39))}]) AS s3 FROM (SELECT * REPLACE ({two} AS s2) FROM ({source}))"


_BITS = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda h, z: xor(h >> 1, (h & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: {_BITS}), 4294967295)"

ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS place FROM conversations),
dmg AS (SELECT *, {_CRC} % 20 AS d FROM src),
rows AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dmg WHERE d <> 0),
num AS (SELECT *, row_number() OVER o AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  lag(role[1]) OVER o || role[1] AS pair FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
flt AS (SELECT *, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN again THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault FROM num),
cod AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM flt),
dp AS ({_inserted(f"SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS s0, {_NEVER.format()} AS s1, {_NEVER.format()} AS s2, {_NEVER.format()} AS s3 FROM conversations", "conv_id, i")}
  UNION ALL {_inserted(f"SELECT dp.conv_id, cod.i, {_states()} FROM dp JOIN cod ON dp.conv_id IS NOT DISTINCT FROM cod.conv_id AND cod.i = dp.i + 1", "conv_id, i")}),
fin AS (SELECT conv_id, list_min([s0, s3]) AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM cod GROUP BY conv_id)
SELECT fin.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
  sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM fin LEFT JOIN cnt ON fin.conv_id IS NOT DISTINCT FROM cnt.conv_id
"""
