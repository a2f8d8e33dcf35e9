"""DuckDB SQL that registered queries must equal."""

from nearshelf.llm.quality_rules import COMMON_WORDS
from nearshelf.llm.secret_scan import BASE, MORE

WORD = r"[^\x20\x09-\x0D]+"
GAPS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quality(min_words: int, max_repeat: int, compare_from: int, max_chars: float, max_common: float, max_share: float) -> str:
    lists = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in COMMON_WORDS.items())
    width = 1 + max(map(len, COMMON_WORDS.values()))
    classes = ["[a-z]", r"[\x20\x09-\x0D]", "[A-Z]", r"[^\x00-\x7F]", "[0-9]", "[.,;:!?''\"()-]"]
    counts = ", ".join(f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in classes)
    rest = "[" + "|".join(["a-z", r"\x20\x09-\x0D", "A-Z", "0-9", ".,;:!?''\"()-"]).replace("|", "") + r"]|[^\x00-\x7F]"

    def distance(p: str, q: str, digits: int = 6) -> str:
        half = ("list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * "
                "log2({p}[i] / list_sum({p}) / (({p}[i] / list_sum({p}) + coalesce({q}[i], 0) / list_sum({q})) / 2)) ELSE 0 END))")
        both = f"{half.format(p=p, q=q)} + {half.format(p=f'list_resize({q}, len({p}), 0)', q=p)}"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(0, ({both}) / 2)), {digits}) ELSE 0 END"

    return f"""
WITH common(lang, list) AS (VALUES {lists}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(c.lang, '') AS lang,
    coalesce(c.list, []) AS list, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents LEFT JOIN common c USING (lang)),
positions AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM positions),
repeated AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) FROM windows WHERE n > 1) GROUP BY rid),
lettered AS (SELECT *, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS tokens FROM d),
f AS (
  SELECT d.rid, d.lang, list_transform([{counts}, length(regexp_replace(text, '{rest}', '', 'g'))], lambda x: x::DOUBLE) AS chars,
    list_append(hits, greatest(0, len(w) - coalesce(list_sum(hits), 0))::DOUBLE) AS common
  FROM (SELECT *, list_transform(list, lambda x: len(list_filter(tokens, lambda t: t = x))::DOUBLE) AS hits FROM lettered) d),
refs AS (
  SELECT lang,
    (SELECT list(s ORDER BY i) FROM (SELECT i, sum(chars[i]) AS s FROM f f2 JOIN d d2 USING (rid), range(1, 8) r(i) WHERE f2.lang = g.lang AND len(d2.w) >= {min_words} GROUP BY i)) AS ref_chars,
    (SELECT list(s ORDER BY i) FROM (SELECT i, sum(coalesce(common[i], 0)) AS s FROM f f2 JOIN d d2 USING (rid), range(1, {width + 1}) r(i) WHERE f2.lang = g.lang AND len(d2.w) >= {min_words} GROUP BY i)) AS ref_common
  FROM (SELECT DISTINCT lang FROM d) g),
m AS (
  SELECT d.doc_id, len(w) AS n_words, len(list_aggregate(w, 'string_agg', '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    {distance("chars", "ref_chars")} AS js_chars, {distance("common", "list_resize(ref_common, len(common), 0)")} AS js_common,
    {distance("bare", "list_resize(ref_common, len(bare), 0)", 15)} AS js_bare
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, {GAPS})) > 0) AS lines FROM d) d
  JOIN (SELECT *, list_transform(range(1, len(common) + 1), lambda i: CASE WHEN i = len(common) THEN 1.0::DOUBLE ELSE 0.0 END) AS bare FROM f) f USING (rid) JOIN refs ON refs.lang = d.lang LEFT JOIN repeated r ON r.rid = d.rid)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words AS base_failed, js_chars, js_common,
  NOT (n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words)
    AND NOT (n_words >= {compare_from} AND (js_chars > {max_chars} OR js_common > {max_common} OR (js_bare > 0 AND js_common > {max_share} * js_bare))) AS kept
FROM m"""


OP2 = _quality(50, 50, 80, 0.35, 0.45, 0.8)


def _secrets() -> str:
    def spans(rule, order: int) -> str:
        p = "'" + rule.pattern.replace("'", "''") + "'"
        return f"""
  SELECT rid, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      'start': list_sum(list_transform(r[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
      'size': length(m[i]), 'ok': length(g[i]) >= {rule.least}}}), lambda s: s.ok)) AS s, {order} AS o, '{rule.kind}' AS kind
  FROM (SELECT rid, string_split_regex(text, {p}) AS r, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {rule.group}) AS g FROM d)"""

    union = " UNION ALL ".join(spans(r, n) for n, r in enumerate([*BASE, *MORE]))
    listed = "string_agg(kind || ':' || (s.start)::BIGINT || ':' || (s.start + s.size)::BIGINT, ',' ORDER BY s.start, o)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({union}),
f AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
  {listed} FILTER (o < {len(BASE)}) AS base, {listed} AS spans FROM found GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (rid)"""


OP9 = _secrets()


def _line_dedup(min_words: int) -> str:
    return f"""
WITH parts AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT doc_id, line_no, regexp_extract_all(line, '{WORD}') AS w FROM parts),
placed AS (SELECT *, min((doc_id, line_no)) OVER (PARTITION BY w) AS firstly FROM lines WHERE len(w) > 0),
firsts AS (SELECT * FROM placed WHERE (doc_id, line_no) = firstly AND len(w) >= {min_words}),
members AS (
  SELECT doc_id, line_no, p, list_concat(w[1:p], w[p + 2:]) AS v FROM (SELECT *, unnest(range(0, len(w))) AS p FROM firsts)
  UNION ALL SELECT doc_id, line_no, p, w FROM (SELECT *, unnest(range(0, len(w) + 1)) AS p FROM firsts)),
near AS (SELECT DISTINCT doc_id, line_no FROM (SELECT *, min((doc_id, line_no)) OVER (PARTITION BY p, v) AS earliest FROM members) WHERE (doc_id, line_no) > earliest),
kinds AS (
  SELECT doc_id, line_no, CASE WHEN (doc_id, line_no) > firstly THEN 'copy' WHEN n.line_no IS NOT NULL THEN 'near' END AS kind
  FROM placed LEFT JOIN near n USING (doc_id, line_no))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (kind = 'copy')::BIGINT AS n_copies, count(*) FILTER (kind = 'near')::BIGINT AS n_near,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (kind IS NULL), '')) AS text_sha256
FROM parts LEFT JOIN kinds USING (doc_id, line_no) GROUP BY doc_id"""


OP5 = _line_dedup(5)


def _phrases(longest: int, least: int, top: int, share: int) -> str:
    sizes = " UNION ALL ".join(
        f"SELECT lang, w[i:i + {k - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces WHERE len(w) >= {k})"
        for k in range(1, longest + 1))
    return f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, p, count(*) AS a FROM ({sizes}) GROUP BY lang, p HAVING count(*) >= {least}),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) >= 2),
scores AS (
  SELECT c.lang, c.p, c.a, min({{'score': (2000000::HUGEINT * c.a) // (x.a + y.a), 'k': c.k, 'l': x.a, 'r': y.a}}) AS s
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] GROUP BY c.lang, c.p, c.a),
parts AS (
  SELECT lang, a, p[i:j] AS p
  FROM (SELECT lang, a, p, i, unnest(range(i + 1, len(p) + 1)) AS j FROM (SELECT lang, a, p, unnest(range(1, len(p))) AS i FROM f WHERE len(p) >= 3))
  WHERE j - i + 1 < len(p)),
inside AS (SELECT lang, p, max(a) AS most FROM parts GROUP BY lang, p),
kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.s.l AS l, s.s.r AS r, s.s.score AS score, len(s.p) AS n_words
  FROM scores s LEFT JOIN inside i USING (lang, p) WHERE i.most IS NULL OR 100 * i.most::HUGEINT < {share} * s.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, n_words::INT AS n_words
FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""


OP11 = _phrases(4, 30, 2000, 80)


def _fill_in_middle(seed: int, plain_percent: int, spm_percent: int) -> str:
    draws = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
  sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, {draws} FROM d),
cut AS (
  SELECT *, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - plain_percent} THEN 'plain'
      WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM cut)
SELECT doc_id, len(t)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""


OP12 = _fill_in_middle(1, 10, 20)
