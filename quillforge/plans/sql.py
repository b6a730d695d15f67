"""Building blocks of the SQL that says what each query must return, for an independent engine."""

from __future__ import annotations

from ..functions.edits import KEYS, NEIGHBOURS

BASE = r"""
tokl AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS l FROM documents),
tok AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS w FROM tokl),
vocab AS MATERIALIZED (SELECT w, count(*) AS n FROM tok WHERE regexp_full_match(w, '[a-z]+') GROUP BY w),
tot AS (SELECT coalesce(sum(n), 0)::BIGINT AS total FROM vocab),
known AS MATERIALIZED (SELECT w, n FROM vocab WHERE n >= 3),
frequent AS MATERIALIZED (SELECT w, n FROM known, tot WHERE n * 10000 >= total)"""


def bucket(w: str) -> str:
    return f"(list_reduce(list_transform(range(1, length({w}) + 1), lambda i: ascii(substr({w}, i, 1))), lambda h, b: (h * 33 + b) % 256, 0) + 1)::BIGINT"


def swap23(w: str) -> str:
    return f"(substr({w}, 1, 1) || substr({w}, 3, 1) || substr({w}, 2, 1) || substr({w}, 4))"


def deletions(w: str) -> str:
    return f"list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1))"


def swaps(w: str) -> str:
    return f"list_transform(range(1, length({w})), lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1, 1) || substr({w}, i, 1) || substr({w}, i + 2))"


def distinct(w: str, items: str, least: int = 0) -> str:
    return f"list_distinct(list_filter({items}, lambda x: x <> {w} AND length(x) >= {least}))"


def one_edit(w: str) -> str:
    letters = "range(97, 123)"
    subs = f"flatten(list_transform(range(1, length({w}) + 1), lambda i: list_transform({letters}, lambda c: substr({w}, 1, i - 1) || chr(c::INTEGER) || substr({w}, i + 1))))"
    ins = f"flatten(list_transform(range(0, length({w}) + 1), lambda i: list_transform({letters}, lambda c: substr({w}, 1, i) || chr(c::INTEGER) || substr({w}, i + 1))))"
    return distinct(w, f"flatten([{deletions(w)}, {swaps(w)}, {subs}, {ins}])")


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in zip(KEYS, NEIGHBOURS, strict=True)) + "}"


def keyboard(w: str) -> str:
    doubled = f"list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, i) || substr({w}, i))"
    near = lambda form: f"flatten(list_transform(range(1, length({w}) + 1), lambda i: list_transform(string_split({_MAP}[substr({w}, i, 1)], ''), lambda c: {form})))"
    kinds = [deletions(w), doubled, swaps(w), near(f"substr({w}, 1, i - 1) || c || substr({w}, i + 1)"), near(f"substr({w}, 1, i - 1) || c || substr({w}, i)"), near(f"substr({w}, 1, i) || c || substr({w}, i + 1)")]
    return distinct(w, f"flatten([{', '.join(kinds)}])", 3)


def is_swap(a: str, b: str) -> str:
    return f"(length({a}) = length({b}) AND {a} <> {b} AND list_contains({swaps(a)}, {b}))"


def is_repeat(typo: str, c: str) -> str:
    return f"(length({typo}) = length({c}) + 1 AND list_contains(list_transform(range(1, length({c}) + 1), lambda i: substr({c}, 1, i) || substr({c}, i)), {typo}))"


CATALOG = f"""
swapped AS MATERIALIZED (SELECT {swap23('w')} AS typo, w AS correction FROM vocab WHERE length(w) >= 6),
catalog AS MATERIALIZED (SELECT typo, correction, {bucket('typo')} % 4 = 0 AS capitalized_ok FROM swapped ANTI JOIN vocab ON vocab.w = swapped.typo WHERE typo <> correction)"""

ENTRIES = f"""
e_swap AS (SELECT {swap23('w')} AS typo, w AS correction FROM known WHERE length(w) >= 3 AND {swap23('w')} <> w),
e_cut AS (SELECT substr(w, 1, 5) AS typo, min(w) AS correction FROM frequent WHERE length(w) = 6 GROUP BY 1),
pairs AS (SELECT l[i] AS a, l[i + 1] AS b FROM (SELECT l, unnest(range(1, len(l))) AS i FROM tokl)),
e_two AS (SELECT a || b AS typo, min(a || ' ' || b) AS correction FROM (SELECT a, b FROM pairs WHERE regexp_full_match(a, '[a-z]+') AND regexp_full_match(b, '[a-z]+') GROUP BY a, b HAVING count(*) >= 5) GROUP BY 1 HAVING length(a || b) >= 3),
e_first AS (SELECT * FROM e_swap UNION ALL SELECT * FROM e_cut WHERE typo NOT IN (SELECT typo FROM e_swap)),
entries AS MATERIALIZED (SELECT * FROM e_first UNION ALL SELECT * FROM e_two WHERE typo NOT IN (SELECT typo FROM e_first)),
documented AS (SELECT typo, correction FROM entries WHERE {bucket('typo')} % 4 = 0),
reviewed AS (SELECT typo, correction FROM entries WHERE {bucket('typo')} % 16 = 0)"""
ENTRIES = ENTRIES.replace("GROUP BY 1 HAVING length(a || b) >= 3", "WHERE length(a || b) >= 3 GROUP BY 1")

NO_ENTRIES = """
entries AS (SELECT '' AS typo, '' AS correction WHERE false)"""


def candidates(typos: str, name: str = "cand") -> str:
    """CTEs for (typo, candidate, n): known words one edit from the typos of a table."""
    keys = lambda w: f"unnest(list_distinct(list_concat([{w}], {deletions(w)})))"
    return f"""
{name}_t AS (SELECT typo, {keys('typo')} AS k FROM (SELECT DISTINCT typo FROM {typos})),
{name}_w AS (SELECT w AS candidate, n, {keys('w')} AS k FROM known),
{name} AS (SELECT DISTINCT typo, candidate, n FROM {name}_t JOIN {name}_w USING (k) WHERE typo <> candidate AND damerau_levenshtein(typo, candidate) = 1)"""


def preferences(cand: str = "cand", documented: str = "documented") -> str:
    """CTEs for pref (typo, k, cands, w1, w1n, swap_basic, swap_common, swap) of candidates."""
    return f"""
rk AS (SELECT *, row_number() OVER o AS r, lead(n) OVER o AS n2 FROM {cand} WINDOW o AS (PARTITION BY typo ORDER BY n DESC, candidate)),
rs AS (SELECT *, row_number() OVER o AS r, lead(n) OVER o AS n2 FROM {cand} WHERE length(candidate) = length(typo) WINDOW o AS (PARTITION BY typo ORDER BY n DESC, candidate)),
w1 AS (SELECT typo, candidate AS w1, n AS w1n FROM rk, tot WHERE r = 1 AND n * 100000 >= total AND n >= 100 * coalesce(n2, 0)),
ws AS (SELECT typo, candidate AS ws FROM rs, tot WHERE r = 1 AND n * 100000 >= total AND n >= 100 * coalesce(n2, 0)),
sw AS (SELECT typo, count(*) AS k, list_sort(list(candidate)) AS cands, bool_or(length(candidate) > length(typo) OR length(candidate) < length(typo) - 1) AS bad,
              count(*) FILTER (WHERE length(candidate) = length(typo)) AS ns, count(*) FILTER (WHERE {is_swap('typo', 'candidate')}) AS nsw,
              max(candidate) FILTER (WHERE {is_swap('typo', 'candidate')}) AS s, max(n) FILTER (WHERE {is_swap('typo', 'candidate')}) AS sn,
              coalesce(max(n) FILTER (WHERE length(candidate) = length(typo) AND NOT {is_swap('typo', 'candidate')}), -1) AS other FROM {cand} GROUP BY typo),
pf0 AS (SELECT sw.typo, k, cands, w1, w1n, CASE WHEN NOT bad AND nsw = 1 THEN s END AS s, sn, other, ns, ws, d.correction AS d FROM sw LEFT JOIN w1 USING (typo) LEFT JOIN ws USING (typo) LEFT JOIN {documented} d USING (typo)),
pf1 AS (SELECT *, CASE WHEN ns = 1 THEN s END AS swap_basic, CASE WHEN ns = 1 OR (length(typo) >= 5 AND ws = s) THEN s END AS swap_common FROM pf0),
pref AS (SELECT typo, k, cands, w1, w1n, swap_basic, swap_common, coalesce(swap_common, CASE WHEN length(typo) >= 5 AND d = s AND sn * 100000 >= total AND sn > other THEN s END) AS swap FROM pf1, tot)"""


def described(pairs: str) -> str:
    """CTE x: pairs with all that the rules look at, and the rules g5, g6, gs (short) and gate."""
    frequent = "(c.n * 10000 >= total)"
    typo_in = lambda c: f"list_contains({keyboard(c)}, typo)"
    return f"""
x0 AS (SELECT p.typo, p.correction, coalesce(c.n, 0) AS n, pf.k, pf.cands, pf.w1, pf.w1n, pf.swap_basic, pf.swap_common, pf.swap, total, d.correction AS d, v.w IS NOT NULL AS in_corpus,
              kp.w IS NOT NULL AS protected, kc.w IS NOT NULL AS destination, rv.correction AS rv, en.correction AS entry
       FROM (SELECT DISTINCT typo, correction FROM {pairs}) p CROSS JOIN tot LEFT JOIN pref pf USING (typo) LEFT JOIN vocab c ON c.w = p.correction LEFT JOIN vocab v ON v.w = p.typo
       LEFT JOIN known kp ON kp.w = p.typo LEFT JOIN known kc ON kc.w = p.correction LEFT JOIN documented d ON d.typo = p.typo LEFT JOIN reviewed rv ON rv.typo = p.typo LEFT JOIN entries en ON en.typo = p.typo),
x1 AS (SELECT *, n * 10000 >= total AND n > 0 AS common, d IS NOT DISTINCT FROM correction AS doc, typo = 'hte' AND correction = 'the' AND d IS NOT DISTINCT FROM correction AS dshort,
              coalesce(w1 = correction, false) AS w1_is, {is_swap('typo', 'correction')} AS swp, {is_repeat('typo', 'correction')} AS rep FROM x0),
x2 AS (SELECT *, length(correction) IN (3, 4) AND common AND w1_is AND {typo_in('correction')} AS gs, length(correction) = 5 AND length(typo) IN (4, 5) AND common AND w1_is AND {typo_in('correction')} AS g5,
              length(typo) = 5 AND length(correction) = 6 AND common AND coalesce(cands = [correction], false) AND list_contains({deletions('correction')}, typo) AS g6,
              coalesce(length(w1) IN (3, 4) AND w1n * 10000 >= total AND {typo_in('w1')}, false) AS w1_short FROM x1),
x3 AS (SELECT *, CASE WHEN length(typo) >= 6 THEN true WHEN dshort THEN true WHEN length(typo) = 5 AND doc THEN true WHEN length(correction) IN (3, 4) THEN gs WHEN g5 THEN true WHEN g6 THEN true
                      ELSE length(typo) = 5 AND (swap IS NOT DISTINCT FROM correction OR (swp AND swap IS NULL AND w1_is)) END AS gate,
              list_filter(coalesce(cands, []), lambda c: c <> correction) AS rivals, list_contains(coalesce(cands, []), correction) AS is_known FROM x2),
x AS (SELECT *, CASE WHEN len(rivals) = 0 THEN 'alone' WHEN dshort THEN 'short' WHEN gs THEN 'frequency' WHEN w1_short AND NOT w1_is THEN 'competing' WHEN coalesce(swap = correction, false) THEN 'swap'
                     WHEN swap IS NULL AND w1_is THEN 'frequency' ELSE 'competing' END AS outcome FROM x3)"""


def joined_ok(pairs: str) -> str:
    """CTE jv (typo, correction, ok): two-word corrections by their own rule."""
    return f"""
jp AS (SELECT DISTINCT typo, correction, string_split(correction, ' ') AS parts FROM {pairs} WHERE contains(correction, ' ')),
js AS (SELECT typo, count(*) AS cuts, min(substr(typo, 1, i) || ' ' || substr(typo, i + 1)) AS cut FROM (SELECT DISTINCT typo, unnest(range(1, length(typo))) AS i FROM (SELECT DISTINCT typo FROM jp))
       WHERE substr(typo, 1, i) IN (SELECT w FROM known) AND substr(typo, i + 1) IN (SELECT w FROM known) GROUP BY typo),
jv AS (SELECT jp.typo, jp.correction, coalesce(len(parts) = 2 AND length(jp.typo) >= 6 AND jp.typo = parts[1] || parts[2] AND d.correction = jp.correction AND jp.typo NOT IN (SELECT typo FROM cand)
              AND cuts = 1 AND cut = jp.correction AND parts[1] IN (SELECT w FROM frequent) AND parts[2] IN (SELECT w FROM frequent), false) AS ok
       FROM jp LEFT JOIN js USING (typo) LEFT JOIN documented d ON d.typo = jp.typo)"""


def word_hash(w: str, start: int, factor: int) -> str:
    """A 32-bit multiplicative hash with its avalanche, signed."""
    mask = 4294967295
    h = f"list_reduce(list_transform(range(1, length({w}) + 1), lambda i: ascii(substr({w}, i, 1))::BIGINT), lambda h, b: (h * {factor} + b) & {mask}, {start}::BIGINT)"
    a = f"list_transform([{h}], lambda h: (h + (h << 3)) & {mask})"
    b = f"list_transform({a}, lambda h: xor(h, h >> 11))"
    c = f"list_transform({b}, lambda h: (h + (h << 15)) & {mask})"
    return f"list_transform({c}, lambda h: CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)[1]"


def probes(w: str, bits: str) -> str:
    """The eight positions of a word in a filter of so many bits."""
    place = lambda start, factor: f"((({word_hash(w, start, factor)}) % {bits} + {bits}) % {bits})"
    return f"list_transform(range(0, 8), lambda k: ({place(5381, 33)} + k * {place(0, 65599)}) % {bits})"
