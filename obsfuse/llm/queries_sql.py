"""DuckDB SQL of the corpus queries whose rows take more than a few lines to say."""

from __future__ import annotations

from obsfuse.llm.secret_scan import BASE, RULES, Rule

_WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE_SQL = f"""
    WITH d AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r
        FROM documents
    ), w AS (
        SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}')) AS term FROM d
    ), c AS (
        SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, term
    ), k AS (
        SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30
    ), v AS (
        SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
    ), g AS (
        SELECT lang, source, coalesce((SELECT sum(c.n) FROM c JOIN k USING (lang, term) WHERE c.lang = s.lang AND c.source = s.source), 0) AS total
        FROM (SELECT DISTINCT lang, source FROM d) AS s
    ), p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
               CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS BIGINT) AS p,
               CAST(1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS BIGINT) AS q
        FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
               CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term
                              WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
        FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
        UNION ALL
        SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
    )
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def _found(place: int, rule: Rule) -> str:
    """Spans of one rule: the texts between the matches give the places of the matches."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
        SELECT r, {place} AS place, '{rule.kind}' AS kind, unnest(list_transform(list_filter(list_transform(range(1, len(m) + 1),
                   lambda i: {{'at': list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
                                     + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT,
                               'size': length(m[i]), 'said': length(caught[i])}}),
                   lambda s: s.said >= {rule.least}), lambda s: {{'start': s.at, 'stop': s.at + s.size}}), recursive := true)
        FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS caught,
                     string_split_regex(text, '{pattern}') AS gaps FROM d)"""


_SPOKEN = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"
SECRETS_SQL = f"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
    ), s AS ({" UNION ALL ".join(_found(i, rule) for i, rule in enumerate(RULES))}
    ), a AS (
        SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{b.kind}') AS n_{b.kind}" for b in BASE)},
               {_SPOKEN} FILTER (WHERE place < {len(BASE)}) AS base, {_SPOKEN} AS spans
        FROM s GROUP BY r
    )
    SELECT doc_id, {", ".join(f"CAST(coalesce(n_{b.kind}, 0) AS BIGINT) AS n_{b.kind}" for b in BASE)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (r)
"""

_BYTE = "list_reduce(range(0, 8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, x))"
_CLOSED = "coalesce(list_sort(list_filter([{0}], lambda x: x.c IS NOT NULL))[1], {{'c': NULL::BIGINT, 'a': NULL::VARCHAR, 't': NULL::VARCHAR}})"


def _least(*options: str) -> str:
    """The least (cost, audit) of some struct expressions whose cost may be null."""
    return _CLOSED.format(", ".join(options))


def _step(state: str, price: str, letter: str, line: str, when: str = "true") -> str:
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {price} END, 'a': '{letter}' || {state}.a, 't': {line} || {state}.t}}"


_AFTER = {"s0": "n2", "s1": "n2", "s2": "n3", "s3": "n2"}
_ROLE = {"n2": "user", "n3": "assistant"}
_NOTHING = "{'c': NULL::BIGINT, 'a': NULL::VARCHAR, 't': NULL::VARCHAR}"


def _row(state: str) -> str:
    """Cheapest edits from ``state`` ahead of a row, without insertions ahead of it; n0..n3 are the states behind it."""
    after = _AFTER[state]
    same = state.replace("s", "n")
    initial = {"n2": "u", "n3": "a"}[after]
    options = [
        _step(same, "2", "D", "''"),
        _step(after, "keep", "K", "line", f"initial = '{initial}'"),
        _step(after, "keep + 1", "R", f"'{_ROLE[after]}:' || text || chr(10)"),
    ]
    if state == "s0":
        options.append(_step("n1", "keep", "K", "line", "initial = 's'"))
    return _least(*options)


def _with_inserts(of: dict[str, str]) -> str:
    """Columns s0..s3 of the expressions ``of``, with user and assistant rows inserted first."""
    user, answer = "'user:' || chr(10)", "'assistant:' || chr(10)"

    def put(expr: str, n: int, letters: str, line: str) -> str:
        return f"{{'c': ({expr}).c + {n}, 'a': '{letters}' || ({expr}).a, 't': {line} || ({expr}).t}}"

    return ", ".join(
        [
            f"{_least(of['s0'], put(of['s2'], 5, 'I', user), put(of['s3'], 10, 'II', f'{user} || {answer}'))} AS s0",
            f"{_least(of['s1'], put(of['s2'], 5, 'I', user), put(of['s3'], 10, 'II', f'{user} || {answer}'))} AS s1",
            f"{_least(of['s2'], put(of['s3'], 5, 'I', answer))} AS s2",
            f"{_least(of['s3'], put(of['s2'], 5, 'I', user))} AS s3",
        ]
    )


_END = "{'c': 0::BIGINT, 'a': '', 't': ''}"
REPAIR_SQL = f"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT), lambda c, x: {_BYTE}, 4294967295), 4294967295) % 20 AS draw
        FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations)
    ), damaged AS (
        SELECT conv_id, turn, copy, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM raw JOIN (SELECT unnest([1, 2]) AS copy) ON draw <> 0 AND (copy = 1 OR draw = 3)
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
               rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, substr(role, 1, 1) AS initial
        FROM damaged
    ), faulty AS (
        SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
               coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd
        FROM numbered
    ), priced AS (
        SELECT *, CASE WHEN fault IS NULL THEN 0 WHEN fault = 'truncated' THEN 5 END AS keep, role || ':' || text || chr(10) AS line FROM faulty
    ), walk AS (
        SELECT conv_id, max(i) AS i, {_with_inserts({"s0": _END, "s1": _NOTHING, "s2": _NOTHING, "s3": _END})} FROM priced GROUP BY conv_id
        UNION ALL
        SELECT conv_id, i, {_with_inserts({s: s for s in _AFTER})} FROM (
            SELECT conv_id, i - 1 AS i, {", ".join(f"{_row(s)} AS {s}" for s in _AFTER)} FROM (
                SELECT w.conv_id, w.i, w.s0 AS n0, w.s1 AS n1, w.s2 AS n2, w.s3 AS n3, p.keep, p.initial, p.text, p.line
                FROM walk AS w JOIN priced AS p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i
            )
        )
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
               count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
               count(*) FILTER (WHERE odd) AS illegal
        FROM priced GROUP BY conv_id
    )
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
           CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost,
           coalesce(s0.a, '') AS audit, sha256(coalesce(s0.t[:-2], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS c
    LEFT JOIN counted AS n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN (SELECT * FROM walk WHERE i = 0) AS w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""
