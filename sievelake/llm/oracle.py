"""SQL that must give the rows of those queries that SQL can express on whole tables.

The others are held against brute force, round trips or held-out accuracy in tests: licence votes, packing, trained models,
nearest neighbours and token merges are no SQL.
"""

from __future__ import annotations

from sievelake.llm import chat, urls

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escapes(column: str) -> str:
    """How many characters escaping adds: one for each control string, and for each escape character."""
    controls = [f"(length({column}) - length(replace({column}, {quoted(c)}, ''))) // {len(c)}" for c in chat.CONTROL]
    return " + ".join([*controls, f"(length({column}) - length(replace({column}, chr({ord(chat.ESCAPE)}), '')))"])


def _formatted(role: str, text: str) -> str:
    marks = len(chat.TURN + chat.BODY + chat.END)
    return f"{marks} + length({role}) + (length({role}) - length(replace({role}, chr(10), ''))) + {_escapes(role)} + length({text}) + {_escapes(text)}"


def chat_sql(hostile: list[tuple[int, int, str, str]]) -> str:
    """Turns in order, hashed."""
    rows = ", ".join(f"({c}, {t}, {quoted(r)}, {quoted(x)})" for c, t, r, x in hostile)
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {rows}) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_formatted("role", "text")}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


def layouts_sql() -> str:
    """What the layouts of chat_layouts must give: rows keep their roles, arrays have theirs renamed, a prompt and its completion are two turns."""
    renamed = "CASE " + " ".join(f"WHEN role = {quoted(a)} THEN {quoted(b)}" for a, b in chat.ROLES.items()) + " ELSE role END"
    return f"""
WITH r AS (SELECT (conv_id % 5 + 5) % 5 AS layout, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT layout, CASE WHEN layout = 0 THEN role ELSE {renamed} END AS role, text FROM r WHERE layout < 3
  UNION ALL SELECT layout, 'user', role FROM r WHERE layout = 3
  UNION ALL SELECT layout, 'assistant', text FROM r WHERE layout = 3),
f AS (SELECT layout, count(*) AS n_turns, sum({_formatted("role", "text")}) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_loss FROM t GROUP BY layout)
SELECT layout, CAST(1 AS BIGINT) AS n_fingerprints, CAST(sum(CASE WHEN layout = 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_unmapped,
  CAST(coalesce(any_value(n_turns), 0) AS BIGINT) AS n_turns, CAST(coalesce(any_value(formatted_chars), 0) AS BIGINT) AS formatted_chars, CAST(coalesce(any_value(n_loss), 0) AS BIGINT) AS n_loss
FROM r LEFT JOIN f USING (layout) GROUP BY layout"""


def url_sql() -> str:
    fits = lambda r: f"((host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)}))"
    listed = sorted(urls.LISTED, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {fits(r)} THEN {quoted(r.name)}" for r in listed)
    blocked = ", ".join(quoted(r.name) for r in listed if r.verdict == "block")
    own = sorted(urls.OWN, key=lambda r: r.verdict == "block")
    rows = ", ".join(f"({k}, {quoted(r.line)}, {quoted(r.verdict)}, {quoted(urls.pattern_of(r.line))})" for k, r in enumerate(own))
    any_own = "|".join(f"(?:{urls.pattern_of(r.line)})" for r in own)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{CAPITALS}', '{SMALL}') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM a),
c AS (SELECT *, row_number() OVER () AS k, CASE {rule} END AS rule, host || translate(path, '{CAPITALS}', '{SMALL}') AS both_parts FROM b),
own(place, line, verdict, pattern) AS (VALUES {rows}),
hits AS (SELECT k, min(place) AS place FROM (SELECT * FROM c WHERE rule IS NULL AND both_parts <> '' AND regexp_matches(both_parts, {quoted(any_own)})) c JOIN own ON regexp_matches(both_parts, pattern) GROUP BY k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocked}) OR own.verdict = 'block' THEN 'block' ELSE 'allow' END AS verdict, own.line AS pattern
FROM c LEFT JOIN hits USING (k) LEFT JOIN own USING (place)"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[k:k+4], ' ') ELSE 'short ' || array_to_string(w, ' ') END AS s FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reached AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM reached r JOIN both_ways e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM reached r WHERE r.doc_id = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)"""


def codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Every round computed anew from all parts; of vectors of one length that four divides, with distinct ids."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"""p AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x
  FROM v, (SELECT unnest(range({parts})) AS part))""",
        f"b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x, min(d * {entries} + entry) % {entries} AS entry, min(d) AS d FROM
  (SELECT p.vec_id, p.label, p.part, p.x, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN b{k} b USING (part))
  GROUP BY vec_id, label, part)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM
  (SELECT part, entry, i, sum(c) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry)"""
            )
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (part, entry))")
    last = rounds
    return f"""WITH {", ".join(steps)},
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{last}) AS codebooks_sha256 FROM r"""
