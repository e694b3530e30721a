"""SQL of the queries op11 and op13, for DuckDB."""

from __future__ import annotations

#: Levels of a group's tree and of the tree of groups that the SQL goes through: enough for 8 ** 8 rows of 8 ** 4 groups.
LEVELS, ABOVE = 8, 4

#: crc32 of the decimal doc_id, bit by bit.
_CRC = """
xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))
"""


def _levels(name: str, n: int) -> str:
    """Levels 1 to n over the nodes name0 (g, i, n, d), and the nodes of each level with what stands left and right
    of them in their runs. A group's last node goes up unchanged."""
    out = ""
    for k in range(n):
        out += f"""
{name}s{k} AS (
  SELECT g, i, n, coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WINDOW r AS (PARTITION BY g, i // 8 ORDER BY i)),
{name}{k + 1} AS (
  SELECT g, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
  FROM {name}{k} GROUP BY g, i // 8, n),"""
    return out


def _climb(name: str, n: int, g: str, i: str) -> tuple[str, str]:
    """Joins to the siblings of all levels, and the siblings in a row."""
    names = [f"{name}s{k}" for k in range(n)]
    joins = "".join(f" JOIN {s} ON {s}.g = {g} AND {s}.i = {i} // {8**k}" for k, s in enumerate(names))
    return joins, " || ".join(f"{s}.l || {s}.r" for s in names)


def _folds(name: str, n: int, start: str, prefix: str) -> str:
    """A chain of lateral columns, since each step uses the one before."""
    out, last = "", start
    for k in range(n):
        s = f"{name}s{k}"
        out += f", CASE WHEN {s}.n > 1 THEN sha256({s}.l || {last} || {s}.r) ELSE {last} END AS {prefix}{k}"
        last = f"{prefix}{k}"
    return out


def merkle() -> str:
    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    inner, inner_seen = _climb("t", LEVELS, "p.g", "p.i")
    outer, outer_seen = _climb("u", ABOVE, "0", "p.g")
    return f"""
WITH l AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g, {hashed("text")} AS leaf, {hashed(lowered)} AS changed FROM documents),
p AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
c AS (SELECT doc_id AS id, crc % 3 = 0 AS hit FROM (SELECT doc_id, {_CRC} AS crc FROM (SELECT DISTINCT doc_id FROM documents))),
t0 AS (SELECT g, i, n, leaf AS d FROM p),{_levels("t", LEVELS)}
u0 AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, d FROM t{LEVELS}),{_levels("u", ABOVE)}
f AS (
  SELECT p.doc_id, p.leaf, x.d AS subroot, y.d AS root, sha256({inner_seen} || {outer_seen}) AS proof_sha256,
         CASE WHEN coalesce(c.hit, false) THEN p.changed ELSE p.leaf END AS start{_folds("t", LEVELS, "start", "a")}{_folds("u", ABOVE, f"a{LEVELS - 1}", "b")}
  FROM p{inner}{outer} JOIN t{LEVELS} x ON x.g = p.g JOIN u{ABOVE} y ON true LEFT JOIN c ON c.id = p.doc_id)
SELECT doc_id, leaf, subroot, root, proof_sha256, b{ABOVE - 1} AS folded_root, b{ABOVE - 1} = root AS verified FROM f
"""


DECONTAMINATION = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
q AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)),
p AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM q))),
m AS MATERIALIZED (SELECT DISTINCT r, s, n, item FROM p JOIN q USING (n, words)),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
