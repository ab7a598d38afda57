"""The Merkle manifest of `merkle.verified` as DuckDB SQL."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _tree(name: str, levels: int) -> str:
    """CTEs ``name``0 .. ``name``(levels): nodes (grp, pos, n, h) with what flanks them in a run."""
    parts = []
    for i in range(levels + 1):
        if i == 0:
            nodes = f"SELECT grp, pos, n, h FROM {name}"
        else:
            nodes = f"""
                SELECT grp, pos // 8 AS pos, (max(n) + 7) // 8 AS n,
                       CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos))
                            ELSE max(h) END AS h
                FROM {name}{i - 1} GROUP BY grp, pos // 8"""
        parts.append(f"""{name}{i} AS (
            SELECT *, coalesce(string_agg(h, '') OVER (
                          PARTITION BY grp, pos // 8 ORDER BY pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '') OVER (
                          PARTITION BY grp, pos // 8 ORDER BY pos
                          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM ({nodes}))""")
    return ",\n".join(parts)


def _climb(source: str, name: str, levels: int) -> str:
    """CTEs that carry ``source`` (grp, pos, f, proof, ..) through the tree ``name``."""
    parts = []
    for i in range(levels):
        before = source if i == 0 else f"{source}_{i - 1}"
        parts.append(f"""{source}_{i} AS (
            SELECT s.* REPLACE (
                CASE WHEN t.n > 1 THEN sha256(t.l || s.f || t.r) ELSE s.f END AS f,
                CASE WHEN t.n > 1 THEN s.proof || t.l || t.r ELSE s.proof END AS proof)
            FROM {before} s JOIN {name}{i} t ON s.grp = t.grp AND s.pos // {8 ** i} = t.pos)""")
    return ",\n".join(parts)


def merkle_sql(levels: int = 8, group_levels: int = 4) -> str:
    """Enough for 8 ** ``levels`` rows per group and 8 ** ``group_levels`` groups."""
    tampered = f"""CASE WHEN crc % 3 = 0 AND text IS NOT NULL
                   THEN translate(text, '{_UPPER}', '{_UPPER.lower()}') ELSE text END"""
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return f"""
WITH crc_table AS (  -- the table of the reflected polynomial 0xEDB88320
    SELECT list_transform(range(256), lambda n: list_reduce(
        list_concat([CAST(n AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
numbered AS (
    SELECT d.*, xor(list_reduce(list_concat([4294967295], list_transform(
               string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
               lambda c, b: xor(tab[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)),
               4294967295) AS crc
    FROM documents d, crc_table),
leaves AS (
    SELECT doc_id, coalesce('1' || lang, '0') AS grp, sha256({' || '.join(fields)}) AS h,
           sha256({' || '.join([*fields[:-1], _field('(' + tampered + ')')])}) AS changed
    FROM numbered),
t AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
           count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_tree('t', levels)},
u AS (
    SELECT '' AS grp, grp AS lang_key, h, row_number() OVER (ORDER BY grp) - 1 AS pos,
           count(*) OVER () AS n FROM t{levels}),
{_tree('u', group_levels)},
s AS (SELECT grp, pos, changed AS f, '' AS proof, doc_id, h AS leaf FROM t),
{_climb('s', 't', levels)},
v AS (
    SELECT u.grp, u.pos, s.f, s.proof, s.doc_id, s.leaf, u.h AS subroot
    FROM s_{levels - 1} s JOIN u ON s.grp = u.lang_key),
{_climb('v', 'u', group_levels)}
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, f AS folded_root,
       f = u.h AS verified
FROM v_{group_levels - 1} v, u{group_levels} u
"""
