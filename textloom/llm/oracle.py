"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from textloom.llm.license_rules import RULES as LICENCE_RULES
from textloom.llm.license_rules import SENTENCES, normalised_sentence, rule_pattern
from textloom.llm.url_templates import RULES as URL_RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def exact_dedup_sql() -> str:
    return r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r"""


def license_sql() -> str:
    known = ", ".join(
        f"({_quoted(name)}, {_quoted(normalised_sentence(s))})" for name, s in SENTENCES.items())
    rules = ", ".join(
        f"({_quoted(name)}, {_quoted(rule_pattern(ids))})" for name, ids in LICENCE_RULES)
    return rf"""
WITH known(id, sentence) AS (VALUES {known}),
rules(licence, pattern) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, string_split_regex(
    regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+') AS parts
  FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM cut),
found AS (
  SELECT p.doc_id, p.place, k.id FROM pieces p
  JOIN known k ON trim(regexp_replace(lower(p.part), '[^a-z0-9]+', ' ', 'g')) = k.sentence),
texts AS (
  SELECT doc_id, string_agg(id, ' ' ORDER BY place) AS sentences, min(place) AS first_at
  FROM found GROUP BY doc_id)
SELECT DISTINCT t.doc_id, r.licence, t.sentences, t.first_at
FROM texts t JOIN rules r ON regexp_matches(' ' || t.sentences || ' ', r.pattern)"""


def url_template_sql(
    most_children: int = 32, literal_share: float = 0.05, z: float = 2.58,
    strength: float = 10.0, prior: float = 0.1, reject_at: float = 0.5, inherit_at: float = 0.8,
) -> str:
    """The tree of path templates, one branching per step of a recursive query."""
    fits = [
        (f"(host = {_quoted(h)} OR ends_with(host, {_quoted('.' + h)})) "
         f"AND starts_with(path, {_quoted(p)})", verb, h + p)
        for verb, h, p in sorted(URL_RULES, key=lambda r: -len(r[1]) - len(r[2]))]
    rule = " ".join(f"WHEN {f} THEN {_quoted(text)}" for f, _, text in fits)
    action = " ".join(f"WHEN {f} THEN {_quoted(verb)}" for f, verb, _ in fits)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0
    THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
parsed AS (
  SELECT *, CASE {rule} END AS rule, CASE {action} END AS action,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
           lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' ELSE s END) AS segments
  FROM parts),
paths AS (
  SELECT host, segments, count(*)::DOUBLE AS pages,
         coalesce(sum((action = 'block')::BIGINT), 0)::DOUBLE AS rejected,
         count(action)::DOUBLE AS labelled
  FROM parsed GROUP BY host, segments),
hosts AS (
  SELECT host, regexp_extract(host, '[^.]*$') AS top, sum(rejected) AS r, sum(labelled) AS n
  FROM paths GROUP BY host),
tops AS (
  SELECT top, (sum(r) + {strength} * (SELECT (sum(r) + {strength * prior}) / (sum(n) + {strength})
    FROM hosts)) / (sum(n) + {strength}) AS above
  FROM hosts GROUP BY top),
t AS (
  SELECT p.host, p.segments, p.segments AS rest, p.pages, p.rejected, p.labelled, '' AS template,
         h.n AS evidence, (h.r + {strength} * o.above) / (h.n + {strength}) AS purity,
         false AS done
  FROM paths p JOIN hosts h ON p.host = h.host JOIN tops o ON h.top = o.top
  UNION ALL (
  WITH live AS (SELECT * FROM t WHERE NOT done),
  prefix AS (
    SELECT host, template, coalesce(list_min(list_filter(range(1, len(min(rest)) + 1),
      lambda i: min(rest)[i] IS DISTINCT FROM max(rest)[i])) - 1, len(min(rest))) AS shared
    FROM live GROUP BY host, template),
  stepped AS (
    SELECT l.host, l.segments, l.pages, l.rejected, l.labelled, l.evidence, l.purity,
           l.template || array_to_string(
             list_transform(l.rest[1:p.shared], lambda s: '/' || s), '') AS template,
           l.rest[p.shared + 1:] AS rest, l.rest[p.shared + 1] AS segment
    FROM live l JOIN prefix p ON l.host = p.host AND l.template = p.template),
  children AS (
    SELECT host, template, segment, sum(pages) AS pages, sum(rejected) AS rejected,
           sum(labelled) AS labelled, min(purity) AS above FROM stepped GROUP BY ALL),
  named AS (
    SELECT *, count(*) OVER p AS ways,
      CASE WHEN count(segment) OVER p > {most_children} AND segment IS NOT NULL
      AND pages < sum(CASE WHEN segment IS NOT NULL THEN pages END) OVER p * {literal_share}
      THEN '*' ELSE segment END AS label
    FROM children WINDOW p AS (PARTITION BY host, template)),
  branches AS (
    SELECT host, template, label, sum(rejected) AS rejected, sum(labelled) AS labelled,
           min(above) AS above
    FROM named GROUP BY ALL),
  lagged AS (
    SELECT *, lag(rejected) OVER w AS r0, lag(labelled) OVER w AS n0,
           lag(label IS NULL) OVER w AS x0
    FROM branches
    WINDOW w AS (PARTITION BY host, template, labelled > 0
      ORDER BY (rejected + 1) / (labelled + 2), label NULLS FIRST)),
  grouped AS (
    SELECT *, sum(CASE WHEN n0 IS NULL OR labelled = 0 OR label IS NULL OR x0
      OR abs(rejected / labelled - r0 / n0) > {z} * sqrt((r0 + rejected) / (n0 + labelled)
        * (1 - (r0 + rejected) / (n0 + labelled)) * (1 / n0 + 1 / labelled)) THEN 1 ELSE 0 END)
      OVER (PARTITION BY host, template, labelled > 0
        ORDER BY (rejected + 1) / (labelled + 2), label NULLS FIRST) AS branch
    FROM lagged),
  merged AS (
    SELECT host, template, label,
           coalesce(array_to_string(
             list_sort(list_filter(list(label) OVER w, lambda x: x IS NOT NULL)), '|'), '') AS name,
           sum(labelled) OVER w AS evidence,
           (sum(rejected) OVER w + {strength} * above) / (sum(labelled) OVER w + {strength})
             AS purity
    FROM grouped WINDOW w AS (PARTITION BY host, template, labelled > 0, branch))
  SELECT s.host, s.segments, s.rest[2:] AS rest, s.pages, s.rejected, s.labelled,
         CASE WHEN s.segment IS NULL THEN s.template ELSE s.template || '/' || m.name END
           AS template,
         CASE WHEN c.ways = 1 THEN s.evidence ELSE m.evidence END AS evidence,
         CASE WHEN c.ways = 1 THEN s.purity ELSE m.purity END AS purity,
         s.segment IS NULL AS done
  FROM stepped s
  JOIN named c ON s.host = c.host AND s.template = c.template
    AND s.segment IS NOT DISTINCT FROM c.segment
  JOIN merged m ON c.host = m.host AND c.template = m.template
    AND c.label IS NOT DISTINCT FROM m.label))
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.action, CASE WHEN t.purity >= CASE WHEN t.evidence > 0 THEN {reject_at}
         ELSE {inherit_at} END THEN 'block' ELSE 'allow' END) AS verdict,
       t.template, t.evidence::BIGINT AS evidence, t.purity
FROM parsed p JOIN t ON t.done AND p.host = t.host AND p.segments = t.segments"""
