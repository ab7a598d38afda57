"""The named queries once more, as plain SQL over the given tables.

Written independently of the Spark code for comparison; shared parts are named
sub-selects that each statement pulls in as needed.
"""

from __future__ import annotations

WS = (
    "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '"
    "||chr(133)||chr(160)||chr(8232)||chr(8233)||chr(12288))"
)
NL = "chr(10)"


def uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'"
        f"||substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h},17,1)), 1)"
        f"||substr({h},18,3)||'-'||substr({h},21,12))"
    )


def pick(cases: tuple[str, ...], index: str) -> str:
    return "(CASE " + " ".join(
        f"WHEN {index} = {i} THEN '{c}'" for i, c in enumerate(cases)
    ) + " END)"


MODELS = ("gpt-4o-mini", "gpt-4o", "gpt-6-luna", "gpt-5.6-luna", "unlisted-model")
NOW = "TIMESTAMP '2000-06-01 00:00:00'"

HEAD = r"^ {0,3}#{1,6}[ \t]+"
LIST = r"^ {0,3}(?:[-*+]|[0-9]+[.)])[ \t]+"
QUOTE = r"^ {0,3}>[ \t]?"

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), "SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS k, text, lang FROM documents"),
    "md": (("docs",), rf"""
        SELECT id, k, array_to_string(list_transform(string_split(text, {NL}), lambda x, i:
          CASE (i - 1) % 10
            WHEN 0 THEN repeat('#', CAST(1 + ((i - 1) // 10) % 6 AS BIGINT)) || ' ' || x
            WHEN 2 THEN '- ' || x
            WHEN 3 THEN '  > ' || x
            WHEN 4 THEN '| ' || x || ' |  | x\|y | '
            WHEN 5 THEN '| --- | :---: |' || {NL} || x
            WHEN 6 THEN '12) ' || x
            WHEN 7 THEN '```sql' || {NL} || x || {NL} || '``' || {NL} || '````'
            WHEN 8 THEN '   ' || x || '  '
            WHEN 9 THEN x || chr(13)
            ELSE x END), {NL}) AS text FROM docs"""),
    "md_lines": (("md",), f"""
        SELECT id AS document_id, CAST(p AS BIGINT) AS line, rtrim(x, chr(13)) AS content,
          CASE WHEN ends_with(x, chr(13)) THEN chr(13) ELSE '' END
          || CASE WHEN p < n THEN {NL} ELSE '' END AS ending
        FROM (SELECT id, unnest(string_split(text, {NL})) AS x,
                unnest(range(1, len(string_split(text, {NL})) + 1)) AS p,
                len(string_split(text, {NL})) AS n FROM md)
        WHERE NOT (p = n AND x = '')"""),
    "md_open": (("md_lines",), """
        SELECT * FROM (SELECT *,
          sum(CASE WHEN content = '```sql' THEN 1 ELSE 0 END)
            OVER (PARTITION BY document_id ORDER BY line)
          - coalesce(sum(CASE WHEN content = '````' THEN 1 ELSE 0 END) OVER (PARTITION BY
            document_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS fenced FROM md_lines) WHERE fenced = 0"""),
    "md_kinds": (("md_lines",), rf"""
        SELECT *, CASE WHEN regexp_matches(content, '{HEAD}') THEN 'heading'
          WHEN regexp_matches(content, '{LIST}') THEN 'list_item'
          WHEN regexp_matches(content, '{QUOTE}') THEN 'quote' ELSE 'paragraph' END AS kind,
          CASE WHEN regexp_matches(content, '{HEAD}') THEN regexp_extract(content, '{HEAD}')
          WHEN regexp_matches(content, '{LIST}') THEN regexp_extract(content, '{LIST}')
          WHEN regexp_matches(content, '{QUOTE}') THEN regexp_extract(content, '{QUOTE}')
          ELSE substr(content, 1, length(content) - length(ltrim(content, {WS}))) END AS prefix
        FROM md_lines"""),
    "md_affixes": (("md_kinds",), f"""
        SELECT document_id, line, kind, prefix,
          trim(substr(content, length(prefix) + 1), {WS}) AS source_text,
          CASE WHEN trim(substr(content, length(prefix) + 1), {WS}) = ''
            THEN substr(content, length(prefix) + 1)
            ELSE substr(content, length(rtrim(content, {WS})) + 1) END AS suffix
        FROM md_kinds"""),
    "md_rows": (("md_lines",), rf"""
        SELECT document_id, line, content, c AS cells FROM (
          SELECT *, list_transform(string_split(replace(trim(content, ' '||chr(9)), '\|', chr(1)),
            '|')[2:-2], lambda x: replace(x, chr(1), '\|')) AS c FROM md_lines
          WHERE starts_with(trim(content, ' '||chr(9)), '|')
            AND ends_with(trim(content, ' '||chr(9)), '|')
            AND length(trim(content, ' '||chr(9))) > 1)
        WHERE len(list_filter(c, lambda x: NOT regexp_full_match(trim(x, {WS}),
          ':?-{{3,}}:?'))) > 0"""),
    "md_cells": (("md_rows",), """
        SELECT document_id, line, content, CAST(len(cells) AS BIGINT) AS columns,
          unnest(cells) AS cell, CAST(unnest(range(0, len(cells))) AS BIGINT) AS "column"
        FROM md_rows"""),
    "md_blocks": (("md_open", "md_kinds", "md_affixes", "md_cells"), rf"""
        SELECT document_id,
          row_number() OVER (PARTITION BY document_id ORDER BY line, coalesce("column", 0)) - 1
            AS seq, * EXCLUDE (document_id) FROM (
          SELECT a.document_id, a.line, a.kind, a.prefix, a.suffix, a.source_text,
            CASE WHEN a.kind = 'heading' THEN CAST(length(regexp_extract(o.content,
              '^ {{0,3}}(#{{1,6}})', 1)) AS BIGINT) END AS level,
            CASE WHEN a.kind = 'list_item' THEN regexp_extract(o.content,
              '^ {{0,3}}([-*+]|[0-9]+[.)])', 1) END AS marker,
            CAST(NULL AS BIGINT) AS "column", CAST(NULL AS BIGINT) AS columns
          FROM md_affixes a JOIN md_open o USING (document_id, line)
          WHERE a.source_text <> '' AND NOT (starts_with(trim(o.content, ' '||chr(9)), '|')
            AND ends_with(trim(o.content, ' '||chr(9)), '|')
            AND length(trim(o.content, ' '||chr(9))) > 1)
          UNION ALL
          SELECT c.document_id, c.line, 'table_cell',
            CASE WHEN "column" = 0 THEN regexp_extract(c.content, '^[ \t]*') ELSE '' END || '|'
              || CASE WHEN trim(cell, {WS}) = '' THEN cell
                 ELSE substr(cell, 1, length(cell) - length(ltrim(cell, {WS}))) END,
            CASE WHEN trim(cell, {WS}) = '' THEN ''
              ELSE substr(cell, length(rtrim(cell, {WS})) + 1) END
              || CASE WHEN "column" = columns - 1
                 THEN '|' || regexp_extract(c.content, '[ \t]*$') ELSE '' END,
            trim(cell, {WS}), NULL, NULL, "column", columns
          FROM md_cells c JOIN md_open o USING (document_id, line))"""),
    "blocks": (("docs",), f"""
        SELECT document_id, k, lang, seq, source_text, sha256(source_text) AS source_hash,
          {uuid5("document_id || ':' || seq")} AS id
        FROM (SELECT id AS document_id, k, lang, trim(x, {WS}) AS source_text,
            row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS seq
          FROM (SELECT id, k, lang, unnest(string_split(text, {NL})) AS x,
                  unnest(range(1, len(string_split(text, {NL})) + 1)) AS p FROM docs)
          WHERE trim(x, {WS}) <> '')"""),
    "turns": ((), """
        SELECT CAST(conv_id AS VARCHAR) AS document_id, turn AS seq, conv_id AS k,
          conv_id || ':' || turn AS id, CASE WHEN role = 'system' THEN '' ELSE text END
          AS source_text FROM conversations"""),
    "keyword_table": ((), """
        SELECT DISTINCT trim(w) AS w, replace(lower(trim(w)), 'ß', 'ss') AS l FROM (
          SELECT unnest(list_append(list_filter(s, lambda x: length(x) >= 8),
                   array_to_string(s[1:6], ' '))) AS w
          FROM (SELECT string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS s FROM benchmark))
        WHERE length(trim(w)) BETWEEN 1 AND 200"""),
    "turn_batch": (("turns",), """
        SELECT id, seq, source_text, sha256(source_text) AS h FROM turns"""),
    "turn_memory": (("turn_batch", "blocks"), """
        SELECT h, min('[de] ' || source_text) AS t FROM (
          SELECT source_hash AS h, source_text FROM blocks
          UNION ALL SELECT h, source_text FROM turn_batch WHERE seq = 0) GROUP BY h"""),
    "analyses": ((), """
        SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id AS k, lang AS source_language,
          'general' AS domain, CASE WHEN toxic = 1 THEN 'informal' ELSE 'neutral' END AS register,
          ['Term' || (doc_id % 7), 'Shared'] AS terms,
          CASE WHEN quality = 0 THEN ['heuristic'] ELSE [] END AS warnings,
          CASE WHEN quality = 1 THEN 'ok' ELSE 'degraded' END AS triage_status,
          (300 + doc_id % 50) / 1e6 AS cost_usd_total, 300 + doc_id % 50 AS tokens_in_total,
          60 + doc_id % 10 AS tokens_out_total
        FROM labels JOIN documents USING (doc_id)"""),
    "jobs": ((), f"""
        SELECT *, CASE WHEN status = 'failed' THEN {pick(
            ("provider_timeout", "render_failed", "never_catalogued"), "k % 3")} END AS error_code,
          CASE WHEN status IN ('running', 'assembling') AND k % 7 > 0
            THEN created_at + INTERVAL 1 HOUR END AS lease_expires_at
        FROM (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS c,
          CAST(o_custkey AS VARCHAR) AS document_id,
          (o_custkey % 50) || '.' || (o_orderkey % 3) AS batch_id,
          {pick(("de", "fr", "es", "uk"), "o_orderkey % 4")} AS target_language,
          CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'failed'
            WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 1 THEN 'completed_with_errors'
            WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'queued'
            WHEN o_orderkey % 3 = 0 THEN 'assembling' ELSE 'running' END AS status,
          3 + o_orderkey % 5 AS total_chunks, o_orderkey % 4 AS done_chunks,
          o_orderkey % 11 AS hits, o_orderkey % 6 AS misses,
          {pick(MODELS, "o_orderkey % 5")} AS model, o_totalprice AS cost_usd,
          'key-' || (o_orderkey % 9000) AS idempotency_key, o_orderdate AS created_at
          FROM orders)"""),
    "chunks": ((), """
        SELECT *, CASE WHEN status = 'inflight' AND supp % 3 > 0 THEN created_at END AS lease
        FROM (SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS job_id,
          l_linenumber - 1 AS seq, min(l_shipdate) AS created_at, min(l_suppkey) AS supp,
          CASE WHEN min(l_linestatus) = 'F' THEN 'done' WHEN min(l_suppkey) % 2 = 0
            THEN 'inflight' ELSE 'pending' END AS status
          FROM lineitem GROUP BY l_orderkey, l_linenumber)"""),
    "log": ((), """
        SELECT l_orderkey || '-' || l_linenumber AS chunk_id,
          CAST(l_quantity * 10 AS BIGINT) AS tokens_in, CAST(l_quantity AS BIGINT) AS tokens_out,
          l_extendedprice / 1e6 AS cost_usd, l_partkey * 7 % 20011 AS latency_ms,
          CASE l_returnflag WHEN 'N' THEN 'ok' WHEN 'A' THEN 'retryable_error'
            ELSE 'fatal_error' END AS outcome, l_shipdate AS created_at,
          l_partkey || '/' || l_suppkey || '/' || CAST(l_quantity AS BIGINT) || '/'
            || CAST(trunc(l_extendedprice * 100) AS BIGINT) AS id
        FROM lineitem"""),
    "attempts": (("log",), """
        SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at, id) AS attempt_no
        FROM log"""),
    "seen": ((), """
        SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS job_id, event_id, user_id, ts,
          CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done'
            WHEN 'error' THEN 'failed' ELSE 'running' END AS status, value AS cost_usd
        FROM events"""),
    "keys": (("docs",), """
        SELECT document_id, k, lang, target, sha256('["' || target
          || '","gpt-4o-mini","v1","' || sha256('{}') || '","' || sha256(
          '{"domain":"general","register":"neutral","source_language":"' || lang
          || '","terms":[],"triage_status":"ok","warnings":[]}') || '"]') AS translation_key
        FROM (SELECT id AS document_id, k, lang, unnest(['de', 'uk']) AS target FROM docs)"""),
    "keyed": (("blocks", "keys"), """
        SELECT b.document_id, b.k, b.lang, b.seq, b.source_text, b.source_hash, y.target,
          y.translation_key FROM blocks b JOIN keys y USING (document_id)"""),
    "memory": (("keyed",), """
        SELECT translation_key, source_hash, '[de] ' || min(source_text) AS translated_text
        FROM keyed WHERE k % 2 = 0 AND target = 'de' GROUP BY ALL"""),
    "missing": (("keyed", "memory"), """
        SELECT * FROM keyed ANTI JOIN memory USING (translation_key, source_hash)"""),
    "units": (("missing",), """
        SELECT translation_key, source_hash, min(source_text) AS source_text,
          min(target) AS target FROM missing GROUP BY ALL"""),
    "pages_files": ((), f"""
        SELECT page_id AS upload_no,
          replace(string_split(url, '//')[-1], '.', '-') || 'p' || {pick((".md", ".pdf", ".docx", "", ".exe", ".MD"),
                                                "page_id % 6")} AS filename,
          {pick(("md", "pdf", "docx", "", "exe", "md"), "page_id % 6")} AS given,
          (CASE WHEN page_id % 6 = 1 AND page_id % 4 = 1 THEN encode('%PDF-')
            WHEN page_id % 6 = 2 THEN encode('PK') || '\\x03\\x04'::BLOB
            WHEN page_id % 6 = 3 AND page_id % 2 = 1 THEN encode('%PDF-') ELSE ''::BLOB END)
          || encode(html) || (CASE WHEN page_id % 30 = 0 THEN '\\xFF'::BLOB
            WHEN page_id % 42 = 5 THEN '\\x00'::BLOB ELSE ''::BLOB END) AS content,
          page_id % 6 AS kind, page_id % 30 = 0 AS broken, page_id % 30 <> 0
            AND page_id % 42 = 5 AS nul FROM pages"""),
    "tracked": ((), f"""
        SELECT CAST(doc_id AS VARCHAR) AS id, {pick(
            ("uploaded", "analyzing", "extracted", "failed"), "doc_id % 4")} AS status
        FROM documents"""),
    "req": ((), """
        SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id AS request_no,
          'req-' || (doc_id % 400) AS request_key,
          CASE WHEN doc_id % 29 > 0 THEN [lang, 'pt-br', source || '-strasse'] END AS languages
        FROM documents"""),
    "fanned": (("req",), """
        SELECT document_id, request_no, request_key, languages, unnest(languages) AS
          target_language, unnest(range(0, len(languages))) AS position FROM req"""),
    "keyed_req": (("fanned",), """
        SELECT *, sha256(request_key) || '.' || sha256('["' || array_to_string(
          list_sort(languages), '","') || '"]') AS batch_id,
          sha256(request_key) || '.' || sha256(encode(request_key) || '\\x00'::BLOB
            || encode(target_language)) AS idempotency_key FROM fanned"""),
    "usage": ((), f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 100 - 20 END AS tokens_in,
          l_suppkey % 40 - 5 AS tokens_out, {pick(MODELS, "l_partkey % 5")} AS model,
          l_partkey % 30 - 2 AS cached FROM lineitem"""),
    "prices": ((), """
        SELECT * FROM (VALUES ('gpt-4o-mini', 0.15::DOUBLE, 0.075::DOUBLE, 0.6::DOUBLE),
          ('gpt-4o', 2.5, 1.25, 10.0), ('gpt-6-luna', 0.1, 0.01, 0.5),
          ('gpt-5.6-luna', 0.2, 0.02, 1.2)) AS p(model, pin, pcached, pout)"""),
    "links": (("jobs", "chunks", "blocks"), """
        SELECT c.id AS chunk_id, b.id AS block_id, b.seq // 5 AS seq_in_chunk, j.id AS job_id,
          b.seq AS block_seq, b.source_text, j.document_id
        FROM chunks c JOIN jobs j ON c.job_id = j.id
        JOIN blocks b ON b.document_id = j.document_id AND b.seq % 5 = c.seq % 5"""),
    "rendered": (("md_blocks", "docs"), rf"""
        SELECT b.document_id, b.seq, b.line, b."column", b.kind, t.target, s.translated_text,
          b.kind = 'table_cell' AND b.source_text = '' AS passthrough,
          CASE WHEN s.translated_text IS NULL AND b.kind <> 'table_cell' THEN NULL
            WHEN s.translated_text IS NULL OR b.source_text = '' AND b.kind = 'table_cell'
              THEN b.prefix || b.source_text || b.suffix
            WHEN b.kind = 'table_cell' THEN b.prefix || replace(replace(s.translated_text, {NL},
              ' '), '|', '') || CASE WHEN b."column" < b.columns - 1 OR contains(b.suffix, '|')
              THEN '\' ELSE '' END || b.suffix
            ELSE b.prefix || replace(s.translated_text, {NL}, ' ') || b.suffix END AS rendered
        FROM md_blocks b CROSS JOIN (SELECT unnest(['de', 'uk']) AS target) t
        LEFT JOIN (SELECT h, target, '[' || target || ']' || {NL} || x || ' a|b\'
            AS translated_text FROM (SELECT sha256(source_text) AS h, min(source_text) AS x
              FROM md_blocks WHERE seq % 4 > 0 GROUP BY ALL)
            CROSS JOIN (SELECT unnest(['de', 'uk']) AS target)) s
          ON s.h = sha256(b.source_text) AND s.target = t.target"""),
    "new_lines": (("md_lines", "rendered"), """
        SELECT l.document_id, t.target, l.line, coalesce(r.content, l.content) AS content,
          l.ending FROM md_lines l JOIN (SELECT DISTINCT document_id, target FROM rendered) t
          USING (document_id)
        LEFT JOIN (SELECT document_id, target, line,
            string_agg(rendered, '' ORDER BY coalesce("column", 0)) AS content FROM rendered
            WHERE rendered IS NOT NULL GROUP BY ALL) r USING (document_id, target, line)"""),
    "mixed": (("blocks",), r"""
        SELECT document_id, k, seq, source_text AS plain, CASE WHEN k % 6 = 0 THEN
            translate(source_text, 'abcdehiklmnoprstu', 'абцдехіклмнопрсту')
          WHEN k % 6 = 3 AND seq % 4 > 0 THEN
            translate(source_text, 'abcdehiklmnoprstu', 'абцдехиклмнопрсту')
          ELSE source_text END AS base,
          CASE WHEN (k + seq) % 5 = 0 THEN chr(8203) || chr(917761)
            WHEN (k + seq) % 7 = 0 THEN chr(7) || chr(65039) || '漢字'
            WHEN (k + seq) % 11 = 0 THEN chr(173) || chr(9) || 'عرب' ELSE '' END AS noise,
          CASE WHEN (k + seq) % 5 = 0 THEN '' WHEN (k + seq) % 7 = 0 THEN '漢字'
            WHEN (k + seq) % 11 = 0 THEN chr(9) || 'عرب' ELSE '' END AS kept FROM blocks"""),
    "scripts": (("mixed",), r"""
        SELECT document_id, CAST(sum(length(regexp_replace(t, '[^\x{0400}-\x{04ff}]', '', 'g')))
            AS BIGINT) AS cyrillic,
          CAST(sum(length(regexp_replace(t, '[^A-Za-zß]', '', 'g'))) AS BIGINT) AS latin,
          CAST(sum(length(regexp_replace(t, '[^\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]', '', 'g')))
            AS BIGINT) AS cjk,
          CAST(sum(length(regexp_replace(t, '[^\x{0600}-\x{06ff}]', '', 'g'))) AS BIGINT) AS arabic
        FROM (SELECT document_id, base || noise AS t FROM mixed) GROUP BY ALL"""),
    "sample": (("blocks",), """
        SELECT document_id, seq, substr(source_text, 1, CAST(20000 - before AS BIGINT)) AS t
        FROM (SELECT *, coalesce(sum(length(source_text)) OVER (PARTITION BY document_id
          ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks)
        WHERE before < 20000"""),
    "block_json": (("blocks",), """
        SELECT document_id, seq, '{"seq":' || seq || ',"source_text":'
          || CAST(to_json(source_text) AS VARCHAR) || '}' AS j FROM blocks"""),
    "payloads": (("block_json",), """
        SELECT b.document_id, b.seq, b.j, CAST(0 AS BIGINT) AS payload_no, length(b.j) + 1 AS fill
        FROM block_json b WHERE b.seq = 0
        UNION ALL
        SELECT b.document_id, b.seq, b.j,
          p.payload_no + CASE WHEN p.fill + length(b.j) + 1 > 15999 THEN 1 ELSE 0 END,
          CASE WHEN p.fill + length(b.j) + 1 > 15999 THEN 0 ELSE p.fill END + length(b.j) + 1
        FROM payloads p JOIN block_json b ON b.document_id = p.document_id
          AND b.seq = p.seq + 1"""),
    "packed": (("blocks",), """
        SELECT b.document_id, b.seq, b.source_text, CAST(0 AS BIGINT) AS chunk_seq,
          length(b.source_text) AS fill, CAST(0 AS BIGINT) AS seq_in_chunk
        FROM blocks b WHERE b.seq = 0
        UNION ALL
        SELECT b.document_id, b.seq, b.source_text,
          p.chunk_seq + CASE WHEN p.fill + length(b.source_text) > 1000 THEN 1 ELSE 0 END,
          CASE WHEN p.fill + length(b.source_text) > 1000 THEN 0 ELSE p.fill END
            + length(b.source_text),
          CASE WHEN p.fill + length(b.source_text) > 1000 THEN 0 ELSE p.seq_in_chunk + 1 END
        FROM packed p JOIN blocks b ON b.document_id = p.document_id AND b.seq = p.seq + 1"""),
    "sides": (("turns",), """
        SELECT u.document_id, u.chunk_seq,
          (SELECT max(t.seq) FROM turns t WHERE t.document_id = u.document_id
            AND t.seq < u.lo AND t.source_text <> '') AS before_seq,
          (SELECT min(t.seq) FROM turns t WHERE t.document_id = u.document_id
            AND t.seq > u.hi AND t.source_text <> '') AS after_seq
        FROM (SELECT document_id, seq // 2 AS chunk_seq, min(seq) AS lo, max(seq) AS hi
          FROM turns GROUP BY ALL) u"""),
    "turn_json": (("turns",), """
        SELECT document_id, seq, id, source_text, '{"seq":' || seq || ',"block_id":"' || id
          || '","source_text":' || CAST(to_json(source_text) AS VARCHAR) || '}' AS j FROM turns"""),
    "retry": (("jobs", "chunks", "attempts"), """
        SELECT c.job_id, c.id AS chunk_id, c.seq,
          CASE WHEN date_diff('day', DATE '1970-01-01', CAST(c.created_at AS DATE)) % 30 IN
            (SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) % 20
             FROM orders) THEN 'done' ELSE 'pending' END AS status, coalesce(a.top, 0) AS top
        FROM chunks c JOIN jobs j ON j.id = c.job_id
        LEFT JOIN (SELECT chunk_id, max(attempt_no) AS top FROM attempts GROUP BY ALL) a
          ON a.chunk_id = c.id
        WHERE j.status IN ('failed', 'completed_with_errors') AND j.cost_usd < 300000
          AND j.id NOT IN (SELECT job_id FROM chunks WHERE status = 'inflight'
            AND lease > TIMESTAMP '2000-06-01 00:00:00')"""),
    "results": (("turns",), """
        SELECT document_id AS chunk_id, CASE WHEN k % 11 = 0 AND seq = 0 THEN id || 'x' ELSE id
            END AS block_id, k % 13 = 0 AND seq = 0 AS other_model,
          k % 17 = 0 AND seq = 0 AS untold, k % 19 = 0 AND seq = 0 AS bad_usage,
          CASE WHEN k % 9 = 0 AND seq = 0 THEN 2 WHEN k % 7 = 0 AND seq = 1 THEN 0 ELSE 1 END AS n
        FROM turns"""),
    "clean": (("usage",), """
        SELECT *, greatest(coalesce(tokens_in, 0), 0) AS tin, greatest(tokens_out, 0) AS tout,
          greatest(cached, 0) AS tcached FROM usage"""),
    "ranked": ((), """
        SELECT CAST(l_orderkey AS VARCHAR) AS job_id, floor(l_extendedprice) AS estimate_usd,
          CAST(epoch(l_shipdate) AS BIGINT) * 4000000 + l_partkey * 1000 + l_linenumber * 100
            + CAST(l_quantity AS BIGINT) % 100 AS seq FROM lineitem"""),
    "queue": (("ranked",), """
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS place FROM ranked"""),
    "walk": (("queue",), """
        SELECT job_id, seq, place, estimate_usd, estimate_usd <= 120000 AS admitted,
          CASE WHEN estimate_usd <= 120000 THEN estimate_usd ELSE 0 END AS spent
        FROM queue WHERE place = 1
        UNION ALL
        SELECT q.job_id, q.seq, q.place, q.estimate_usd, w.spent + q.estimate_usd <= 120000,
          w.spent + CASE WHEN w.spent + q.estimate_usd <= 120000 THEN q.estimate_usd ELSE 0 END
        FROM walk w JOIN queue q ON q.job_id = w.job_id AND q.place = w.place + 1"""),
    "saves": ((), """
        SELECT CAST(user_id AS VARCHAR) AS document_id, event_id AS save_no, ts AS saved_at,
          CASE WHEN event_id % 5 = 0 THEN 'ok' ELSE 'degraded' END AS triage_status,
          CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 50 END AS tokens_in,
          CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 20 END AS tokens_out,
          CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE (event_id % 50) / 64 END AS cost_usd
        FROM events WHERE user_id % 4 <> 0 OR ts <= TIMESTAMP '2024-01-01'
          + to_days(CAST(user_id % 20 AS INTEGER))"""),
    "applied": (("saves",), """
        SELECT s.* FROM saves s LEFT JOIN (SELECT document_id, min(save_no) AS ok_no FROM saves
          WHERE triage_status = 'ok' GROUP BY ALL) o USING (document_id)
        WHERE ok_no IS NULL OR save_no <= ok_no OR (triage_status = 'ok'
          AND NOT (tokens_in = 0 AND tokens_out = 0 AND cost_usd = 0))"""),
    "damaged": (("md_blocks",), """
        SELECT document_id, kind, "column", prefix, suffix,
          CASE WHEN CAST(document_id AS BIGINT) % 7 = 0 THEN 2 ELSE columns END AS columns,
          CASE WHEN CAST(document_id AS BIGINT) % 11 = 0 AND seq = 1 THEN line - 1
            WHEN CAST(document_id AS BIGINT) % 13 = 0 AND seq = 2 THEN 0 ELSE line END AS line
        FROM md_blocks WHERE NOT (CAST(document_id AS BIGINT) % 5 = 0
          AND coalesce("column", 0) = 1)"""),
    "pair_text": (("turns",), r"""
        SELECT id AS pair_id, unnest([1, 0]) AS c, unnest([0, 1]) AS r,
          unnest([regexp_replace(translate(source_text, 'aeiou', 'aaiou'), '\s+', '', 'g'),
            regexp_replace(source_text, '\s+', '', 'g')]) AS t FROM turns"""),
    "pair_grams": (("pair_text",), """
        SELECT pair_id, n, gram, sum(c) AS c, sum(r) AS r FROM (
          SELECT pair_id, n, c, r, substr(t, i, n) AS gram FROM (
            SELECT pair_id, n, c, r, t, unnest(range(1, length(t) - n + 2)) AS i
            FROM pair_text CROSS JOIN (SELECT unnest(range(1, 7)) AS n) WHERE length(t) >= n))
        GROUP BY ALL"""),
    "feed": (("seen",), """
        SELECT job_id, event_id, status, CASE WHEN status = 'failed' THEN 'error'
          WHEN status = 'done' THEN 'done' WHEN last IS NULL OR last <> status THEN 'status'
          ELSE 'progress' END AS event FROM (
          SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS last,
            coalesce(sum(CASE WHEN status IN ('done', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION
              BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS ended FROM seen) WHERE ended = 0"""),
}


def compose(body: str) -> str:
    """Prefix a statement with the shared parts it names, in dependency order."""
    import re

    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in PARTS[name][0]:
            need(other)
        ordered.append(name)

    for name in PARTS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
            need(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS ({PARTS[n][1].strip()})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{body.strip()}"


RAW: dict[str, str] = {
    "translation_backlog_cost": """
        SELECT lang, target, hits, misses, new_units, tokens_in, round((tokens_in * 0.15 + tokens_in * 0.6) / 1e6, 8) AS price_usd FROM (
        SELECT lang, target, CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS hits,
          CAST(sum(CASE WHEN hit THEN 0 ELSE n END) AS BIGINT) AS misses,
          count(*) FILTER (NOT hit) AS new_units,
          CAST(sum(CASE WHEN hit THEN 0 ELSE chars END) AS BIGINT) AS tokens_in
        FROM (SELECT q.*, m.translated_text IS NOT NULL AS hit FROM
          (SELECT lang, target, translation_key, source_hash, count(*) AS n,
             length(min(source_text)) AS chars FROM keyed GROUP BY ALL) q
          LEFT JOIN memory m USING (translation_key, source_hash)) GROUP BY ALL)""",
    "sniff_format": """
        SELECT upload_no, given AS suffix, CASE WHEN kind IN (0, 5) THEN
            CASE WHEN NOT broken AND NOT nul THEN 'md' END
          WHEN kind = 1 THEN CASE WHEN upload_no % 4 = 1 THEN 'pdf' END
          WHEN kind = 2 THEN 'docx'
          WHEN kind = 3 THEN CASE WHEN upload_no % 2 = 1 THEN 'pdf' END END AS format
        FROM pages_files""",
    "valid_text": """
        SELECT upload_no, NOT broken AND NOT nul AS valid FROM pages_files""",
    "sanitize_filename": """
        SELECT page_id, trim(regexp_replace(replace(url, '/', '~'), '[^A-Za-z0-9._ -]', '_', 'g'),
          ' .') AS safe,
          CASE WHEN length(s) > 200 THEN substr(s, 1, 177) || '.Md' ELSE s END AS safe_long
        FROM (SELECT *, trim(regexp_replace(repeat(replace(url, '/', 'é'), 7) || '.Md',
          '[^A-Za-z0-9._ -]', '_', 'g'), ' .') AS s FROM pages)""",
    "content_id": "SELECT upload_no, sha256(content) AS id FROM pages_files",
    "dedup_documents": """
        SELECT id, upload_no, CASE WHEN upload_no % 7 = 0 THEN 'docx' ELSE 'md' END AS format
        FROM (SELECT sha256(text) AS id, min(doc_id) AS upload_no FROM documents GROUP BY ALL)""",
    "format_conflicts": """
        SELECT sha256(text) AS id, count(*) AS uploads FROM documents GROUP BY ALL
        HAVING count(DISTINCT doc_id % 7 = 0) > 1""",
    "admit": """
        SELECT upload_no, CAST(b AS BIGINT) AS text_bytes, CASE
          WHEN octet_length(content) > 52428800 THEN 'size_limit'
          WHEN given NOT IN ('docx', 'md', 'pdf') THEN 'unsupported_format'
          WHEN (kind IN (0, 5) AND (broken OR nul)) OR (kind = 1 AND upload_no % 4 <> 1)
            THEN 'corrupt_file'
          WHEN kind = 1 AND b = 0 THEN 'scanned_pdf'
          WHEN upload_no % 11 = 0 THEN 'page_limit' WHEN b > 10485760 THEN 'text_limit'
          WHEN b = 0 THEN 'corrupt_file' END AS error_code
        FROM (SELECT *, CASE WHEN upload_no % 13 = 0 THEN 0 ELSE octet_length(content)
          + len(list_filter(string_split(regexp_replace(hex(content), '(..)', '\\1,', 'g'), ','),
            lambda h: h >= '80' AND length(h) = 2)) END AS b FROM pages_files)""",
    "read_pairs": f"""
        SELECT CAST(a.doc_id AS VARCHAR) AS id, a.p AS position, a.x AS source, c.x AS reference
        FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS x,
            unnest(range(0, len(string_split(text, {NL})))) AS p,
            len(string_split(text, {NL})) AS n FROM documents) a
        JOIN (SELECT doc_id + 1 AS doc_id, unnest(string_split(text, {NL})) AS x,
            unnest(range(0, len(string_split(text, {NL})))) AS p,
            len(string_split(text, {NL})) AS n FROM documents) c
          ON a.doc_id = c.doc_id AND a.p = c.p
        WHERE NOT (a.p = a.n - 1 AND a.x = '') AND NOT (c.p = c.n - 1 AND c.x = '')""",
    "engine_tables": f"""
        SELECT {uuid5("document_id || ':' || seq")} AS id, document_id, seq,
          sha256(source_text) AS source_hash, kind, line FROM md_blocks""",
    "publish_outputs": """
        SELECT id AS job_id, 'out.md' AS filename, sha256(CASE WHEN k % 3 = 0 AND k % 2 = 1
          THEN 'v2 ' || text ELSE text END) AS content_hash FROM docs""",
    "output_conflicts": """
        SELECT CAST(o_custkey AS VARCHAR) AS job_id,
          min('part' || (o_orderkey % 9 % 2)) AS first_name,
          max('part' || (o_orderkey % 9 % 2)) AS last_name
        FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 9 % 2) > 1""",
    "explode_lines": "SELECT document_id, line, content, ending FROM md_lines",
    "mask_code_fences": "SELECT document_id, line, content FROM md_open WHERE content <> ''",
    "classify_lines": r"""
        SELECT document_id, line, kind, CASE WHEN kind = 'heading' THEN
          CAST(length(regexp_extract(content, '^ {0,3}(#{1,6})', 1)) AS BIGINT) ELSE -1 END
          AS level,
          CASE WHEN kind = 'list_item' THEN regexp_extract(content,
            '^ {0,3}([-*+]|[0-9]+[.)])', 1) END AS marker FROM md_kinds""",
    "split_table_cells": 'SELECT document_id, line, "column", columns, cell FROM md_cells',
    "split_affixes": "SELECT document_id, line, prefix, source_text, suffix FROM md_affixes",
    "segment_markdown": f"""
        SELECT document_id, seq, {uuid5("document_id || ':' || seq")} AS id, source_text,
          sha256(source_text) AS source_hash, kind, line, coalesce(level, -1) AS level, marker,
          coalesce("column", -1) AS "column", coalesce(columns, -1) AS columns,
          prefix, suffix FROM md_blocks""",
    "assign_block_ids": f"""
        SELECT document_id, line, coalesce("column", -1) AS "column", seq, {uuid5("document_id || ':' || seq")} AS id,
          sha256(source_text) AS source_hash FROM md_blocks""",
    "structural_blocks": """
        SELECT document_id, seq, line, "column" FROM md_blocks
        WHERE kind = 'table_cell' AND source_text = ''""",
    "drop_empty_blocks": """
        SELECT document_id, count(*) AS blocks FROM md_blocks WHERE source_text <> ''
        GROUP BY ALL""",
    "document_summary": """
        SELECT d.id, d.lang, coalesce(n, 0) AS block_count, a.triage_status,
          coalesce(a.tokens_in_total, -1) AS tokens_in_total
        FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n FROM blocks GROUP BY ALL) c
          ON c.document_id = d.id LEFT JOIN analyses a ON a.document_id = d.id""",
    "blocks_of": "SELECT seq, id, source_text FROM blocks WHERE document_id = '7'",
    "join_blocks": f"""
        SELECT document_id, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS text_hash
        FROM (SELECT document_id, string_agg(source_text, {NL} ORDER BY seq) AS t
          FROM blocks GROUP BY ALL)""",
    "strip_nonprinting": "SELECT document_id, seq, base || kept AS source_text FROM mixed",
    "source_warnings": f"""
        SELECT document_id, string_agg('U+' || lpad(upper(to_hex(code)),
          CAST(greatest(4, length(to_hex(code))) AS INTEGER), '0'), ', ' ORDER BY code)
          AS code_points FROM (
          SELECT DISTINCT document_id, unicode(ch) AS code FROM (
            SELECT document_id, unnest(string_split(base || noise, '')) AS ch FROM mixed)
          WHERE ch <> '') WHERE code IN (7, 173, 8203, 65039, 917761) OR code BETWEEN 127 AND 159
            OR NOT (code BETWEEN 32 AND 591 OR code BETWEEN 1024 AND 1279
              OR code BETWEEN 8192 AND 8303 OR code = 8364 OR code IN (9, 10, 13, 12288))
        GROUP BY ALL""",
    "script_histogram": "SELECT document_id, cyrillic, latin, cjk, arabic FROM scripts",
    "detect_language_majority": r"""
        SELECT document_id, CASE WHEN c <= l THEN 'en' WHEN m THEN 'uk' ELSE 'ru' END AS language
        FROM (SELECT document_id,
          sum(length(regexp_replace(t, '[^\x{0400}-\x{04ff}]', '', 'g'))) AS c,
          sum(length(regexp_replace(t, '[^A-Za-zß]', '', 'g'))) AS l,
          bool_or(regexp_matches(t, '[іїєґІЇЄҐ]')) AS m
          FROM (SELECT document_id, base || noise AS t FROM mixed) GROUP BY ALL)""",
    "detect_language_any": r"""
        SELECT document_id, CASE WHEN NOT c THEN 'en' WHEN m THEN 'uk' ELSE 'ru' END AS language
        FROM (SELECT document_id, bool_or(regexp_matches(t, '[\x{0400}-\x{04ff}]')) AS c,
          bool_or(regexp_matches(t, '[іїєґІЇЄҐ]')) AS m
          FROM (SELECT document_id, base || noise AS t FROM mixed) GROUP BY ALL)""",
    "leading_sample": "SELECT document_id, seq, CAST(length(t) AS BIGINT) AS chars FROM sample",
    "extract_terms": r"""
        SELECT document_id, rank, w AS term FROM (SELECT *, row_number() OVER (PARTITION BY
          document_id ORDER BY place) AS rank FROM (
          SELECT document_id, w, min(seq * 1000000 + i) AS place FROM (
            SELECT document_id, seq, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM (
              SELECT document_id, seq, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS l
              FROM (SELECT document_id, seq, source_text AS t FROM blocks)))
          WHERE regexp_full_match(w, '[\p{L}\p{Nl}\p{No}]+') AND regexp_matches(w, '^\p{Lu}')
          GROUP BY ALL))""",
    "document_outline": """
        SELECT o.*, s.cyrillic, s.latin, s.cjk, s.arabic FROM (
          SELECT document_id, count(*) AS block_count, min(seq) AS first_seq,
            max(seq) AS last_seq,
            string_agg(seq || ':' || base || noise, '|' ORDER BY seq) AS heads FROM mixed
          GROUP BY ALL) o JOIN scripts s USING (document_id)""",
    "read_range": """
        SELECT document_id, seq, source_text AS snippet FROM turns WHERE seq >= 2 AND seq < 5""",
    "search_blocks": """
        SELECT document_id, seq, w AS keyword, source_text AS snippet
        FROM blocks, (VALUES ('The'), ('STRASSE'), ('tion.')) AS k(w)
        WHERE instr(replace(lower(source_text), 'ß', 'ss'), lower(w)) > 0""",
    "search_keywords": """
        SELECT document_id, seq, w AS keyword, unnest(list_filter(
          range(1, length(f) - length(l) + 2), lambda i: substr(f, i, length(l)) = l)) AS position
        FROM (SELECT document_id, seq, replace(lower(source_text), 'ß', 'ss') AS f FROM blocks)
        JOIN keyword_table ON contains(f, l)""",
    "bounded_payload": """
        SELECT document_id, payload_no, entries, CAST(length(p) AS BIGINT) AS chars,
          sha256(p) AS payload_hash FROM (
          SELECT document_id, payload_no, count(*) AS entries,
            '[' || string_agg(j, ',' ORDER BY seq) || ']' AS p
          FROM payloads GROUP BY ALL)""",
    "normalize_languages": """
        SELECT document_id, array_to_string(languages, ',') AS languages FROM req""",
    "fan_out": "SELECT document_id, position, target_language FROM fanned",
    "request_keys": "SELECT document_id, target_language, batch_id, idempotency_key FROM keyed_req",
    "idempotent_append": """
        SELECT idempotency_key, CAST(min(request_no) AS VARCHAR) AS document_id,
          min(request_no) AS request_no FROM keyed_req WHERE request_no % 5 > 0
          AND idempotency_key NOT IN (SELECT idempotency_key FROM keyed_req
            WHERE request_no % 5 = 0) GROUP BY ALL""",
    "key_conflicts": """
        SELECT sha256(request_key) AS request_digest, count(*) AS jobs FROM keyed_req GROUP BY ALL
        HAVING count(DISTINCT document_id) > 1 OR count(DISTINCT batch_id) > 1""",
    "ready_documents": """
        SELECT d.id, CASE WHEN d.k % 4 = 0 OR a.k IS NULL THEN 'analysis_pending'
          WHEN d.k % 3 = 0 THEN 'glossary_changed' ELSE 'ready' END AS readiness
        FROM docs d LEFT JOIN analyses a USING (k)""",
    "identity_glossary": """
        SELECT document_id, '{"Shared":"Shared","' || terms[1] || '":"' || terms[1] || '"}'
          AS glossary_json FROM analyses""",
    "count_tokens": """
        SELECT document_id, CAST(sum(length(source_text)) AS BIGINT) AS tokens FROM blocks
        GROUP BY ALL""",
    "pack_chunks": """
        SELECT document_id, seq, CAST(length(source_text) AS BIGINT) AS tokens, chunk_seq,
          seq_in_chunk FROM packed""",
    "chunk_sizes": """
        SELECT document_id, chunk_seq, count(*) AS blocks,
          CAST(sum(length(source_text)) AS BIGINT) AS tokens, min(seq) AS first_seq,
          max(seq) AS last_seq FROM packed GROUP BY ALL""",
    "chunk_links": """
        SELECT p.document_id, p.chunk_seq, b.id AS block_id, p.seq_in_chunk
        FROM packed p JOIN blocks b ON b.document_id = p.document_id AND b.seq = p.seq""",
    "neighbour_context": """
        SELECT document_id, chunk_seq, document_id || ':' || before_seq AS before_id,
          coalesce(before_seq, -1) AS before_seq, document_id || ':' || after_seq AS after_id,
          coalesce(after_seq, -1) AS after_seq FROM sides""",
    "build_requests": """
        SELECT m.document_id, m.chunk_seq, 'de' AS target_language, '{"domain":"general",'
          || '"register":"neutral","source_language":"en","terms":[],"triage_status":"ok",'
          || '"warnings":[]}' AS plan_json, '{}' AS glossary_json,
          '{"context_before":[' || coalesce(p.j, '') || '],"blocks_to_translate":[' || m.js
          || '],"context_after":[' || coalesce(q.j, '') || ']}' AS payload_json, m.block_count
        FROM (SELECT document_id, seq // 2 AS chunk_seq, count(*) AS block_count,
            string_agg(j, ',' ORDER BY seq) AS js FROM turn_json
            WHERE seq % 3 > 0 AND source_text <> '' GROUP BY ALL) m
        JOIN sides s USING (document_id, chunk_seq)
        LEFT JOIN turn_json p ON p.document_id = s.document_id AND p.seq = s.before_seq
        LEFT JOIN turn_json q ON q.document_id = s.document_id AND q.seq = s.after_seq""",
    "chunk_blocks_of": """
        SELECT chunk_id, count(*) AS blocks, CAST(sum(seq_in_chunk) AS BIGINT) AS position_sum,
          CAST(sum(length(source_text)) AS BIGINT) AS chars FROM links GROUP BY ALL""",
    "plan_hash": """
        SELECT document_id, sha256('{"domain":"general","register":"' || register
          || '","source_language":"' || source_language || '","terms":["' || terms[1] || '","'
          || terms[2] || '"],"triage_status":"' || triage_status || '","warnings":['
          || CASE WHEN triage_status = 'ok' THEN '' ELSE '"heuristic"' END || ']}') AS plan_hash
        FROM analyses""",
    "translation_keys": "SELECT document_id, target, translation_key FROM keys",
    "lookup": """
        SELECT document_id, target, seq, translated_text FROM keyed
        LEFT JOIN memory USING (translation_key, source_hash)""",
    "lookup_bucketed": """
        SELECT id, t AS translated_text FROM turn_batch LEFT JOIN turn_memory USING (h)""",
    "lookup_cut": """
        SELECT id, t AS translated_text FROM turn_batch LEFT JOIN turn_memory USING (h)""",
    "misses_cut": """
        SELECT id, h AS source_hash FROM turn_batch WHERE h NOT IN (SELECT h FROM turn_memory)""",
    "misses": "SELECT document_id, target, seq, source_hash FROM missing",
    "distinct_units": """
        SELECT translation_key, source_hash, min(source_text) AS source_text, count(*) AS blocks
        FROM missing GROUP BY ALL""",
    "hit_miss_counts": """
        SELECT document_id, target, count(translated_text) AS hits,
          count(*) - count(translated_text) AS misses FROM keyed
        LEFT JOIN memory USING (translation_key, source_hash) GROUP BY ALL""",
    "append_first_wins": """
        SELECT translation_key, source_hash, translated_text FROM (
          SELECT translation_key, source_hash, 'v' || seq || ' ' || source_text AS translated_text,
            row_number() OVER (PARTITION BY translation_key, source_hash
              ORDER BY k % 17, 'v' || seq || ' ' || source_text) AS n FROM missing) WHERE n = 1""",
    "hit_ratio": """
        SELECT id, CASE WHEN hits + misses > 0 THEN CAST(floor(100 * hits / (hits + misses) + 0.5)
          AS BIGINT) ELSE -1 END AS hit_percent FROM jobs""",
    "hit_ratio_between_snapshots": """
        SELECT user_id, hits, CASE WHEN dh + dm > 0 THEN round(dh / (dh + dm), 6) END AS ratio FROM (
          SELECT user_id, hits, hits - lag(hits) OVER w AS dh, misses - lag(misses) OVER w AS dm
          FROM (SELECT user_id, ts, event_id * 3 + event_id % 4 AS hits,
            event_id * 2 + event_id % 7 AS misses FROM events)
          WINDOW w AS (PARTITION BY user_id ORDER BY ts))""",
    "retry_plan": """
        SELECT job_id, chunk_id, seq, status, CASE WHEN status = 'pending' THEN top ELSE -1 END
          AS baseline FROM retry""",
    "retry_progress": """
        SELECT job_id, 'queued' AS status, count(*) FILTER (status = 'done') AS done_chunks,
          count(*) AS total_chunks FROM retry GROUP BY job_id""",
    "reuse_report": """
        SELECT document_id, count(*) AS blocks, count(o.h) AS reused,
          round(count(o.h) / count(*), 6) AS reused_share FROM (
          SELECT document_id, sha256(CASE WHEN seq % 4 = 1 THEN source_text || '!'
            ELSE source_text END) AS h FROM blocks) e
        LEFT JOIN (SELECT DISTINCT document_id, source_hash AS h FROM blocks) o
          USING (document_id, h) GROUP BY ALL""",
    "pseudo_translate": """
        SELECT translation_key, source_hash, '[' || target || '] ' || source_text
          AS translated_text FROM units""",
    "infer": """
        SELECT translation_key, source_hash, '[' || target || '] ' || source_text
          AS translated_text, CAST(1 AS BIGINT) AS calls FROM units""",
    "infer_with_retries": """
        SELECT translation_key, source_hash, attempt_no, CASE WHEN m = 0 THEN 'fatal_error'
            WHEN m = 1 OR (m = 2 AND attempt_no = 1) THEN 'retryable_error' ELSE 'ok' END
            AS outcome,
          CASE WHEN m = 0 THEN 'provider_refusal' WHEN m = 1 THEN 'provider_timeout'
            WHEN m = 2 AND attempt_no = 1 THEN 'provider_rate_limit' END AS error_code,
          CASE WHEN m = 0 THEN 5 WHEN m = 1 THEN 0 WHEN m = 2 AND attempt_no = 1 THEN 1
            ELSE length(source_text) END AS tokens_in,
          CASE WHEN m < 2 OR (m = 2 AND attempt_no = 1) THEN 0 ELSE length(source_text) + 5 END
            AS tokens_out
        FROM (SELECT *, length(source_text) % 7 AS m,
          unnest(range(1, CASE length(source_text) % 7 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 2 END))
          AS attempt_no FROM units)""",
    "translate_corpus": f"""
        SELECT d.id AS document_id, coalesce(m.n, 0) AS new_blocks, CAST(0 AS BIGINT)
          AS failed_chunks, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS text_hash
        FROM (SELECT id, array_to_string(list_transform(string_split(text, {NL}), lambda x:
            CASE WHEN trim(x, {WS}) = '' THEN x ELSE
              substr(x, 1, length(x) - length(ltrim(x, {WS}))) || '[de] ' || trim(x, {WS})
              || substr(x, length(rtrim(x, {WS})) + 1) END), {NL}) AS t FROM docs) d
        LEFT JOIN (SELECT document_id, count(*) AS n FROM missing WHERE target = 'de' GROUP BY ALL) m
          ON m.document_id = d.id""",
    "validate_results": """
        SELECT *, CASE WHEN missing + extra + duplicated + wrong_model + bad_usage + no_text > 0
          THEN 'provider_invalid_response' END AS error_code FROM (
          SELECT coalesce(t.document_id, r.chunk_id) AS chunk_id,
            count(*) FILTER (r.n IS NULL) AS missing,
            count(*) FILTER (t.id IS NULL) AS extra, count(*) FILTER (r.n > 1) AS duplicated,
            count(*) FILTER (t.id IS NOT NULL AND r.other_model) AS wrong_model,
            count(*) FILTER (r.bad_usage) AS bad_usage, count(*) FILTER (r.untold) AS no_text
          FROM turns t FULL JOIN (SELECT * FROM results WHERE n > 0) r
            ON r.chunk_id = t.document_id AND r.block_id = t.id GROUP BY ALL)""",
    "classify_error": """
        SELECT id, error_code, CASE error_code WHEN 'never_catalogued' THEN 'internal_error'
            ELSE error_code END AS safe_code,
          CASE error_code WHEN 'provider_timeout' THEN 'Translation provider timed out'
            WHEN 'render_failed' THEN 'Translated document could not be rendered'
            WHEN 'never_catalogued' THEN 'Internal server error' END AS message,
          CASE WHEN error_code IS NOT NULL THEN error_code <> 'render_failed' END AS retryable
        FROM jobs""",
    "clean_usage": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
          tin AS tokens_in, tout AS tokens_out FROM clean""",
    "attempt_outcome": """
        SELECT CASE WHEN error_code IS NULL THEN 'ok' WHEN error_code = 'render_failed'
          THEN 'fatal_error' ELSE 'retryable_error' END AS outcome, count(*) AS jobs
        FROM jobs GROUP BY 1""",
    "price": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, e
            AS price_error,
          CASE WHEN e IS NULL THEN round((tokens_in * pin + tokens_out * pout) / 1e6, 10) END
            AS price_usd FROM (SELECT *, CASE WHEN tokens_in < 0 OR tokens_out < 0
            THEN 'negative_tokens' WHEN pin IS NULL THEN 'unknown_model' END AS e
          FROM usage LEFT JOIN prices USING (model))""",
    "price_cached": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, e
            AS price_error, CASE WHEN e IS NULL THEN round(((tokens_in - cached) * pin
            + cached * pcached + tokens_out * pout) / 1e6, 10) END AS price_usd
        FROM (SELECT *, CASE WHEN tokens_in < 0 OR tokens_out < 0 THEN 'negative_tokens'
            WHEN cached < 0 OR cached > tokens_in THEN 'bad_cached_tokens'
            WHEN pin IS NULL THEN 'unknown_model' END AS e
          FROM usage LEFT JOIN prices USING (model))""",
    "estimate_chunk_cost": """
        SELECT document_id, tin AS tokens_in, tout AS tokens_out,
          round((tin * 2.5 + tout * 10.0) / 1e6, 10) AS estimate_usd FROM (
          SELECT document_id, 256 + 2 + length(source_language) + 7 + length(register)
            + length(terms[1]) + 6 + CASE WHEN triage_status = 'ok' THEN 0 ELSE 9 END
            + 2 * length(terms[1]) + 5 + 17 + doc_id % 90 + octet_length(encode(text)) AS tin,
            greatest(1, 3 * octet_length(encode(text))) AS tout
          FROM analyses a JOIN documents d ON d.doc_id = a.k)""",
    "admit_under_cap": "SELECT job_id, seq, estimate_usd, admitted FROM walk",
    "number_attempts": "SELECT chunk_id, id, attempt_no FROM attempts",
    "next_attempt_no": """
        SELECT c.id AS chunk_id, coalesce(max(a.attempt_no), 0) + 1 AS next_attempt_no
        FROM chunks c LEFT JOIN attempts a ON a.chunk_id = c.id GROUP BY ALL""",
    "attempts_per_chunk": """
        SELECT c.id, coalesce(max(a.attempt_no), 0) AS max_attempt_no FROM chunks c
        LEFT JOIN attempts a ON a.chunk_id = c.id AND a.outcome <> 'ok' GROUP BY ALL""",
    "remaining_attempts": """
        SELECT id, 3 - used AS remaining, used >= 3 AS exhausted FROM (
          SELECT c.id, greatest(0, coalesce(max(a.attempt_no), 0)
            - greatest(0, CAST(any_value(c.seq) AS BIGINT) % 3 - 1)) AS used
          FROM chunks c LEFT JOIN attempts a ON a.chunk_id = c.id GROUP BY c.id)""",
    "rollup_jobs": """
        SELECT j.id AS job_id, CAST(coalesce(sum(a.tokens_in), 0) AS BIGINT) AS tokens_in,
          CAST(coalesce(sum(a.tokens_out), 0) AS BIGINT) AS tokens_out,
          round(coalesce(sum(a.cost_usd), 0), 8) AS cost_usd
        FROM jobs j LEFT JOIN chunks c ON c.job_id = j.id LEFT JOIN log a ON a.chunk_id = c.id
        GROUP BY ALL""",
    "job_measurement": """
        SELECT j.id AS job_id, j.document_id, j.target_language, j.status, j.model,
          j.total_chunks, j.done_chunks, coalesce(b.n, 0) AS block_count,
          CAST(round_even((j.k % 1000) * 1500.5, 0) AS BIGINT) AS job_latency_ms,
          coalesce(u.attempts, 0) AS attempt_count, coalesce(u.retries, 0) AS retry_attempt_count,
          round(coalesce(u.retry_cost, 0), 8) AS retry_cost_usd,
          round(coalesce(u.cost, 0), 8) AS attempt_cost_usd,
          round(coalesce(100 * u.retry_cost / nullif(u.cost, 0), 0), 7)
            AS retry_cost_share_percent,
          CAST(coalesce(u.tin, 0) AS BIGINT) AS attempt_tokens_in,
          CAST(coalesce(u.tout, 0) AS BIGINT) AS attempt_tokens_out,
          coalesce(u.n_ok, 0) AS ok_count, coalesce(u.n_retry, 0) AS retryable_error_count,
          coalesce(u.n_fatal, 0) AS fatal_error_count,
          coalesce(u.p95, -1) AS p95_attempt_latency_ms
        FROM jobs j LEFT JOIN (SELECT job_id, count(DISTINCT block_id) AS n FROM links
          GROUP BY ALL) b ON b.job_id = j.id
        LEFT JOIN (SELECT c.job_id, count(*) AS attempts, count(*) FILTER (attempt_no > 1)
            AS retries, sum(cost_usd) AS cost, coalesce(sum(cost_usd) FILTER (attempt_no > 1), 0)
            AS retry_cost, sum(tokens_in) AS tin, sum(tokens_out) AS tout,
            count(*) FILTER (outcome = 'ok') AS n_ok,
            count(*) FILTER (outcome = 'retryable_error') AS n_retry,
            count(*) FILTER (outcome = 'fatal_error') AS n_fatal,
            quantile_disc(latency_ms, 0.95) AS p95
          FROM attempts a JOIN chunks c ON c.id = a.chunk_id GROUP BY ALL) u
          ON u.job_id = j.id""",
    "job_latencies": """
        SELECT c.job_id, CAST(c.seq AS BIGINT) AS chunk_seq, a.attempt_no, a.latency_ms
        FROM attempts a JOIN chunks c ON c.id = a.chunk_id""",
    "p95_nearest_rank": """
        SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL""",
    "p95_from_sketches": """
        SELECT event_type, count(value) AS rows, true AS within FROM events
        WHERE NOT isnan(value) GROUP BY ALL""",
    "guarded_p95": """
        SELECT CAST(user_id AS VARCHAR) AS user_id, status, count(*) AS observations,
          CASE WHEN count(*) >= 20 THEN quantile_disc(cost_usd, 0.95) END AS p95
        FROM seen GROUP BY ALL""",
    "outcome_counts": """
        SELECT outcome, count(*) AS attempts, round(sum(cost_usd), 4) AS cost_usd FROM log
        GROUP BY ALL""",
    "retry_spend": """
        SELECT round(sum(cost_usd), 4) AS cost_usd, round(sum(cost_usd) FILTER (attempt_no > 1), 4)
          AS retry_cost_usd, count(*) FILTER (attempt_no > 1) AS retries FROM attempts""",
    "pipeline_usage": """
        SELECT round(bu + tu, 4) AS known_cost_usd, bi + ti AS known_tokens_in,
          bo + t_o AS known_tokens_out, round(bu, 4) AS bulk_cost_usd, bi AS bulk_tokens_in,
          bo AS bulk_tokens_out, round(tu, 4) AS triage_cost_usd, ti AS triage_tokens_in,
          t_o AS triage_tokens_out, n AS recorded_bulk_attempts
        FROM (SELECT sum(cost_usd) AS bu, CAST(sum(tokens_in) AS BIGINT) AS bi,
            CAST(sum(tokens_out) AS BIGINT) AS bo, count(*) AS n FROM log)
        CROSS JOIN (SELECT sum(cost_usd_total) AS tu, CAST(sum(tokens_in_total) AS BIGINT) AS ti,
            CAST(sum(tokens_out_total) AS BIGINT) AS t_o FROM analyses)""",
    "model_comparison": """
        SELECT position, model, round(cost * 1e6 / (tin + tout), 4)
            AS cost_per_million_mixed_tokens_usd,
          round(coalesce(cost, 0), 4) AS cost_usd, CAST(coalesce(tin, 0) AS BIGINT) AS tokens_in,
          CAST(coalesce(tout, 0) AS BIGINT) AS tokens_out, coalesce(n, 0) AS requests
        FROM (SELECT unnest(['gpt-4o-mini', 'gpt-4o', 'gpt-6-luna', 'gpt-5.6-luna']) AS model,
            unnest(range(0, 4)) AS position)
        LEFT JOIN (SELECT model, sum(c) AS cost, sum(i) AS tin, sum(o) AS tout, sum(b) AS n FROM (
            SELECT j.model, a.cost_usd AS c, a.tokens_in AS i, a.tokens_out AS o, 1 AS b
            FROM log a JOIN jobs j ON j.id = string_split(a.chunk_id, '-')[1]
            UNION ALL SELECT 'gpt-4o', cost_usd_total, tokens_in_total, tokens_out_total, 0
            FROM analyses) GROUP BY ALL) USING (model)""",
    "merge_analysis": """
        SELECT document_id, save_no, triage_status, tokens_in, tokens_out, cost_usd,
          cost_usd_total, tokens_in_total, tokens_out_total FROM (
          SELECT *, sum(cost_usd) OVER w AS cost_usd_total,
            CAST(sum(tokens_in) OVER w AS BIGINT) AS tokens_in_total,
            CAST(sum(tokens_out) OVER w AS BIGINT) AS tokens_out_total,
            max(save_no) OVER w AS top FROM applied WINDOW w AS (PARTITION BY document_id))
        WHERE save_no = top""",
    "analysis_costs": """
        SELECT document_id, cost_usd_total FROM analyses
        WHERE document_id IN (SELECT document_id FROM jobs)""",
    "attribute_shared_cost": """
        SELECT j.id AS job_id, j.document_id, count(*) OVER (PARTITION BY j.document_id)
            AS sharing_jobs,
          CASE WHEN row_number() OVER (PARTITION BY j.document_id ORDER BY j.created_at DESC, j.id)
            = 1 THEN coalesce(a.cost_usd_total, 0) END AS shown_cost_usd
        FROM jobs j LEFT JOIN analyses a USING (document_id)""",
    "document_expense": """
        SELECT coalesce(j.document_id, a.document_id) AS document_id, coalesce(j.n, 0) AS jobs,
          round(coalesce(j.usd, 0) + coalesce(a.cost_usd_total, 0), 4) AS total_usd
        FROM (SELECT document_id, count(*) AS n, sum(cost_usd) AS usd FROM jobs GROUP BY ALL) j
        FULL JOIN analyses a ON a.document_id = j.document_id""",
    "price_attempts_lenient": """
        SELECT l_orderkey AS document_id, round(sum(usd), 9) AS cost_usd_total,
          CAST(sum(tin) AS BIGINT) AS tokens_in_total, CAST(sum(tout) AS BIGINT)
            AS tokens_out_total, round(coalesce(sum(usd) FILTER (ok), 0), 9) AS cost_usd,
          CAST(coalesce(sum(tin) FILTER (ok), 0) AS BIGINT) AS tokens_in,
          CAST(coalesce(sum(tout) FILTER (ok), 0) AS BIGINT) AS tokens_out
        FROM (SELECT *, l_partkey % 4 = 0 AS ok, coalesce(((tin - least(tin, tcached)) * pin
            + least(tin, tcached) * pcached + tout * pout) / 1e6, 0) AS usd
          FROM clean LEFT JOIN prices USING (model)) GROUP BY ALL""",
    "metrics_snapshot": """
        SELECT metric, label, round(CAST(value AS DOUBLE), 2) AS value FROM (
          SELECT 'jobs_by_status' AS metric, s AS label, count(j.id) AS value
          FROM (SELECT unnest(['queued', 'running', 'assembling', 'done',
            'completed_with_errors', 'failed']) AS s) LEFT JOIN jobs j ON j.status = s GROUP BY ALL
          UNION ALL SELECT 'llm_cost_usd_total', '', sum(cost_usd) FROM jobs
          UNION ALL SELECT 'cache_hits_total', '', sum(hits) FROM jobs
          UNION ALL SELECT 'cache_misses_total', '', sum(misses) FROM jobs
          UNION ALL SELECT 'llm_errors_total', '', count(*) FROM log WHERE outcome <> 'ok'
          UNION ALL SELECT 'llm_triage_cost_usd_total', '', sum(cost_usd_total) FROM analyses
          UNION ALL SELECT 'llm_triage_tokens_total', 'input', sum(tokens_in_total) FROM analyses
          UNION ALL SELECT 'llm_triage_tokens_total', 'output', sum(tokens_out_total)
            FROM analyses)""",
    "recent_jobs": "SELECT id, status FROM jobs ORDER BY created_at DESC, id LIMIT 500",
    "jobs_by_batch": "SELECT id, document_id FROM jobs WHERE batch_id = '7.1'",
    "batch_family": "SELECT id, batch_id FROM jobs WHERE starts_with(batch_id, '7.')",
    "filter_by_status": "SELECT id FROM jobs WHERE status = 'completed_with_errors'",
    "order_by_request": """
        SELECT id, batch_id, CASE target_language WHEN 'uk' THEN 0 WHEN 'de' THEN 2 ELSE 3 END
          ::BIGINT AS position FROM jobs WHERE target_language IN ('uk', 'de', 'fr')""",
    "pending_chunks": """
        SELECT id, job_id, CAST(seq AS BIGINT) AS seq FROM chunks WHERE status = 'pending'""",
    "unfinished_count": """
        SELECT j.id AS job_id, count(*) FILTER (c.status <> 'done') AS unfinished
        FROM jobs j LEFT JOIN chunks c ON c.job_id = j.id GROUP BY ALL""",
    "apply_progress": """
        SELECT j.id, CASE WHEN j.status IN ('running', 'assembling') AND p.n IS NOT NULL
          THEN least(j.total_chunks, greatest(j.done_chunks, p.n)) ELSE j.done_chunks END
          AS done_chunks FROM jobs j LEFT JOIN (SELECT l_orderkey AS k,
            CAST(max(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY ALL) p USING (k)""",
    "stale_inflight": """
        SELECT id FROM chunks WHERE status = 'inflight'
          AND lease < TIMESTAMP '2000-05-31 23:58:00'""",
    "release_expired": """
        SELECT id, CASE WHEN gone THEN 'pending' ELSE status END AS status, gone AS released,
          CASE WHEN NOT gone THEN strftime(lease, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS lease
        FROM (SELECT *, status = 'inflight' AND (lease IS NULL OR lease <= @NOW@) AS gone
          FROM chunks)""",
    "eligible_jobs": """
        SELECT id, status FROM jobs WHERE status IN ('queued', 'running', 'assembling')
          AND (lease_expires_at IS NULL OR lease_expires_at <= @NOW@)""",
    "eligible_chunks": """
        SELECT job_id, arg_min(id, seq) AS chunk_id, CAST(min(seq) AS BIGINT) AS seq FROM chunks
        WHERE status = 'pending' AND job_id IN (SELECT id FROM jobs WHERE status = 'running')
        GROUP BY ALL""",
    "analysis_backlog": """
        SELECT id, status FROM tracked WHERE status <> 'failed' AND id NOT IN (
          SELECT document_id FROM analyses WHERE triage_status = 'ok') AND id NOT IN (
          SELECT document_id FROM jobs WHERE status = 'assembling')""",
    "documents_in_use": """
        SELECT id, status FROM tracked WHERE id IN (SELECT document_id FROM jobs)""",
    "repair_stuck_status": """
        SELECT id, CASE WHEN fix THEN 'extracted' ELSE status END AS status, fix AS repaired FROM (
          SELECT t.id, t.status, t.status = 'analyzing' AND a.k IS NOT NULL AND
            (a.triage_status = 'ok' OR t.id IN (SELECT document_id FROM jobs
              WHERE status = 'assembling')) AS fix
          FROM tracked t LEFT JOIN analyses a ON a.document_id = t.id)""",
    "discard_degraded": """
        SELECT document_id, triage_status FROM analyses WHERE NOT (triage_status = 'degraded'
          AND document_id IN (SELECT document_id FROM jobs WHERE status = 'failed'))""",
    "final_status": """
        SELECT j.id AS job_id, CASE WHEN coalesce(bool_and((l_partkey % 6 > 0
            OR l_partkey % 4 = 0) AND l_suppkey % 23 > 0), true) THEN 'done'
          ELSE 'completed_with_errors' END AS status
        FROM jobs j LEFT JOIN lineitem l ON l.l_orderkey = j.k GROUP BY j.id""",
    "find_job": "SELECT id, status FROM jobs WHERE id = 'key-77' OR idempotency_key = 'key-77'",
    "lookup_status": """
        SELECT i.id, CASE WHEN j.id IS NOT NULL THEN 'job' WHEN t.id IS NOT NULL THEN 'document'
          ELSE 'not_found' END AS kind, coalesce(j.status, t.status) AS status
        FROM (SELECT DISTINCT CAST(l_partkey * 13 AS VARCHAR) AS id FROM lineitem) i
        LEFT JOIN jobs j USING (id) LEFT JOIN tracked t USING (id)""",
    "downloadable_jobs": """
        SELECT id FROM jobs WHERE status IN ('done', 'completed_with_errors')""",
    "missing_artifacts": """
        SELECT id FROM jobs WHERE status IN ('done', 'completed_with_errors')
          AND k NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "check_keys": "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{','.join(key)}' AS key_columns, "
        f"concat_ws('|', {', '.join(key)}) AS key_value, count(*) AS copies FROM {part} "
        f"GROUP BY {', '.join(key)} HAVING count(*) > 1"
        for table, part, key in (
            ("documents", "docs", ("id",)), ("blocks", "blocks", ("id",)),
            ("blocks", "blocks", ("document_id", "seq")), ("analyses", "analyses", ("document_id",)),
            ("jobs", "jobs", ("id",)), ("jobs", "jobs", ("idempotency_key",)),
            ("chunks", "chunks", ("id",)), ("chunks", "chunks", ("job_id", "seq")),
            ("chunk_blocks", "links", ("chunk_id", "block_id")),
            ("chunk_blocks", "links", ("chunk_id", "seq_in_chunk")),
            ("translations", "memory", ("translation_key", "source_hash")),
            ("attempts", "log", ("id",)),
        )),
    "check_references": "\nUNION ALL ".join(
        f"SELECT '{child}' AS child_table, '{parent}' AS parent_table, {column} AS missing_key, "
        f"count(*) AS orphans FROM {part} WHERE {column} NOT IN (SELECT id FROM {parent_part}) "
        "GROUP BY ALL"
        for child, part, column, parent, parent_part in (
            ("blocks", "blocks", "document_id", "documents", "docs"),
            ("analyses", "analyses", "document_id", "documents", "docs"),
            ("jobs", "jobs", "document_id", "documents", "docs"),
            ("chunks", "chunks", "job_id", "jobs", "jobs"),
            ("chunk_blocks", "links", "chunk_id", "chunks", "chunks"),
            ("chunk_blocks", "links", "block_id", "blocks", "blocks"),
            ("attempts", "log", "chunk_id", "chunks", "chunks"),
        )),
    "check_aggregate": """
        SELECT * FROM (SELECT j.id AS job_id, j.total_chunks - coalesce(c.n, 0) AS chunk_difference,
            CAST(0 AS BIGINT) AS repeated_numbers, coalesce(f.n, 0) AS foreign_blocks
          FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS n FROM chunks GROUP BY ALL) c
            ON c.job_id = j.id
          LEFT JOIN (SELECT job_id, count(*) AS n FROM links WHERE block_seq = 3 GROUP BY ALL) f
            ON f.job_id = j.id) WHERE chunk_difference <> 0 OR foreign_blocks > 0""",
    "attach_translations": "SELECT document_id, target, seq, translated_text FROM rendered",
    "safe_translation": "SELECT document_id, target, seq, rendered, passthrough FROM rendered",
    "rebuild_lines": "SELECT document_id, target, line, content FROM new_lines",
    "rebuild_documents": """
        SELECT document_id, target, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS text_hash
        FROM (SELECT document_id, target, string_agg(content || ending, '' ORDER BY line) AS t
          FROM new_lines GROUP BY ALL)""",
    "geometry_errors": """
        SELECT document_id, line, error FROM (SELECT d.document_id, d.line,
          CASE WHEN d.line < 1 OR d.line > m.lines THEN 'line_outside_document'
            WHEN cells = n AND NOT (lo = hi AND lo = n AND places = n AND first = 0
              AND last = n - 1) THEN 'incomplete_row'
            WHEN cells < n AND n > 1 THEN 'several_blocks_on_line' END AS error
          FROM (SELECT document_id, line, count(*) AS n,
              count(*) FILTER (kind = 'table_cell') AS cells, min(columns) AS lo,
              max(columns) AS hi, count(DISTINCT "column") AS places, min("column") AS first,
              max("column") AS last FROM damaged GROUP BY ALL) d
          JOIN (SELECT document_id, max(line) AS lines FROM md_lines GROUP BY ALL) m
            USING (document_id)) WHERE error IS NOT NULL""",
    "char_ngrams": r"""
        SELECT n AS "order", substr(t, i, n) AS gram, count(*) AS n FROM (
          SELECT n, t, unnest(range(1, length(t) - n + 2)) AS i FROM (
            SELECT regexp_replace(source_text, '\s+', '', 'g') AS t FROM turns)
          CROSS JOIN (SELECT unnest(range(1, 7)) AS n) WHERE length(t) >= n)
        GROUP BY 1, 2""",
    "chrf": """
        SELECT t.id AS pair_id, round(coalesce(CASE WHEN 4 * p + q > 0
          THEN 100.0 * 5 * p * q / (4 * p + q) END, 0), 5) AS chrf
        FROM turns t LEFT JOIN (SELECT pair_id, avg(m / c) AS p, avg(m / r) AS q FROM (
            SELECT pair_id, n, sum(least(c, r)) AS m, sum(c) AS c, sum(r) AS r FROM pair_grams
            GROUP BY ALL) WHERE c > 0 AND r > 0 GROUP BY ALL) s ON s.pair_id = t.id""",
    "usage_rollup": """
        SELECT model, target_language, status, round(sum(cost_usd), 2) AS cost_usd,
          count(*) AS jobs, CAST(sum(k % 11) AS BIGINT) AS cache_hit_blocks,
          CAST(sum(k % 6) AS BIGINT) AS cache_miss_blocks,
          CAST(3 - grouping(model) - grouping(target_language) - grouping(status) AS BIGINT)
            AS level
        FROM jobs GROUP BY ROLLUP (model, target_language, status)""",
    "model_quality": f"""
        SELECT model, round(CASE WHEN 4 * p + q > 0 THEN 100.0 * 5 * p * q / (4 * p + q) ELSE 0
          END, 5) AS chrf FROM (
          SELECT model, avg(m / c) AS p, avg(m / r) AS q FROM (
            SELECT model, n, sum(least(c, r)) AS m, sum(c) AS c, sum(r) AS r FROM pair_grams
            JOIN (SELECT id AS pair_id, {pick(MODELS, "seq % 5")} AS model FROM turns)
              USING (pair_id) GROUP BY ALL) WHERE c > 0 AND r > 0 GROUP BY ALL)""",
    "job_event_feed": "SELECT job_id, event_id, status, event FROM feed",
    "job_event_stream": "SELECT job_id, event_id, status, event FROM feed",
    "stale_monitor": """
        SELECT CAST(user_id AS VARCHAR) AS chunk_id, lease_ms FROM (
          SELECT user_id, arg_max(epoch_us(ts) // 1000 + 21600000, ts) AS lease_ms,
            arg_max(status, ts) AS status FROM seen GROUP BY ALL)
        WHERE status <> 'done' AND lease_ms + 120001 < (SELECT max(epoch_us(ts) // 1000) FROM seen)""",
    "dedup_requests": "SELECT DISTINCT job_id AS idempotency_key FROM seen",
    "streaming_metrics": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, status, count(*) AS observations,
          round(sum(cost_usd), 4) AS cost_usd FROM seen GROUP BY ALL""",
    "incremental_translate": """
        SELECT DISTINCT source_hash, '[de] ' || source_text AS translated_text FROM blocks""",
}
RAW["mask_fence_lines"] = RAW["mask_code_fences"]
RAW["segment_lines"] = RAW["segment_markdown"]
ORACLE: dict[str, str] = {}


def _build() -> None:
    for name, body in RAW.items():
        ORACLE[name] = compose(body.replace("@NOW@", NOW))


_build()
