"""DuckDB statements with the rows that the queries of :mod:`fernway.llm.queries` give, where SQL can express them."""

_ESCAPED = r"""regexp_replace(text, '([<\[])(\\*)(/?s>|\||</?SYS>>|/?INST\])', '\1\\\2\3', 'g')"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), marked AS (SELECT *, {_ESCAPED} AS safe FROM turns)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('<|im_start|>' || role || chr(10) || safe || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op2_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0 AND item_id IS NOT NULL)
        ), sizes AS (SELECT DISTINCT n FROM windows), places AS (
            SELECT doc_id, n, i, w[i:i + n - 1] AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
        ), hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
        words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM d GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
        v AS (SELECT lang, count(*) AS terms, sum(total) AS lang_total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        kept AS (SELECT c.* FROM c JOIN k USING (lang, term)),
        gn AS (SELECT lang, source, coalesce(sum(n), 0) AS group_total FROM g LEFT JOIN kept USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)::HUGEINT) // (group_total + terms)::HUGEINT AS p,
                1 + (1000000000::HUGEINT * (total + 1)::HUGEINT) // (lang_total + terms)::HUGEINT AS q
            FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN kept ON kept.lang = gn.lang AND kept.source = gn.source AND kept.term = k.term
        ), pairs AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::BIGINT AS value
            FROM gn x JOIN gn y ON x.lang = y.lang AND x.source <> y.source
            LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source
            LEFT JOIN p b ON b.lang = x.lang AND b.source = y.source AND b.term = a.term
            GROUP BY ALL
        ), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200""",
    "op13_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), s AS (
            SELECT source, source_size, 3 * source_size AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
            FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
        ), l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM s WINDOW before AS (ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM l) * weight) AS target, floor(least(cap::DOUBLE, (SELECT max(level) FROM l) * weight) + 0.5)::BIGINT AS goal FROM s
        ), c AS (
            SELECT doc_id, size, source_size, goal, t.source, unnest(range(0, (goal + source_size - 1) // source_size)) AS copy
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 AND goal > 0
        ), w AS (
            SELECT doc_id, size, goal, copy * source_size + coalesce(sum(size) OVER (PARTITION BY source, copy
                ORDER BY md5('0:' || copy || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c
        ), x AS (SELECT doc_id, sum(greatest(least(size, goal - start), 0)) AS taken FROM w GROUP BY doc_id)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN x USING (doc_id)""",
}
