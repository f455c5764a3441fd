"""The subpackage's queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, compression, filter_audit, fingerprints, html, mixing, packing, rules, simhash, spelling, substrings, tokens, warc

QUERIES = {
    "op1_training_order": tokens.op1_training_order,
    "op2_warc_revisits": warc.op2_warc_revisits,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_main_text": html.op6_main_text,
    "op7_simhash_components": simhash.op7_simhash_components,
    "op8_compression_classifier": compression.op8_compression_classifier,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_source_mix": mixing.op12_source_mix,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op2_warc_revisits": """
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(h) >= 100 AND page_id > first_id THEN first_id END AS refers_to, url
        FROM (SELECT page_id, url, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i : i + 49], ' ')) END AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) u),
        f AS (SELECT h, min(doc_id) AS first_id FROM p WHERE h IS NOT NULL GROUP BY h),
        r AS (SELECT p.doc_id, i, word, max(CASE WHEN first_id < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY i ROWS 49 PRECEDING) AS gone FROM p LEFT JOIN f USING (h)),
        k AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256 FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, good, toxic, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask FROM w LEFT JOIN l USING (doc_id)),
        h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31),
        s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS earlier FROM o, LATERAL (SELECT unnest(range(1, 6))::INT AS step) u),
        r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                     sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                     sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
              FROM h, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r""",
}
