"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, embeddings, language_id, near_duplicates, packing, pii, substrings, suffixes, url_filter, warc

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_embeddings": embeddings.op2,
    "op3_url_filter": url_filter.op3,
    "op4_suffixes": suffixes.op4,
    "op5_decontamination": decontam.op5,
    "op6_warc": warc.op6,
    "op7_pii": pii.op7,
    "op8_near_duplicates": near_duplicates.op8,
    "op9_packing": packing.op9,
    "op10_substrings": substrings.op10,
}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({' + '.join(f"(strpos('0123456789abcdef', substr(h, {5 * g + j}, 1)) - 1) * {16 ** (5 - j)}" for j in range(1, 6))}) // {32**k}) % 32, 1)"
    for g in range(8)
    for k in (3, 2, 1, 0)
)

# op1, op3, op7 and op9 hold a learnt model, positions of pattern matches or a tokenizer, and the SQL of op4 takes minutes on
# whole tables: tests/llm holds these against brute force.
ORACLES: dict[str, str] = {
    "op2_embeddings": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
        good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        nodes AS (SELECT id FROM v),
        links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93), {_REACH}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, c.component_id, id = c.component_id AS kept FROM nodes JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = id""",
    "op5_decontamination": f"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
        iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS k FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
        win AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k FROM w, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(ws) - n + 2)) t(i)),
        hit AS (SELECT doc_id, item_id, i, win.n FROM win JOIN iw ON win.k = iw.k AND win.n = iw.n),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_warc": f"""WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS first FROM p)
        SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g""",
    "op8_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, coalesce(regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
        g AS (SELECT DISTINCT id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS s FROM w, unnest(range(1, greatest(len(ws), 2))) t(i) WHERE len(ws) > 0),
        n AS (SELECT w.id, count(g.s) AS n FROM w LEFT JOIN g USING (id) GROUP BY w.id), nodes AS (SELECT id FROM w),
        pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)), {_REACH}
        SELECT n.id AS doc_id, n.n AS n_shingles, r.component_id, n.id = r.component_id AS kept FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = n.id""",
    "op10_substrings": """WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) t(i)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
        cov AS (SELECT DISTINCT doc_id, p FROM late, unnest(range(i, i + 20)) u(p)),
        counts AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM (SELECT doc_id, t.word AS word, t.p AS p FROM w, unnest(ws) WITH ORDINALITY AS t(word, p)) b ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
