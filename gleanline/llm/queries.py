"""The queries opN_<name> of this subpackage and SQL for those that SQL can express."""

from __future__ import annotations

from gleanline.llm.alignment import op11_alignment
from gleanline.llm.bpe import op8_bpe
from gleanline.llm.digest import op2_fingerprints
from gleanline.llm.embeddings import op5_embeddings
from gleanline.llm.langid import op4_language
from gleanline.llm.packing import op7_packing
from gleanline.llm.quality import op12_quality
from gleanline.llm.ranking import op13_ranking
from gleanline.llm.secrets import op1_secrets
from gleanline.llm.simhash import op3_simhash
from gleanline.llm.toxicity import op10_toxicity
from gleanline.llm.viterbi import op9_token_counts
from gleanline.llm.warc import op6_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_fingerprints, op3_simhash, op4_language, op5_embeddings, op6_warc, op7_packing, op8_bpe, op9_token_counts, op10_toxicity, op11_alignment, op12_quality, op13_ranking,
    )
}

#: DuckDB SQL over the given tables.
ORACLE_SQL = {
    "op6_warc": """
        WITH p AS (
          SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                 sha1(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
        FROM f""",
    "op5_embeddings": """
        WITH RECURSIVE u AS (
          SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda w: CAST(w AS DOUBLE) * w)))) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
            AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9),
        reach(vec_id, seen) AS (
          SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.seen),
        least AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY 1),
        n AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
        FROM embeddings e JOIN least l ON l.vec_id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op13_ranking": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d WHERE text IS NOT NULL),
        tf AS (SELECT rid, t, count(*) AS tf FROM t GROUP BY 1, 2),
        len AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
        tot AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
        df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        w AS (SELECT t, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * df + 1))) AS BIGINT) AS w FROM df, tot),
        m AS (SELECT rid, 100 - 90 + (90 * n * n_docs) // n_terms AS m FROM len, tot),
        s AS (
          SELECT item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
          FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (rid) GROUP BY 1, 2),
        r AS (
          SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
          FROM s JOIN d USING (rid) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
