"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, exact_dedup, jaccard, line_dedup, mixing, packing, quality, secrets, sharding, warc
from .common import cut, scratch_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), out)
    found = cut(warc.read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    warc.remove(out)  # the query returns what it has read; write_warc itself leaves its files
    return found


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.uses(table(spark, sf_dir, "documents"), max_repeat=2.0).select("doc.doc_id", "doc.source", "pass", "tokens", "block", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.rendezvous_shards(table(spark, sf_dir, "documents"), [1.0] * 24)


#: Names of the public vocabulary's files; each worker finds them for itself.
ENCODING = {"path": "byte_bpe_50k.json", "ranks_path": "byte_bpe_50k.tiktoken"}


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ENCODING)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_exact_dedup, op3_line_dedup, op4_embedding_dedup, op5_quality, op6_warc, op7_mixing, op8_sharding, op9_packing, op10_jaccard_join)}



def _secrets_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = [(secrets.ASSIGN, 2), (secrets.ACCESS, 0), (secrets.HEX, 0), (secrets.RARE_ONLY, 4)]
    each = " UNION ALL ".join(
        f"""SELECT r, source, lang, '{kind}' AS kind, {k} AS k, i, length(p[i]) AS gap, length(m[i]) AS long, v[i] AS val
        FROM (SELECT *, regexp_split_to_array(t, {quote(pattern)}) AS p, regexp_extract_all(t, {quote(pattern)}) AS m,
        regexp_extract_all(t, {quote(pattern)}, {group}) AS v FROM d), unnest(range(1, len(m) + 1)) AS u(i)"""
        for k, (kind, (pattern, group)) in enumerate(zip(secrets.KINDS, kinds, strict=True))
    )
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
        e AS ({each}),
        s AS (SELECT *, coalesce(sum(gap + long) OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + gap AS start FROM e),
        g AS (SELECT *, kind || ':' || start || ':' || (start + long) AS label FROM s WHERE CASE kind WHEN 'assign' THEN length(val) >= 6
            WHEN 'rare' THEN length(regexp_replace(val, '[^0-9]', '', 'g')) >= 3 AND regexp_matches(val, '[A-Za-z]')
                AND NOT regexp_matches(val, {quote(secrets.HEX)}) AND NOT regexp_matches(val, {quote(secrets.ACCESS)}) ELSE true END),
        c AS (SELECT * FROM g WHERE kind <> 'rare' OR NOT EXISTS (SELECT 1 FROM g b WHERE b.r = g.r AND b.kind <> 'rare' AND b.start < g.start + g.long AND b.start + b.long > g.start)),
        h AS (SELECT val, count(DISTINCT coalesce(source, '<null>')) AS owners, count(DISTINCT (coalesce(source, '<null>'), coalesce(lang, '<null>'))) AS repositories FROM c GROUP BY val),
        o AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
            string_agg(label, ',' ORDER BY start, k) FILTER (kind <> 'rare') AS base, string_agg(label, ',' ORDER BY start, k) AS spans,
            count_if(kind = 'rare') AS n_rare, count_if(owners <= 1 AND repositories <= 2) AS n_live, count_if(owners > 1 OR repositories > 2) AS n_copied,
            max(owners) AS most_owners, max(repositories) AS most_repositories
            FROM c JOIN h USING (val) WHERE kind <> 'rare' OR owners <= 1 AND repositories <= 2 GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_rare, 0)::BIGINT AS n_rare,
            coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied,
            coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repositories, 0)::BIGINT AS most_repositories
        FROM d LEFT JOIN o USING (r)"""


SQL = {
    "op1_secret_scan": _secrets_sql(),
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)""",
    "op3_line_dedup": r"""
        WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM t)),
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM x WHERE w > 0),
        a AS (SELECT doc_id, list(line ORDER BY pos) AS ls, list(pos ORDER BY pos) AS ps, list(e ORDER BY pos) AS es, list(e - w ORDER BY pos) AS cs, max(e) AS total FROM c GROUP BY doc_id),
        -- The shortest run of 50 words or more from each line on, and the shortest that ends at each line.
        r AS (SELECT doc_id, i, len(list_filter(cs, lambda y: y < e - w + 50)) AS j FROM c JOIN a USING (doc_id) WHERE total - (e - w) >= 50
            UNION SELECT doc_id, len(list_filter(es, lambda y: y <= e - 50)) + 1, i FROM c JOIN a USING (doc_id) WHERE e >= 50),
        v AS (SELECT doc_id, ps[i] AS first, ps[j] AS last, array_to_string(ls[i:j], chr(10)) AS content FROM r JOIN a USING (doc_id)),
        o AS (SELECT *, min((doc_id, first)) OVER (PARTITION BY content) AS origin FROM v),
        g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM o WHERE (doc_id, first) > origin),
        n AS (SELECT doc_id, list(pos) AS ps FROM g GROUP BY doc_id)
        SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_deleted,
            CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(l)), lambda p: NOT list_contains(ps, p)), lambda p: l[p + 1]), chr(10)) END AS text
        FROM t LEFT JOIN n USING (doc_id)""",
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
        c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.u = vec_id) AS n_links, component_id, component_id = vec_id AS kept
        FROM embeddings JOIN c ON c.u = vec_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h),
        s AS (SELECT page_id, m, strlen(h) AS n, sha1(h) AS x FROM p JOIN g USING (h))
        SELECT page_id, n::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
            CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM s""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        n AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM n),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM p WHERE 100 * c >= 80 * (nu + nv - c)),
        r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(v) FROM r WHERE r.u = doc_id) AS component_id FROM n""",
}
