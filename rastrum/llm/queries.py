"""The registered queries of the language-model operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm import bpe, chat, jaccard, lines, packing, quality, secrets, spans, topk, warc
from rastrum.llm.common import table

#: Production parameters.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op6_packing(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER, 2048), 2048)


@query
def op2_lines(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op2_lines"] = r"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM rows),
     keyed AS (SELECT *, translate(regexp_replace(line, '^[ \t\n\x0B\x0C\r]+|[ \t\n\x0B\x0C\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
     common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
     marked AS (SELECT keyed.*, coalesce(keyed.doc_id <> common.keeper, false) AS gone FROM keyed LEFT JOIN common USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""


@query
def op7_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("distance2")


@query
def op4_secrets(spark, sf_dir):
    found = secrets.scan_report(table(spark, sf_dir, "documents"))
    count = lambda no: F.size(F.filter("spans", lambda x: x["kind_no"] == no)).cast("long")
    base = secrets.span_text(F.filter("spans", lambda x: x["kind_no"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


@query
def op8_warc(spark, sf_dir):
    entries, folder, top = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_captures(entries, folder, top, payloads=False).drop("payload").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op8_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY sha1(payload)) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM d
"""


@query
def op10_topk(spark, sf_dir):
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


ORACLE_SQL["op10_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op9_chat(spark, sf_dir):
    return chat.preference_pairs(chat.neighbour_pairs(table(spark, sf_dir, "conversations")))


ORACLE_SQL["op9_chat"] = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
     g AS (SELECT pair_id, coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 0), []) AS c,
                  coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 1), []) AS r FROM t GROUP BY pair_id),
     n AS (SELECT *, coalesce(list_min(list_filter(list_transform(range(1, least(len(c), len(r)) + 1), lambda i: CASE WHEN c[i] = r[i] THEN NULL ELSE i END), lambda i: i IS NOT NULL)) - 1, least(len(c), len(r))) AS n_common FROM g),
     s AS (SELECT pair_id, n_common, c[1:n_common] AS p, c[n_common + 1:] AS c, r[n_common + 1:] AS r FROM n),
     x AS (SELECT *, list_transform(p, lambda z: '<|turn|>' || z.role || chr(10) || z.text || '<|end|>' || chr(10)) AS pt,
                  list_transform(c, lambda z: '<|turn|>' || z.role || chr(10) || z.text || '<|end|>' || chr(10)) AS ct,
                  list_transform(r, lambda z: '<|turn|>' || z.role || chr(10) || z.text || '<|end|>' || chr(10)) AS rt FROM s),
     m AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: coalesce(list_sum(list_transform(ct[1:i - 1], lambda z: length(z))), 0) + 9 + length(c[i].role)) AS cs,
                  list_transform(range(1, len(r) + 1), lambda i: coalesce(list_sum(list_transform(rt[1:i - 1], lambda z: length(z))), 0) + 9 + length(r[i].role)) AS rs FROM x)
SELECT pair_id, CAST(n_common AS BIGINT) AS n_common, coalesce(array_to_string(pt, ''), '') AS prompt, coalesce(array_to_string(ct, ''), '') AS chosen, coalesce(array_to_string(rt, ''), '') AS rejected,
       coalesce(array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: CAST(cs[i] AS BIGINT) || ':' || CAST(cs[i] + length(c[i].text) + 7 AS BIGINT)), ','), '') AS chosen_mask,
       coalesce(array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: CAST(rs[i] AS BIGINT) || ':' || CAST(rs[i] + length(r[i].text) + 7 AS BIGINT)), ','), '') AS rejected_mask
FROM m
"""


@query
def op3_spans(spark, sf_dir):
    kept = spans.dedup_spans(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op3_spans"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents),
     win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
     rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
     gone AS (SELECT DISTINCT rid, i + j AS p FROM win JOIN rep USING (k), unnest(range(0, 35)) AS u(j)),
     words AS (SELECT d.rid, t.p, w[t.p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
     kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


@query
def op5_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))
