"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from larkspur.llm import ann, ctw, embedding_dedup, secrets
from larkspur.llm.chat import digests, format_conversations
from larkspur.llm.common import remainder, table
from larkspur.llm.language_id import identify
from larkspur.llm.minhash_dedup import near_duplicates
from larkspur.llm.mixing import mix
from larkspur.llm.packing import pack
from larkspur.llm.quality import classify

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    return identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 0
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 10) == 0
    scored = ctw.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: The conversation that op10 adds: texts that look like the format's own marks.
_TRAP = r"\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRAP).alias("text"))
    return digests(format_conversations(rows.unionByName(extra)))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_ctw_score": op5_ctw_score,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_ann": op8_ann,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_chat": op10_chat,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_minhash_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN list_aggregate(words, 'string_agg', ' ')
                ELSE list_aggregate(words[i:i + 4], 'string_agg', ' ') END AS sh
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (
            SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 75 * (p.n + q.n - x)
        ),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS src, a AS dst FROM e UNION SELECT r.src, e.b FROM r JOIN e ON e.a = r.dst),
        m AS (SELECT src, min(dst) AS root FROM r GROUP BY src)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id,
            coalesce(m.root, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.src = d.doc_id
    """,
    "op6_mixing": """
        WITH z AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
        ),
        g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM g),
        l AS (
            SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (ORDER BY source_size / weight, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
            FROM w
        ),
        f AS (SELECT *, level * weight >= 3 * source_size AS filled FROM l),
        t AS (
            SELECT source, source_size, CASE WHEN filled THEN source_size * 3.0::DOUBLE ELSE
                (SELECT arg_min(level, (source_size / weight, weight)) FROM f WHERE NOT filled) * weight END AS target,
                md5('1|' || coalesce('s' || source, '-')) AS h
            FROM f
        ),
        u AS (
            SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected,
                (((((instr('0123456789abcdef', h[1]) - 1) * 16 + instr('0123456789abcdef', h[2]) - 1) * 16 + instr('0123456789abcdef', h[3]) - 1) * 16
                    + instr('0123456789abcdef', h[4]) - 1) * 16 + instr('0123456789abcdef', h[5]) - 1) / 1048576.0::DOUBLE AS off
            FROM t
        ),
        m AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '-')) AS h FROM z),
        y AS (
            SELECT doc_id, source, size, (((instr('0123456789abcdef', h[1]) - 1) * 16 + instr('0123456789abcdef', h[2]) - 1) * 16
                + instr('0123456789abcdef', h[3]) - 1) % 64 AS k
            FROM m
        ),
        p AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 3, 0)),
                k, size, doc_id) AS i
            FROM y
        )
        SELECT p.doc_id, p.size, u.source_size, CAST(u.target AS DOUBLE) AS target,
            CAST((floor(p.i * u.expected + u.off) - floor((p.i - 1) * u.expected + u.off)) * p.size AS BIGINT) AS taken
        FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source
    """,
    "op10_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        e AS (
            SELECT *, len(text) + len(regexp_extract_all(text, '\\')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: len(x))), 0)
                + len(regexp_extract_all(text, '</turn>')) AS n
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(4 + len(role) + 2 + n + 8) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op8_ann": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
        ),
        d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])), lambda s, v: s + v)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op9_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
        ),
        e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95),
        r AS (SELECT a AS src, a AS dst FROM e UNION SELECT r.src, e.b FROM r JOIN e ON e.a = r.dst),
        m AS (SELECT src, min(dst) AS root FROM r GROUP BY src),
        n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
        SELECT t.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(m.root, t.vec_id) AS component_id, coalesce(m.root, t.vec_id) = t.vec_id AS kept
        FROM embeddings t LEFT JOIN m ON m.src = t.vec_id LEFT JOIN n ON n.a = t.vec_id
    """,
}
