"""The opN queries: each operator of this subpackage over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepframe.llm import langid, pii, toxicity
from stepframe.llm.bpe import bpe_digests
from stepframe.llm.chat import format_chats
from stepframe.llm.media import media_digests
from stepframe.llm.ngram_join import similar_groups
from stepframe.llm.packing import pack
from stepframe.llm.token_output import token_digests
from stepframe.llm.topk import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op4_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_packing": op2_packing,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_media_webp": op4_media_webp,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_toxicity": op6_toxicity,
    "op7_chat_format": op7_chat_format,
    "op8_personal_data": op8_personal_data,
    "op9_topk_hamming": op9_topk_hamming,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    # every user message is a call of 'reply'; its dependency lies two turns before, so turns are a topological order
    "op7_chat_format": """
        WITH m AS (SELECT conv_id, turn, role, text, CAST(floor(turn / 1024) AS BIGINT) AS segment FROM conversations),
        c AS (SELECT u.conv_id, u.segment, u.turn, a.turn AS result_turn FROM m u LEFT JOIN m a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
        cj AS (SELECT c.conv_id, c.segment, count(*) AS n_calls, count(result_turn) AS n_linked, string_agg('{"arguments":{"prompt":' || CAST(to_json(m.text) AS VARCHAR) || ',"turn":' || c.turn || '},"id":"c' || c.conv_id || '-' || c.turn || '","linked":' || CASE WHEN result_turn IS NULL THEN 'false' ELSE 'true' END || ',"name":"reply"' || CASE WHEN result_turn IS NULL THEN '' ELSE ',"result_turn":' || result_turn END || ',"turn":' || c.turn || ',"valid":true}', ',' ORDER BY c.turn) AS calls
               FROM c JOIN m ON m.conv_id = c.conv_id AND m.turn = c.turn GROUP BY 1, 2),
        mj AS (SELECT conv_id, segment, count(*) AS n_messages, string_agg('{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || ',"turn":' || turn || '}', ',' ORDER BY turn) AS messages FROM m GROUP BY 1, 2)
        SELECT mj.conv_id, mj.segment, n_messages, coalesce(n_calls, 0) AS n_calls, coalesce(n_linked, 0) AS n_linked, coalesce(n_calls, 0) AS n_valid,
               '{"calls":[' || coalesce(calls, '') || '],"id":' || mj.conv_id || ',"messages":[' || messages || '],"segment":' || mj.segment || '}' AS chat
        FROM mj LEFT JOIN cj ON cj.conv_id = mj.conv_id AND cj.segment = mj.segment""",
    "op9_topk_hamming": """
        WITH e AS (SELECT vec_id, embedding FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(sum(CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END) AS BIGINT) AS distance
              FROM e q JOIN e ON q.vec_id <> e.vec_id AND q.vec_id % 50 = 0, range(1, 65) t(i) GROUP BY 1, 2)
        SELECT query_id, "rank", vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS "rank" FROM d) WHERE "rank" <= 10""",
}
