"""The registered query of each operator: whole tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, fingerprints, hard_negatives, lm_score, minhash, mixing, pii, prefix_trie, suffix_dedup, token_counts, toxicity
from .common import crc_bucket, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_score.score_texts(docs, lm_score.training_rows(), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: A key for the driver's synthetic documents; real ones need a secret of their own.
SAMPLE_KEY = "surrogates of the synthetic documents"


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), SAMPLE_KEY)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, toxicity.not_held_out())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    read = chat.read_back(chat.format_trees(chat.chain_messages(turns.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_byte_bpe, op3_suffix_dedup, op4_token_counts, op5_minhash_near_dedup, op6_pii_surrogates, op7_fingerprints, op8_toxicity, op9_chat_formatting, op10_decontamination, op11_prefix_trie, op12_hard_negatives, op13_source_mixing)
}

#: DuckDB SQL for the operators that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op9_chat_formatting": """
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(24 + length(role) + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))) AS BIGINT) AS formatted_chars
        FROM said GROUP BY conv_id""",
    "op10_decontamination": """
        WITH said AS (
            SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM
                (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
        asked AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[p : p + least(10, len(words)) - 1], ' ') AS run
            FROM asked, unnest(range(1, greatest(1, len(words) - 9) + 1)) t(p) WHERE len(words) > 0),
        sizes AS (SELECT DISTINCT n FROM windows),
        runs AS (
            SELECT doc_id, n, p, array_to_string(words[p : p + n - 1], ' ') AS run
            FROM said, sizes, unnest(range(1, len(words) - n + 2)) t(p)),
        found AS (SELECT doc_id, p, r.n, item_id FROM runs r JOIN windows w ON r.run = w.run AND r.n = w.n),
        covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(p, p + n)) t(k) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM said s LEFT JOIN covered c USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_prefix_trie": """
        WITH u AS (
            SELECT conv_id, length(text) AS chars, unit, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unit) AS pos
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS unit
                FROM conversations WHERE conv_id IS NOT NULL)),
        c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
            list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) % 6 AS h FROM u),
        rebuilt AS (
            SELECT c.conv_id, pos, unit, chars, 0 AS part FROM c JOIN u ON u.conv_id = base AND pos <= h
            UNION ALL SELECT u.conv_id, pos, unit, chars, 1 FROM u JOIN c USING (conv_id) WHERE pos > h),
        paths AS (
            SELECT conv_id, chars, string_agg(unit, '') OVER w AS path, row_number() OVER w AS depth
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
            UNION ALL SELECT conv_id, 0, '', 0 FROM c),
        ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS over FROM paths),
        nodes AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256
            FROM ended GROUP BY path, depth),
        kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        own AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
        sums AS (SELECT left(path, 32 * d) AS path, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(saved) AS saved FROM own, unnest(range(0, depth + 1)) t(d) GROUP BY 1)
        SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, o.ends_sha256
        FROM own o JOIN sums s USING (path) LEFT JOIN own p ON o.depth > 0 AND p.path = left(o.path, 32 * (o.depth - 1))""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
            FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
}
