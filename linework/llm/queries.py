"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linework.llm import alignment, bottomk, brown_lm, chat_format, gif, grammar, knn_quality, lsm_dedup, packing, pii_weak, suffix_dedup, trie, wfst_pieces
from linework.llm.common import read_table

#: Where the public tokenizers' files are; None asks the installed package that ships them.
TOKENIZERS: str | None = None
SPACE_TOKENIZER, PIECE_MODEL, BYTE_TOKENIZER = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(read_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_key")


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(SPACE_TOKENIZER))


def op5_wfst_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path(PIECE_MODEL), "rb") as f:
        return wfst_pieces.piece_digests(read_table(spark, sf_dir, "documents"), f.read())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.class_bigram_scores(read_table(spark, sf_dir, "documents"))


def op8_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-7, t, role, r"\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.turns(read_table(spark, sf_dir, "conversations")).unionByName(planted))


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.detect(read_table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_key")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_texts(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_MODEL))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.token_shards(read_table(spark, sf_dir, "documents"), tokenizer_path(SPACE_TOKENIZER))


SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept,
               sha256(body) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY body)""",
    "op8_chat_prefixes": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        s AS (SELECT *, 14 + 2 * length(role || text) - length(regexp_replace(role || text, '[\\<#:]', '', 'g')) AS n FROM t),
        u AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
        FROM u GROUP BY conv_id""",
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), d) AS k FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list(d ORDER BY k) AS ds, list(n ORDER BY k) AS ns, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS crc FROM t GROUP BY conv_id),
        hs AS (SELECT *, xor(crc, 4294967295) % 6 AS h FROM own),
        seqs AS (SELECT c.conv_id, list_concat(coalesce(b.ds[1:c.h], []), c.ds[c.h + 1:]) AS ds, list_concat(coalesce(b.ns[1:c.h], []), c.ns[c.h + 1:]) AS ns
                 FROM hs c LEFT JOIN hs b ON b.conv_id = c.conv_id - c.conv_id % 100),
        cut AS (SELECT conv_id, len(ds) AS size, ds, ns, unnest(range(len(ds) + 1)) AS depth FROM seqs),
        members AS (SELECT conv_id, depth, size = depth AS ends, array_to_string(ds[1:depth], ' ') AS node, array_to_string(ds[1:depth - 1], ' ') AS up, CASE WHEN depth = 0 THEN 0 ELSE ns[depth] END AS n FROM cut),
        nodes AS (SELECT node, depth, any_value(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
                         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node, depth),
        kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
        known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.node = k.node),
        below AS (SELECT m.node AS top, k.node, any_value(k.saved) AS saved, any_value(k.n_children) AS kids FROM members m JOIN members x ON m.conv_id = x.conv_id AND x.depth >= m.depth
                  JOIN known k ON k.node = x.node GROUP BY m.node, k.node),
        sums AS (SELECT top AS node, count(*) FILTER (kids = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY top)
        SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
        FROM known k JOIN sums s ON s.node = k.node LEFT JOIN known p ON p.node = k.up AND k.depth > 0""",
    "op10_minhash_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS items FROM w),
        sized AS (SELECT doc_id, len(items) AS n, items, CASE WHEN len(items) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(items), chr(10)))) ELSE doc_id END AS class_id FROM sets),
        sh AS (SELECT doc_id, n, unnest(items) AS item FROM sized),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        ways AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS node, doc_id AS seen FROM sized UNION SELECT reach.node, ways.y FROM reach JOIN ways ON reach.seen = ways.x)
        SELECT s.doc_id, s.n AS n_shingles, class_id, min(seen) AS component_id, s.doc_id = min(seen) AS kept FROM sized s JOIN reach ON node = s.doc_id GROUP BY s.doc_id, s.n, class_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
