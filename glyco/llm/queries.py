"""Queries of this subpackage, each over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyco.llm import chat, exact, licenses, merkle, mixing, packing, pii, postings, quality, secrets, simhash, substrings, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its check when SQL can state it."""

    def register(func):
        QUERIES[name] = func
        if sql is not None:
            ORACLE[name] = sql
        return func

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_mix_sources")
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The 5:2:1 mix of all documents at 150 % of their words."""
    return mixing.mix(table(spark, folder, "documents"))


EXACT_SQL = """
WITH texts AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256
FROM texts"""


@query("op7_exact_dedup", EXACT_SQL)
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact.exact_groups(table(spark, folder, "documents"))


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash groups among all documents."""
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op9_length_buckets")
def op9_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in length buckets and token-budget batches."""
    return packing.pack(table(spark, folder, "documents"))


@query("op4_quality_lines")
def op4_quality_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Quality measures and verdicts of all documents."""
    docs = table(spark, folder, "documents")
    judged = quality.assess(docs.select("doc_id", "text"), quality.fit_model(docs, table(spark, folder, "labels")))
    return judged.drop("text")


CONTROL_TEXT = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '<', '\l'), '#', '\h') AS body,
         replace(replace(replace(replace(role, '\', '\s'), '<', '\l'), '#', '\h'), ':', '\c') AS name
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
       sum(length('### ') + length(name) + length(': ') + length(body) + length('</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""


@query("op2_format_chats", CHAT_SQL)
def op2_format_chats(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations (turn rows) and conversation -7 (a message list), read back from the formatted text."""
    nested = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.array(*[F.struct(F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("content")) for r in ("user", "assistant")]).alias("messages"),
    )
    turns = chat.canonical(table(spark, folder, "conversations")).unionByName(chat.canonical(nested))
    out = chat.format_chats(turns)
    out = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License detections in all documents."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    docs = table(spark, folder, "documents")
    return pii.scan(docs, pii.fit(docs))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scan(table(spark, folder, "documents"))


@query("op8_repeated_passages")
def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that documents share."""
    return substrings.repeated_passages(table(spark, folder, "documents"))


# CRC-32 of a decimal number: bytes are folded with the reversed polynomial, one bit at a time.
CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split({0}::VARCHAR, '')]),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295::BIGINT)"""


def _merkle_told(text: str) -> str:
    plain = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in plain)


def _merkle_up(name: str, leaves: str) -> str:
    """A recursive CTE with every node of the trees over ``leaves`` (tree, pos, size, digest)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, size, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE size > 1 GROUP BY tree, level, pos // 8, size)"""


def _merkle_fold(name: str, start: str, nodes: str) -> str:
    """A recursive CTE that folds the values of ``start`` (id, tree, pos, value, proof) up to the root of their tree."""
    return f"""{name} AS (
  SELECT id, tree, 0 AS level, pos, value, proof FROM {start}
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.pos // 8,
         sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.value ELSE n.digest END, '' ORDER BY n.pos)),
         any_value(f.proof) || coalesce(string_agg(CASE WHEN n.pos <> f.pos THEN n.digest END, '' ORDER BY n.pos), '')
  FROM {name} f JOIN {nodes} n ON n.tree = f.tree AND n.level = f.level AND n.pos // 8 = f.pos // 8
  WHERE n.size > 1 GROUP BY f.id, f.tree, f.level, f.pos)"""


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MERKLE_SQL = f"""
WITH RECURSIVE told AS (
  SELECT doc_id, lang, sha256({_merkle_told("text")}) AS leaf, sha256({_merkle_told(LOWERED)}) AS low,
         coalesce({CRC_SQL.format("doc_id")} % 3 = 0, FALSE) AS tampered
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS size
  FROM told),
base AS (SELECT tree, pos, size, leaf AS digest FROM leaves),
{_merkle_up("up", "base")},
subroots AS (SELECT -1 AS tree, tree AS pos, (SELECT max(tree) + 1 FROM leaves) AS size, digest FROM up WHERE size = 1),
{_merkle_up("top", "subroots")},
begun AS (SELECT id, tree, pos, CASE WHEN tampered THEN low ELSE leaf END AS value, '' AS proof FROM leaves),
{_merkle_fold("low_fold", "begun", "up")},
middle AS (
  SELECT id, -1 AS tree, tree AS pos, value, proof FROM low_fold
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
{_merkle_fold("top_fold", "middle", "top")},
ended AS (SELECT id, value, proof FROM top_fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.value AS folded_root,
       e.value = r.digest AS verified
FROM leaves l JOIN ended e USING (id) JOIN subroots s ON s.pos = l.tree CROSS JOIN (SELECT digest FROM top WHERE size = 1) r"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, roots and checked proofs of all documents."""
    return merkle.manifest(table(spark, folder, "documents"))


@query("op12_nearest_vectors")
def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every 20th embedding among all others."""
    return postings.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, {CRC_SQL.format("conv_id")} % 6 AS h FROM own),
turns AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.d, o.n FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.d, o.n FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS key, n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id),
nodes AS (
  SELECT s.key, s.depth, min(s.conv_id) AS conv_id, count(*) AS n_convs, any_value(s.n) AS n,
         sha256(coalesce(string_agg(CASE WHEN l.depth = s.depth THEN s.conv_id::VARCHAR END, ',' ORDER BY s.conv_id), '')) AS ends_sha256
  FROM steps s JOIN lengths l USING (conv_id) GROUP BY s.key, s.depth),
families AS (SELECT left(key, 32 * (depth::INT - 1)) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
grown AS (SELECT n.*, coalesce(f.n_children, 0) AS n_children FROM nodes n LEFT JOIN families f USING (key)),
below AS (
  SELECT left(key, 32 * up::INT) AS key, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM grown) GROUP BY 1)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, b.n_leaves, b.saved_tokens, g.ends_sha256
FROM grown g JOIN below b USING (key) LEFT JOIN grown p ON g.depth > 0 AND p.key = left(g.key, 32 * (g.depth::INT - 1))"""


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Trie nodes of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, folder, "conversations"))
