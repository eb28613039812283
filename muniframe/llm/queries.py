"""Queries of the training-data operators, each over its whole table, and their SQL texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, merkle, neardup, pii, quality, runs, secrets, sharding, suffix_dedup, token_counts, toxicity
from .sql import LEAKS, NEAR_GROUPS, REPEATS
from .tables import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


@query("op3_kneser_ney_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


@query("op7_suffix_array_decontamination", LEAKS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match", "longest_match_at")


#: A conversation whose texts are another template's control strings.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length('<|turn|><|says|><|end|>') + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op9_chat_format", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(tricky)))


@query("op10_min_max_near_dup", NEAR_GROUPS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_table(spark, sf_dir, "documents"))


@query("op1_suffix_array_dedup", REPEATS)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_trie_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op4_boosted_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


@query("op5_label_propagation_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


@query("op6_multiple_instance_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the checksum of the id, each tenth text repeats its words from word a on with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.array_remove(F.split("text", "[ \\t-\\r]+"), "").alias("words"))
    sized = words.withColumns({"n": F.size("words"), "g": F.expr("h div 10")}).withColumn("hit", (F.col("h") % 10 == 0) & (F.col("n") > 0))
    placed = sized.withColumn("a", F.when(F.col("hit"), F.expr("int(g % n)"))).withColumn("p", F.when(F.col("hit"), F.expr("int(1 + (n - a) div (3 + g % 8))")))
    looped = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a))")
    return placed.select("doc_id", F.when(F.col("hit"), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_looped(_table(spark, sf_dir, "documents"))).withColumn("best", runs.strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _manifest_sql(levels: int = 12) -> str:
    """Trees of runs of three, a level per step, for up to 3 ** ``levels`` leaves a source and as many sources. DuckDB has no crc32: bits one by one."""
    coded = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(f"({coded(c)})" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda t: CAST(ascii(t) AS BIGINT))), lambda c, b: {step}), 4294967295)"
    parts = [
        f"""WITH claims AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claimed FROM documents),
        leaves AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS leaf, {leaf("claimed")} AS claim FROM claims),
        nodes_0 AS MATERIALIZED (SELECT source, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, r) - 1 AS i, r, count(*) OVER (PARTITION BY source) AS n FROM leaves),
        path_0 AS MATERIALIZED (SELECT r, source, i, '' AS proof, claim AS f FROM nodes_0 JOIN (SELECT r, claim FROM leaves) USING (r))""",
    ]

    def climb(k: int, key: str) -> None:
        parts.append(f"""runs_{k} AS MATERIALIZED (SELECT {key}, i // 3 AS g, list(h ORDER BY i) AS hs, any_value(n) AS n FROM nodes_{k} GROUP BY ALL),
        nodes_{k + 1} AS MATERIALIZED (SELECT {key}, g AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 2) // 3 AS n FROM runs_{k}),
        path_{k + 1} AS MATERIALIZED (SELECT p.r, p.{key}, p.i // 3 AS i,
          CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[1:p.i % 3], '') || array_to_string(hs[p.i % 3 + 2:], '') END AS proof,
          CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(hs[1:p.i % 3], '') || f || array_to_string(hs[p.i % 3 + 2:], '')) END AS f
          FROM path_{k} p JOIN runs_{k} x ON p.{key} IS NOT DISTINCT FROM x.{key} AND p.i // 3 = x.g)""")

    for k in range(levels):
        climb(k, "source")
    k = levels + 1
    parts.append(f"""nodes_{k} AS MATERIALIZED (SELECT 0 AS zero, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes_{levels}),
        path_{k} AS MATERIALIZED (SELECT p.r, 0 AS zero, t.i, p.proof, p.f, t.h AS subroot FROM path_{levels} p JOIN nodes_{k} t ON p.source IS NOT DISTINCT FROM t.source)""")
    for j in range(k, k + levels):
        climb(j, "zero")
    last = k + levels
    return ",\n".join(parts) + f"""
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
        FROM path_{last} JOIN leaves USING (r) JOIN (SELECT r, subroot FROM path_{k}) USING (r), nodes_{last}"""


@query("op12_merkle_manifest", _manifest_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    claimed = F.when(told, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", merkle.leaf_digest([*columns, F.col("text")]).alias("leaf"), merkle.leaf_digest([*columns, claimed]).alias("claim"))
    proved = merkle.prove(merkle.build(leaves), ["doc_id", "leaf"], "claim")
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@query("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[f"n_{k}" for k in secrets.BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
