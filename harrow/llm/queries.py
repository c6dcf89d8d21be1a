"""The numbered queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.centroids import centroid_clusters
from harrow.llm.decontaminate import contaminated
from harrow.llm.language import languages
from harrow.llm.lines import lines_per_document
from harrow.llm.merkle import manifest
from harrow.llm.nbest import decode, encode
from harrow.llm.neighbours import nearest_neighbours
from harrow.llm.ngramjoin import ngram_components
from harrow.llm.packing import packed
from harrow.llm.quality import quality_scores
from harrow.llm.suffixes import without_repeats
from harrow.llm.tokenfile import token_files
from harrow.llm.transducer import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed value: the id that ends a document.
END_ID = 2


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) -> DataFrame function, with its SQL where there is one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"), word_tokenizer(), END_ID)


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), word_tokenizer())


@query("op4_neighbours")
def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"))


@query("op5_language")
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = without_repeats(table(spark, folder, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("remaining", 256)).drop("remaining")


# Segmentations asked for of each text.
N_BEST = 4


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = public_tokenizers.path("piece_bpe_32k.model")
    whole = F.coalesce("text", F.lit(""))
    coded = encode(docs, model, N_BEST, F.col("doc_id"), F.octet_length(whole).alias("n_bytes"), F.xxhash64(whole).alias("h"))
    back = decode(coded.withColumn("n_best", F.size("nbest")).withColumn("last_score", F.col("nbest")[F.size("nbest") - 1]["score"]).drop("nbest"), model)
    return back.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        "n_pieces",
        F.crc32("ids").alias("ids_crc32"),
        "score",
        "n_best",
        "last_score",
        (F.xxhash64("decoded") == F.col("h")).alias("round_trip"),
    )


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = lines_per_document(table(spark, folder, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op9_ngram_components")
def op9_ngram_components(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"), width=4, num=85, den=100)


@query("op10_quality")
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _clusters_sql(clusters: int, rounds: int) -> str:
    """Vectors against all centroids, round by round."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c
  FROM kept QUALIFY cluster < {clusters})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, min({{'d': list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, 65)]), 'k': cluster}}) AS near
  FROM kept, c{r} GROUP BY vec_id, v)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(list(m ORDER BY i) FILTER (WHERE m IS NOT NULL), any_value(c)) AS c FROM c{r} LEFT JOIN (
    SELECT near.k AS cluster, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM a{r}, range(1, 65) AS t(i) GROUP BY ALL) USING (cluster) GROUP BY cluster)"""
            )
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, near.k AS cluster, CAST(near.d AS BIGINT) AS distance,
  CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON cluster = near.k"""


@query("op11_centroids", _clusters_sql(40, 5))
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings")).drop("centroid")


def _hashed(columns: str, n_chars: str) -> str:
    values = [c if c != "n_chars" else n_chars for c in columns.split()]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


def _manifest_sql() -> str:
    """Trees level by level, then each leaf's way up; '' stands for the tree over the groups."""
    columns = "doc_id source lang n_chars text"
    changed = "CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END"
    # crc32 bit by bit over the bytes of the decimal doc_id
    crc = """list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)),
        lambda x, _: xor(x >> 1, (x & 1) * 3988292384::BIGINT)))"""
    climb = """
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value(n + 1) // 2
  FROM {0} WHERE n > 1 GROUP BY tree, level, pos // 2"""
    way = """
  SELECT w.id, w.tree, w.level + 1, w.pos // 2, w.n,
    CASE WHEN s.h IS NULL THEN sha256(w.h) WHEN w.pos % 2 = 0 THEN sha256(w.h || s.h) ELSE sha256(s.h || w.h) END,
    w.proof || coalesce(s.h, '')
  FROM {0} w LEFT JOIN {1} s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1)
  WHERE w.level < w.n"""
    return f"""WITH RECURSIVE crcs AS (SELECT *, xor({crc}, 4294967295::BIGINT) AS crc FROM documents),
leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '-') AS tree, {_hashed(columns, "n_chars")} AS leaf,
    {_hashed(columns, f"({changed})")} AS claimed FROM crcs),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
nodes AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM placed UNION ALL {climb.format("nodes")}),
subroots AS MATERIALIZED (
  SELECT tree AS name, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (SELECT '' AS tree, 0 AS level, pos, subroot AS h, n FROM subroots UNION ALL {climb.format("tops")}),
ways AS (
  SELECT id, placed.tree, 0 AS level, placed.pos, height AS n, claimed AS h, '' AS proof
  FROM placed JOIN subroots ON name = tree UNION ALL {way.format("ways", "nodes")}),
ends AS (
  SELECT w.id, '' AS tree, 0 AS level, s.pos, (SELECT max(level) FROM tops) AS n, w.h, w.proof
  FROM ways w JOIN subroots s ON s.name = w.tree WHERE w.level = w.n UNION ALL {way.format("ends", "tops")})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, ends.h AS folded_root, ends.h = root AS verified
FROM placed JOIN subroots ON name = placed.tree JOIN ends USING (id), (SELECT h AS root FROM tops WHERE n = 1)
WHERE ends.level = ends.n"""


def tampered() -> Column:
    """Whether 7 divides the crc32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


@query("op12_merkle_manifest", _manifest_sql())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    claimed = F.when(tampered(), F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    checked = manifest(table(spark, folder, "documents"), claimed={"n_chars": claimed})
    return checked.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified"
    )


# Fixed value: the id that ends a packed document.
PACKED_END_ID = 1


@query("op13_packing")
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packed(table(spark, folder, "documents"), word_tokenizer(), PACKED_END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
