"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_plan

    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lexicon_bpe import encode_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


QUERIES = {"op1_mixing": op1_mixing, "op8_bpe": op8_bpe}

ORACLES: dict[str, str] = {}


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES["op6_line_dedup"] = op6_line_dedup

ORACLES["op6_line_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, i, parts[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS t(i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut
), repeated AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first_doc <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE first_doc IS NULL OR first_doc = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (k) GROUP BY doc_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_profiles, held_out, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit_profiles(docs.filter(~held_out()))
    done = identify(docs.select("doc_id", "text"), profiles)
    return done.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gif_media import store_texts

    kept = store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return kept.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("gif").cast("long").alias("media_bytes"),
        F.sha2("gif", 256).alias("media_sha256"),
        F.array_join(F.transform("frames", lambda f: F.concat_ws(";", f["start_ms"], *[F.array_join(f[c], ",") for c in ("hist_r", "hist_g", "hist_b")])), "|").alias("feature"),
    )


QUERIES |= {"op3_language_id": op3_language_id, "op2_gif_media": op2_gif_media}


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown_lm import fit_and_score
    from .language_id import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = held_out(folds=10)
    return fit_and_score(docs, ~kept).withColumn("held_out", kept)


QUERIES["op5_brown_lm"] = op5_brown_lm


def op7_rabitq_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rabitq_ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)


def op9_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .role_repair import repair

    done = repair(table(spark, sf_dir, "conversations"))
    return done.withColumn("rendered_sha256", F.sha2(F.col("rendered").cast("binary"), 256)).drop("rendered")


QUERIES |= {"op7_rabitq_ann": op7_rabitq_ann, "op9_role_repair": op9_role_repair}

ORACLES["op7_rabitq_ann"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op10_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .partenum_join import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_hash", "row_hash_2", "set_id")


QUERIES["op10_partenum_join"] = op10_partenum_join


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op4_suffix_dedup"] = op4_suffix_dedup


def op12_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .late_overwrite import late_sales

    return late_sales(table(spark, sf_dir, "sales"))


QUERIES["op12_late_overwrite"] = op12_late_overwrite


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES["op11_prefix_trie"] = op11_prefix_trie

#: crc32 of an id's decimal text, bit by bit: a byte enters, then eight shifts (-1).
_CRC_SQL = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

ORACLES["op11_prefix_trie"] = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id AS c, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM t GROUP BY conv_id
), h AS (
  SELECT c, turns, {_CRC_SQL.format("c")} % 4 AS h FROM own
), whole AS (
  SELECT h.c, list_concat(coalesce(b.turns, [])[:h.h], h.turns[h.h + 1:]) AS seq FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20
), prefixes AS (
  SELECT c, d, seq[:d] AS p, len(seq) = d AS ends FROM whole, unnest(generate_series(0, len(seq))) AS g(d)
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d
), kids AS (
  SELECT p[:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), whole_nodes AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p, d)
), sums AS (
  SELECT w.p[:j] AS p, j AS d, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM whole_nodes w, unnest(generate_series(0, w.d)) AS g(j) GROUP BY ALL
)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole_nodes w JOIN sums USING (p, d) LEFT JOIN nodes up ON up.d = w.d - 1 AND up.p = w.p[:w.d - 1]
"""


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out
    from .quality_trees import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score_quality(docs, trees).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES["op13_quality_trees"] = op13_quality_trees
