"""Token interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.operators import interactions, terms
from faultsift.operators.sampling import hash_number
from faultsift.session import stage

# Every token has one of the embeddings, picked by its digest.
TOKEN_VECTORS = """
words AS (SELECT DISTINCT unnest(tokens) AS token FROM turn_tokens),
word_v AS (
  SELECT token, embedding::DOUBLE[] AS v FROM words, embeddings
  WHERE vec_id = ('0x' || substr(md5(token), 1, 13))::BIGINT % (SELECT count(*) FROM embeddings))"""

QUERY_IDF = """
query_tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(query) AS term FROM dialogue) GROUP BY ALL),
query_idf AS (SELECT term, log2((SELECT count(*) FROM dialogue)::DOUBLE / count(*)) AS idf FROM query_tf GROUP BY 1)"""


def _token_vectors(spark: SparkSession, sf_dir: str, samples: DataFrame) -> DataFrame:
    words = samples.select(F.explode(F.concat("query", "code")).alias("token")).distinct()
    n = data.size_of(data.table(spark, sf_dir, "embeddings"))
    keyed = words.withColumn("vec_id", F.pmod(hash_number(F.md5("token")), n))
    return keyed.join(data.vectors(spark, sf_dir), "vec_id").select("token", "vector")


def _idf(samples: DataFrame, base: float | None = 2) -> DataFrame:
    tf = terms.term_frequencies(samples, ["conv_id", "turn"], F.col("query"))
    return terms.idf_table(tf, samples, base)


def _cells(spark: SparkSession, sf_dir: str, form) -> DataFrame:
    """The interaction matrix of the dialogues in the form of an operator, long or listed."""
    samples = stage(data.dialogue(spark, sf_dir))
    vectors = _token_vectors(spark, sf_dir, samples)
    return form(samples, ["conv_id", "turn"], F.col("query"), F.col("code"), vectors, _idf(samples))


CELLS = f"""
{data.DIALOGUE}, {TOKEN_VECTORS}, {QUERY_IDF},
q AS (SELECT conv_id, turn, unnest(query) AS q_token, unnest(range(len(query))) AS q_pos FROM dialogue),
c AS (SELECT conv_id, turn, unnest(code) AS c_token, unnest(range(len(code))) AS c_pos FROM dialogue),
pairs AS (SELECT q.conv_id, q.turn, q_pos, c_pos, q_token, c_token FROM q JOIN c ON q.conv_id = c.conv_id AND q.turn = c.turn),
sims AS (
  SELECT q_token, c_token, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS sim
  FROM (SELECT DISTINCT q_token, c_token FROM pairs) JOIN word_v a ON a.token = q_token JOIN word_v b ON b.token = c_token),
cells AS (SELECT p.*, sim, coalesce(idf, 1.0) AS idf FROM pairs p JOIN sims USING (q_token, c_token) LEFT JOIN query_idf ON term = q_token)"""


@query(
    f"""
WITH {CELLS}
SELECT conv_id, turn, c_pos::INTEGER AS c_pos, count(*) AS cells, round(max(sim), 6) AS best, round(sum(sim * idf), 5) AS weighted
FROM cells GROUP BY ALL"""
)
def interaction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity and idf of every token pair of a sample, summed up per code position."""
    return _cells(spark, sf_dir, interactions.matrix).groupBy("conv_id", "turn", "c_pos").agg(
        F.count(F.lit(1)).alias("cells"),
        F.round(F.max("sim"), 6).alias("best"),
        F.round(F.sum(F.col("sim") * F.col("idf")), 5).alias("weighted"),
    )


@query(
    f"""
WITH {CELLS}, width AS (SELECT max(len(query)) AS w FROM dialogue)
SELECT conv_id, turn, c_pos::INTEGER AS c_pos, round(sum(sim) + sum(idf), 5) AS total, round(max(CASE WHEN q_pos = 0 THEN idf END), 6) AS second,
       any_value(2 * 400)::INTEGER AS width
FROM cells, width GROUP BY ALL"""
)
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as padded arrays, similarity and idf in turn."""
    rows = interactions.matrix_rows(_cells(spark, sf_dir, interactions.listed_matrix), ["conv_id", "turn"], 400)
    total = F.aggregate("row", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "conv_id", "turn", "c_pos", F.round(total, 5).alias("total"),
        F.round(F.element_at("row", 2), 6).alias("second"), F.size("row").alias("width"),
    )


CORE = "core AS (SELECT word, row_number() OVER (ORDER BY word) + 1 AS id FROM (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS word FROM benchmark) WHERE word <> '')"


@query(
    f"""
WITH {data.DIALOGUE}, {CORE},
c AS (SELECT conv_id, turn, unnest(code) AS token, unnest(range(len(code))) AS pos FROM dialogue)
SELECT conv_id, turn, pos::INTEGER AS pos, token, coalesce(id, 1) AS id FROM c LEFT JOIN core ON word = token"""
)
def core_term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of core terms at every code position."""
    return interactions.core_term_ids(
        data.dialogue(spark, sf_dir), ["conv_id", "turn"], F.col("code"), _core(spark, sf_dir)
    )


def _core(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = data.table(spark, sf_dir, "benchmark")
    words = items.select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return interactions.core_terms(words)


@query(
    f"""
WITH {data.DIALOGUE}, {CORE},
c AS (SELECT conv_id, turn, unnest(code) AS token, unnest(range(len(code))) AS pos FROM dialogue),
i AS (SELECT conv_id, turn, pos, coalesce(id, 1) AS id FROM c LEFT JOIN core ON word = token)
SELECT conv_id, turn, string_agg(id, ' ' ORDER BY pos) || repeat(' 0', 4000 - count(*)::INTEGER) AS core_terms FROM i GROUP BY ALL"""
)
def padded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core term ids of a sample, zeros up to the code size of the ranker."""
    samples = interactions.fitting(data.dialogue(spark, sf_dir), "query", "code", 4000, 4000)
    ids = interactions.core_term_ids(samples, ["conv_id", "turn"], F.col("code"), _core(spark, sf_dir))
    padded = interactions.padded_terms(ids, ["conv_id", "turn"], 4000)
    return padded.withColumn("core_terms", F.array_join(F.col("core_terms").cast("array<string>"), " "))


@query(
    f"""
WITH {data.DIALOGUE}
SELECT count(*) AS utterances, sum(len(query))::BIGINT AS query_tokens, sum(len(code))::BIGINT AS code_tokens,
  (SELECT count(*) FROM (SELECT DISTINCT unnest(query) FROM dialogue)) AS unique_query_tokens,
  (SELECT count(*) FROM (SELECT unnest(query) AS t FROM dialogue UNION SELECT unnest(code) FROM dialogue)) AS unique_tokens
FROM dialogue"""
)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the corpus and of its vocabularies."""
    return interactions.corpus_statistics(data.dialogue(spark, sf_dir), F.col("query"), F.col("code"))


@query(
    f"""
WITH {data.DIALOGUE}
SELECT 'query' AS side, len(query) AS bucket, count(*) AS n FROM dialogue GROUP BY ALL
UNION ALL SELECT 'code', len(code) // 10, count(*) FROM dialogue GROUP BY ALL"""
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of query lengths and of code lengths in tens."""
    samples = data.dialogue(spark, sf_dir)
    queries = interactions.length_histogram(samples, F.size("query")).withColumn("side", F.lit("query"))
    codes = interactions.length_histogram(samples, F.size("code"), 10).withColumn("side", F.lit("code"))
    return queries.unionByName(codes).select("side", "bucket", "n")


@query(
    f"""
WITH {data.DOC_TF}
SELECT term, row_number() OVER (ORDER BY term) + 1 AS id FROM (SELECT DISTINCT term FROM doc_tf)"""
)
def vocabulary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted vocabulary with ids from 2."""
    return terms.vocabulary_ids(data.doc_tf(spark, sf_dir))


@query(
    f"""
WITH {data.DIALOGUE}, {QUERY_IDF},
code_tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(code) AS term FROM dialogue) GROUP BY ALL)
SELECT conv_id, turn, term, tf, round(coalesce(idf, 1.0), 6) AS idf FROM code_tf LEFT JOIN query_idf USING (term)"""
)
def idf_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idf of code terms over the reports, 1 for unknown terms."""
    samples = data.dialogue(spark, sf_dir)
    code_tf = terms.term_frequencies(samples, ["conv_id", "turn"], F.col("code"))
    out = interactions.idf_or_default(code_tf, _idf(samples).drop("df"))
    return out.select("conv_id", "turn", "term", "tf", F.round("idf", 6).alias("idf"))


@query(
    f"""
WITH {data.DIALOGUE}
SELECT conv_id, turn, least(len(query), 20)::INTEGER AS query_len, least(len(code), 100)::INTEGER AS code_len,
       md5(array_to_string(code[1:100], ' ')) AS code FROM dialogue"""
)
def prepared_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists cut to the input size of the ranker, with their lengths."""
    from faultsift.plans import datasets

    out = datasets.prepared_corpus(data.dialogue(spark, sf_dir), 20, 100, "query", "code")
    return out.select("conv_id", "turn", "query_len", "code_len", F.md5(F.array_join("code", " ")).alias("code"))


@query(
    f"""
WITH {data.DIALOGUE}
SELECT CASE WHEN conv_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, side, count(*) AS n, sum(len(tokens))::BIGINT AS n_tokens
FROM (SELECT conv_id, 'report' AS side, query AS tokens FROM dialogue UNION ALL SELECT conv_id, 'code', code FROM dialogue) GROUP BY ALL"""
)
def training_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to learn word vectors from: train and test, reports and code."""
    from faultsift.sources import writers

    samples = data.dialogue(spark, sf_dir).select(
        F.struct("conv_id", "turn").alias("key"), F.col("query").alias("report_tokens"), F.col("code").alias("code_tokens")
    )
    even = F.pmod(F.col("key.conv_id"), F.lit(2)) == 0
    corpus = writers.corpus(samples.where(even), samples.where(~even))
    return corpus.groupBy("split", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).cast("bigint").alias("n_tokens")
    )
