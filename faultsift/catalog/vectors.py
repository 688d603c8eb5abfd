"""Term weights, sparse and dense similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.registry import query
from faultsift.functions.text import class_name_text, identifier_tokens
from faultsift.operators import ranking, scoring, terms
from faultsift.session import stage


@query(
    f"""
WITH {data.POOL}, {data.ITEM_TF}, {data.DOC_TF}, {data.pair_cosine_sql("sims", "pool", "item_tf", "doc_tf", "item_id", "doc_id")}
SELECT item_id, doc_id, round(similarity, 6) AS similarity FROM sims"""
)
def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-text TF-IDF cosine of every candidate pair."""
    pairs = data.pool(spark, sf_dir).select("item_id", "doc_id")
    out = terms.pair_cosine(pairs, data.item_tf(spark, sf_dir), data.doc_tf(spark, sf_dir), ["item_id"], ["doc_id"])
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""
WITH {data.POOL}, {data.ITEM_TF}, {data.DOC_TF}, {data.pair_cosine_sql("sims", "pool", "item_tf", "doc_tf", "item_id", "doc_id")}
SELECT item_id AS report, doc_id AS file, similarity, rank FROM (
  SELECT item_id, doc_id, round(similarity, 6) AS similarity,
         row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 6) DESC, doc_id) AS rank FROM sims)
WHERE rank <= 10"""
)
def localize_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar files of the pool of every report."""
    best = ranking.top_k(pair_cosine(spark, sf_dir), ["item_id"], "doc_id", 10, "similarity")
    return best.select(F.col("item_id").alias("report"), F.col("doc_id").alias("file"), "similarity", "rank")


@query(
    f"""
WITH {data.REPORTS}, {data.TOUCHES},
names AS (SELECT p_partkey AS file, replace(p_brand, '#', '') AS names FROM part),
{data.tf_sql("report_tf", "reports", "report_id", "raw_text")},
{data.tf_sql("class_tf", "names", "file", "names")},
pairs AS (SELECT report_id, file FROM touches),
{data.pair_cosine_sql("sims", "pairs", "report_tf", "class_tf", "report_id", "file")}
SELECT report_id, file, round(similarity, 6) AS classname_similarity FROM sims"""
)
def class_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of a report to the class names of the files it fixed."""
    reports, sources = data.reports(spark, sf_dir), data.sources(spark, sf_dir)
    report_tf = terms.term_frequencies(reports, ["report_id"], identifier_tokens(F.col("raw_text")))
    class_tf = terms.term_frequencies(sources, ["file"], identifier_tokens(class_name_text(F.col("file_content"))))
    pairs = data.touches(spark, sf_dir).select("report_id", "file")
    out = terms.pair_cosine(pairs, report_tf, class_tf, ["report_id"], ["file"], "classname_similarity")
    return out.withColumn("classname_similarity", F.round("classname_similarity", 6))


IDF = """
vocabulary AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM doc_tf GROUP BY 1)"""


@query(f"WITH {data.DOC_TF}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM vocabulary")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and ln(D / df) of every term of the documents."""
    out = terms.idf_table(data.doc_tf(spark, sf_dir), data.table(spark, sf_dir, "documents"))
    return out.withColumn("idf", F.round("idf", 6))


@query(
    f"""
WITH {data.ITEM_TF}, {data.DOC_TF}, {IDF}
SELECT item_id, term, tf, round(ln(tf + 1) * idf, 6) AS weight FROM item_tf JOIN vocabulary USING (term)"""
)
def report_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report vectors over the vocabulary of the sources."""
    vocabulary = terms.idf_table(data.doc_tf(spark, sf_dir), data.table(spark, sf_dir, "documents"))
    out = terms.tfidf(data.item_tf(spark, sf_dir), vocabulary)
    return out.withColumn("weight", F.round("weight", 6))


@query(
    f"""
WITH {data.DOC_TF}, {IDF}
SELECT doc_id, count(*) AS terms, round(sqrt(sum(pow(ln(tf + 1) * idf, 2))), 6) AS length,
       round(max(ln(tf + 1) * idf), 6) AS top_weight
FROM doc_tf JOIN vocabulary USING (term) GROUP BY 1"""
)
def corpus_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source vectors: terms, length and largest weight per document."""
    tf = data.doc_tf(spark, sf_dir)
    weights = terms.tfidf(tf, terms.idf_table(tf, data.table(spark, sf_dir, "documents")))
    square = F.col("weight") * F.col("weight")
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.round(F.sqrt(F.sum(square)), 6).alias("length"),
        F.round(F.max("weight"), 6).alias("top_weight"),
    )


@query(
    f"""
WITH {data.DOC_TF},
v AS (SELECT term, log2((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM doc_tf GROUP BY 1),
w AS (SELECT doc_id, term, tf * idf AS weight FROM doc_tf JOIN v USING (term)),
n AS (SELECT doc_id, sqrt(sum(weight * weight)) AS length FROM w GROUP BY 1 HAVING sum(weight * weight) > 0)
SELECT doc_id, count(*) AS terms, round(max(weight / length), 6) AS top_weight, round(sum(weight / length), 6) AS total
FROM w JOIN n USING (doc_id) GROUP BY 1"""
)
def unit_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with log2 idf scaled to length one."""
    tf = stage(data.doc_tf(spark, sf_dir))
    vocabulary = terms.idf_table(tf, data.table(spark, sf_dir, "documents"), base=2)
    return terms.unit_tfidf(tf, vocabulary, ["doc_id"]).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.round(F.max("weight"), 6).alias("top_weight"),
        F.round(F.sum("weight"), 6).alias("total"),
    )


SPARSE = f"""
item_w AS (SELECT item_id, term, ln(tf + 1) * idf AS w FROM item_tf JOIN vocabulary USING (term)),
doc_w AS (SELECT doc_id, term, ln(tf + 1) * idf AS w FROM doc_tf JOIN vocabulary USING (term)),
item_len AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM item_w GROUP BY 1),
doc_len AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM doc_w GROUP BY 1),
sparse AS (
  SELECT p.*, CASE WHEN i.l * d.l > 0 THEN coalesce(dot, 0) / (i.l * d.l) ELSE 0 END AS cosine
  FROM pool p LEFT JOIN item_len i ON p.item_id = i.item_id LEFT JOIN doc_len d ON p.doc_id = d.doc_id
  LEFT JOIN (SELECT p.item_id, p.doc_id, sum(a.w * b.w) AS dot FROM pool p JOIN item_w a ON p.item_id = a.item_id
             JOIN doc_w b ON p.doc_id = b.doc_id AND a.term = b.term GROUP BY ALL) s
  ON p.item_id = s.item_id AND p.doc_id = s.doc_id)"""


@query(
    f"""
WITH {data.POOL}, {data.ITEM_TF}, {data.DOC_TF}, {IDF}, {SPARSE}
SELECT item_id, doc_id, round(cosine, 6) AS cosine FROM sparse"""
)
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus TF-IDF cosine of every candidate pair."""
    doc_tf = data.doc_tf(spark, sf_dir)
    vocabulary = terms.idf_table(doc_tf, data.table(spark, sf_dir, "documents"))
    out = terms.sparse_cosine(
        data.pool(spark, sf_dir).select("item_id", "doc_id"),
        terms.tfidf(data.item_tf(spark, sf_dir), vocabulary),
        terms.tfidf(doc_tf, vocabulary),
        ["item_id"],
        ["doc_id"],
    )
    return out.withColumn("cosine", F.round("cosine", 6))


DENSE = f"""
{data.VECTORS},
dense AS (
  SELECT p.vec_id, p.other_id,
    round(list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS cosine
  FROM vector_pairs p JOIN vectors a ON p.vec_id = a.vec_id JOIN vectors b ON p.other_id = b.vec_id)"""


@query(f"WITH {DENSE} SELECT vec_id, other_id, cosine FROM dense")
def dense_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of dense vectors over a table of pairs."""
    out = scoring.dense_cosine(
        data.vector_pairs(spark, sf_dir),
        data.vectors(spark, sf_dir),
        data.vectors(spark, sf_dir, "other_id"),
        ["vec_id"],
        ["other_id"],
    )
    return out.withColumn("cosine", F.round("cosine", 6))


@query(
    f"""
WITH {DENSE}
SELECT vec_id, other_id, cosine, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other_id) AS rank FROM dense WHERE vec_id <> other_id)
WHERE rank <= 10"""
)
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors among the pairs."""
    pairs = dense_cosine(spark, sf_dir).where(F.col("vec_id") != F.col("other_id"))
    return ranking.top_k(pairs, ["vec_id"], "other_id", 10, "cosine")
