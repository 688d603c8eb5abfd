"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.catalog import data
from faultsift.catalog.porter_sql import porter_ctes
from faultsift.catalog.registry import query
from faultsift.functions import paths, stemming, text, words
from faultsift.plans import datasets

# The stop list these queries pass to the operators; a user passes the list of their choice.
STOP_WORDS = (
    "a an and are as at be been but by can could did do does don't for from had has have he her his how i if in into "
    "is it it's its me more my no not of on or other our out over same she should so some such than that the their "
    "them then there these they this those through to too under until up very was we were what when where which "
    "while who why will with would you your der die das und ist la le les des de en que y los el"
).split()

PORTER = porter_ctes("spoken", stemming.STEP2, stemming.STEP3, list(stemming.STEP4))


def _quoted(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def _summary(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Number of tokens and a digest of the token list."""
    listed = df.select(key, tokens.alias("tokens"))
    return listed.select(
        key,
        text.token_count(F.col("tokens")).cast("bigint").alias("n_tokens"),
        F.md5(text.join_tokens(F.col("tokens"), " ")).alias("digest"),
    )


def _summary_sql(key: str, source: str, tokens: str) -> str:
    return f"""
SELECT {key}, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest
FROM (SELECT {key}, {tokens} AS tokens FROM {source})"""


SPACES = "[^ \\t\\n\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query(_summary_sql("doc_id", "documents", f"regexp_extract_all(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g'), '{SPACES}')"))
def clean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without punctuation."""
    docs = data.texts(spark, sf_dir, "documents", "doc_id", "text")
    return _summary(docs, "doc_id", text.words(F.col("text")))


@query(_summary_sql("doc_id", "documents", "regexp_extract_all(text, '[\\p{L}\\p{N}'']+')"))
def prose_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters, digits and apostrophes."""
    docs = data.texts(spark, sf_dir, "documents", "doc_id", "text")
    return _summary(docs, "doc_id", text.prose_words(F.col("text")))


@query(_summary_sql("page_id", "pages", f"regexp_extract_all({data.camel_sql('html')}, '[A-Za-z]{{2,}}')"))
def code_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code split into words, identifiers taken apart."""
    pages = data.texts(spark, sf_dir, "pages", "page_id", "html")
    return _summary(pages, "page_id", text.code_words(F.col("html")))


@query(
    _summary_sql(
        "page_id",
        "pages",
        f"list_transform(regexp_extract_all({data.camel_sql('html')}, '[A-Za-z]+'), lambda x: lower(x))",
    )
)
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case identifier parts of any length."""
    pages = data.texts(spark, sf_dir, "pages", "page_id", "html")
    return _summary(pages, "page_id", text.identifier_tokens(F.col("html")))


@query(
    f"""
WITH said AS (SELECT doc_id, unnest(regexp_extract_all({data.camel_sql('text')}, '[A-Za-z]+')) AS w FROM documents),
kept AS (SELECT doc_id, lower(w) AS token FROM said WHERE NOT list_contains({_quoted(STOP_WORDS)}, lower(w))),
spoken AS (SELECT token FROM kept),
{PORTER}
SELECT stem AS term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences
FROM kept JOIN stems USING (token) GROUP BY 1"""
)
def stemmed_identifier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier tokens without stop words, stemmed: documents and occurrences per stem."""
    docs = data.texts(spark, sf_dir, "documents", "doc_id", "text")
    tokens = text.identifier_tokens(F.col("text"), stop_words=STOP_WORDS)
    counted = text.exploded(docs, "doc_id", tokens).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    per_doc = stemming.with_stems(counted, "token", F.col("n")).groupBy("doc_id", F.col("token").alias("term"))
    return (
        per_doc.agg(F.sum("n").alias("n")).groupBy("term")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))
    )


@query(
    f"""
WITH spoken AS (
  SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}'']+'))) AS token FROM documents),
{PORTER}
SELECT token, stem FROM stems"""
)
def porter_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every word of the documents."""
    docs = data.texts(spark, sf_dir, "documents", "text")
    seen = docs.select(F.explode(text.prose_words(F.col("text"))).alias("w")).select(F.lower("w").alias("token"))
    return seen.distinct().withColumn("stem", stemming.porter(F.col("token")))


def _preprocessed_sql(key: str, source: str, tokens: str, dropped: list[str]) -> str:
    return f"""
WITH split AS (SELECT {key}, {tokens} AS ws FROM {source}),
placed AS (SELECT {key}, lower(unnest(ws)) AS token, unnest(range(len(ws))) AS pos FROM split),
dropped AS (SELECT unnest({_quoted(dropped)}) AS token),
spoken AS (SELECT token FROM placed UNION ALL SELECT token FROM dropped),
{PORTER},
gone AS (SELECT DISTINCT stem FROM dropped JOIN stems USING (token)),
kept AS (SELECT {key}, pos, stem FROM placed JOIN stems USING (token)
         WHERE length(stem) >= 2 AND stem NOT IN (SELECT stem FROM gone))
SELECT s.{key}, count(stem) AS n_tokens, md5(coalesce(string_agg(stem, ' ' ORDER BY pos), '')) AS digest
FROM split s LEFT JOIN kept k ON s.{key} = k.{key} GROUP BY 1"""


@query(
    _preprocessed_sql(
        "doc_id",
        "documents",
        "regexp_extract_all(text, '[\\p{L}\\p{N}'']+')",
        STOP_WORDS + words.MARKUP_WORDS,
    )
)
def preprocessed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report texts: split, lower, stem, drop stop words and short stems."""
    docs = data.texts(spark, sf_dir, "documents", "doc_id", "text")
    return _summary(docs, "doc_id", text.preprocessed(F.col("text"), "text", STOP_WORDS))


@query(
    _preprocessed_sql(
        "page_id",
        "pages",
        f"regexp_extract_all({data.camel_sql('html')}, '[A-Za-z]{{2,}}')",
        STOP_WORDS + words.MARKUP_WORDS + words.JAVA_KEYWORDS,
    )
)
def preprocessed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code: split, lower, stem, drop keywords, stop words and short stems."""
    pages = data.texts(spark, sf_dir, "pages", "page_id", "html")
    return _summary(pages, "page_id", text.preprocessed(F.col("html"), "code", STOP_WORDS))


@query(
    f"""
WITH split AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}'']+')) AS w FROM documents),
placed AS (SELECT doc_id, lower(w) AS token FROM split),
dropped AS (SELECT unnest({_quoted(STOP_WORDS + words.MARKUP_WORDS)}) AS token),
spoken AS (SELECT token FROM placed UNION ALL SELECT token FROM dropped),
{PORTER},
gone AS (SELECT DISTINCT stem FROM dropped JOIN stems USING (token))
SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS n_tokens, max(tf) AS max_tf FROM (
  SELECT doc_id, stem, count(*) AS tf FROM placed JOIN stems USING (token)
  WHERE length(stem) >= 2 AND stem NOT IN (SELECT stem FROM gone) GROUP BY ALL)
GROUP BY doc_id"""
)
def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted, stemmed words per document, frequent words stemmed once."""
    docs = data.texts(spark, sf_dir, "documents", "doc_id", "text")
    tf = datasets.term_table(docs, ["doc_id"], text.prose_words(F.col("text")), "text", STOP_WORDS)
    return tf.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf")
    )


NORMALIZED = f"regexp_extract_all(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~]', '', 'g'), '{SPACES}')"


@query(
    f"""
WITH split AS (SELECT item_id, {NORMALIZED} AS ws FROM benchmark),
placed AS (SELECT item_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM split),
spoken AS (SELECT token FROM placed),
{PORTER},
kept AS (SELECT item_id, pos, stem FROM placed JOIN stems USING (token)
         WHERE NOT list_contains({_quoted(STOP_WORDS)}, token))
SELECT s.item_id, count(stem) AS n_tokens, md5(coalesce(string_agg(stem, ' ' ORDER BY pos), '')) AS digest
FROM split s LEFT JOIN kept k ON s.item_id = k.item_id GROUP BY 1"""
)
def normalized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, no punctuation, no stop words, stemmed."""
    items = data.texts(spark, sf_dir, "benchmark", "item_id", "text")
    return _summary(items, "item_id", text.normalized_words(F.col("text"), STOP_WORDS))


STRIPPED = (
    "array_to_string(list_filter(string_split(regexp_replace({0}, "
    "'(?s)(\"[^\\\\\"]*(?:\\\\.[^\\\\\"]*)*\"|''[^\\\\'']*(?:\\\\.[^\\\\'']*)*'')|//[^\\n]*|/\\*.*?\\*/', '\\1 ', 'g'), chr(10)), "
    "lambda l: trim(l) <> ''), chr(10))"
)


@query(f"SELECT page_id, md5({STRIPPED.format('html')}) AS digest, length({STRIPPED.format('html')}) AS n_chars FROM pages")
def strip_page_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment removal on pages with scripts."""
    pages = data.texts(spark, sf_dir, "pages", "page_id", "html")
    done = pages.select("page_id", text.strip_comments(F.col("html")).alias("t"))
    return done.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query(f"WITH {data.SOURCES} SELECT file, {STRIPPED.format('file_content')} AS code FROM sources")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment removal that keeps literals."""
    return data.sources(spark, sf_dir).select("file", text.strip_comments(F.col("file_content")).alias("code"))


@query(
    f"""
WITH {data.SOURCES}
SELECT p_partkey AS file, 'public class ' || replace(p_brand, '#', '') || ' extends ' || p_type || 'Part {{' AS first_line,
       lower(replace(p_brand, '#', '')) || ' getpartsize' AS names, replace(p_brand, '#', '') AS class_names
FROM part"""
)
def declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code without package and import lines, declared names, class names."""
    content = F.col("file_content")
    lines = F.filter(F.split(text.code_text(content), "\n"), lambda x: F.trim(x) != "")
    return data.sources(spark, sf_dir).select(
        "file",
        F.element_at(lines, 1).alias("first_line"),
        text.join_tokens(text.declared_names(content), " ").alias("names"),
        text.class_name_text(content).alias("class_names"),
    )


@query(
    f"""
WITH code AS (
  SELECT p_partkey AS file, 'public class ' || replace(p_brand, '#', '') || ' extends ' || p_type || 'Part String itemName = "' ||
    p_name || ' // in stock" int getPartSize return ' || lower(replace(p_brand, '#', '')) || ' getpartsize' AS t FROM part),
split AS (SELECT file, regexp_extract_all({data.camel_sql('t')}, '[A-Za-z]{{2,}}') AS ws FROM code),
placed AS (SELECT file, lower(unnest(ws)) AS token, unnest(range(len(ws))) AS pos FROM split),
dropped AS (SELECT unnest({_quoted(STOP_WORDS + words.MARKUP_WORDS + words.JAVA_KEYWORDS)}) AS token),
spoken AS (SELECT token FROM placed UNION ALL SELECT token FROM dropped),
{PORTER},
gone AS (SELECT DISTINCT stem FROM dropped JOIN stems USING (token))
SELECT file, count(*) AS size, string_agg(stem, '-|-' ORDER BY pos) AS file_content_processed
FROM placed JOIN stems USING (token) WHERE length(stem) >= 2 AND stem NOT IN (SELECT stem FROM gone) GROUP BY 1"""
)
def processed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code processing job: words of code and declared names, and their number."""
    done = datasets.processed_sources(data.sources(spark, sf_dir), STOP_WORDS)
    return done.select(
        "file",
        F.col("size").cast("bigint").alias("size"),
        text.join_tokens(F.col("file_content_processed")).alias("file_content_processed"),
    )


@query(_summary_sql("doc_id", "documents", "regexp_extract_all(text, '[\\p{L}\\p{N}'']+')"))
def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists joined with the separator and split again."""
    docs = data.texts(spark, sf_dir, "documents", "doc_id", "text")
    joined = docs.select("doc_id", text.join_tokens(text.prose_words(F.col("text"))).alias("packed"))
    return _summary(joined, "doc_id", text.split_tokens(F.col("packed")))


@query(
    """
SELECT doc_id, 'src/' || lang || '/' || source || '/Doc' || doc_id || '.java' AS path, 'Doc' || doc_id AS stem,
       2 AS n_files, lang AS first_name
FROM documents"""
)
def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path normal form, file stems, file lists and list literals."""
    docs = data.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    name = F.concat(F.lit("/Doc"), F.col("doc_id").cast("string"), F.lit(".java"))
    raw = F.concat(F.lit("./src//"), "lang", F.lit("/a/b/../../"), "source", F.lit("/./"), name)
    listed = docs.select(
        "doc_id",
        paths.file_list(F.concat(F.lit("  "), raw, F.lit(" \t other/../x.java "))).alias("files"),
        paths.list_literal(F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("']"))).alias("names"),
    )
    path = F.element_at("files", 1)
    return listed.select(
        "doc_id",
        path.alias("path"),
        paths.file_stem(F.translate(path, "/", ".")).alias("stem"),
        F.size("files").alias("n_files"),
        F.element_at("names", 1).alias("first_name"),
    )
