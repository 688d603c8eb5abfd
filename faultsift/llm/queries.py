"""Registered queries: every operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.llm import (
    boilerplate,
    bpe,
    contextual_pii,
    conversations,
    filter_audit,
    language,
    line_hashing,
    norm_buckets,
    outliers,
    packing,
    probminhash,
    sharding,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL where SQL can say it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    chain = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return toxicity.toxicity(table(spark, sf_dir, "documents"), labels, chain)


@query(
    r"""
    WITH cut AS (
      SELECT doc_id, unnest(parts) AS unit, generate_subscripts(parts, 1) - 1 AS unit_no
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]*?(?:[.!?] |\n)|[^\n]+') AS parts FROM documents)),
    placed AS (
      SELECT doc_id, unit_no, length(unit) AS n,
             coalesce(sum(length(unit)) OVER (
               PARTITION BY doc_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
      FROM cut),
    worded AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS nth FROM placed WHERE norm <> ''),
    ranked AS (
      SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS first_doc_id,
             first_value(unit_no) OVER w AS first_unit_no
      FROM worded WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, unit_no)),
    runs AS (
      SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM ranked WHERE place > 1),
    summed AS (SELECT *, sum(len(string_split(norm, ' '))) OVER (PARTITION BY doc_id, run) AS words FROM runs)
    SELECT doc_id, CAST(unit_no AS BIGINT) AS unit_no, CAST(start AS BIGINT) AS start,
           CAST(start + n AS BIGINT) AS stop, first_doc_id, CAST(first_unit_no AS BIGINT) AS first_unit_no
    FROM summed WHERE words >= 25
    """
)
def op2_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = line_hashing.repeats(table(spark, sf_dir, "documents"))
    return gone.select("doc_id", "unit_no", "start", "stop", F.col("first_key").alias("first_doc_id"), "first_unit_no")


@query()
def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    r"""
    WITH cut AS (
      SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
      FROM documents),
    stripped AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM cut),
    totals AS (SELECT coalesce(source, '') AS host, count(*) AS host_pages FROM documents GROUP BY 1),
    frequent AS (
      SELECT host, bare FROM stripped JOIN totals USING (host) WHERE bare <> '' GROUP BY host, bare, host_pages
      HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) > 0.1 * host_pages),
    marked AS (
      SELECT s.*, f.bare IS NOT NULL AS gone FROM stripped s LEFT JOIN frequent f ON s.host = f.host AND s.bare = f.bare)
    SELECT doc_id, CAST(count(*) FILTER (bare <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
           md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS text_md5
    FROM marked GROUP BY doc_id
    """
)
def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = boilerplate.without_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query(
    """
    WITH good AS (
      SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """
)
def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contextual_pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


@query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query()
def op11_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffled_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    r"""
    WITH cut AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
      FROM documents),
    failed AS (
      SELECT doc_id, part, [
        len(words) < 100,
        100 * len(list_distinct(words)) < 80 * len(words),
        100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 10 * length(x),
        regexp_matches(x, '[#$%&*|]'),
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)] AS f
      FROM cut),
    marked AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
    counts AS (
      SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM failed LEFT JOIN marked USING (doc_id) GROUP BY part, f),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (
      SELECT a.c || b.c || d.c || e.c || g.c AS filter_order
      FROM letters a, letters b, letters d, letters e, letters g
      WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
    steps AS (
      SELECT filter_order, step, ascii(filter_order[step]) - 64 AS mine,
             [ascii(filter_order[i]) - 64 FOR i IN range(1, step)] AS earlier
      FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    met AS (
      SELECT part, filter_order, step, mine, n, good, toxic, f[mine] AS fails,
             len([i FOR i IN earlier IF f[i]]) > 0 AS gone, len([i FOR i IN f IF i]) = 1 AS alone
      FROM counts, steps),
    removals AS (
      SELECT part, filter_order, step, mine,
             sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM met GROUP BY part, filter_order, step, mine)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
    FROM removals
    """
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    failed = filter_audit.failures(docs, filter_audit.text_conditions(F.col("text")), F.coalesce("lang", F.lit("")))
    lost = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    return filter_audit.audit(failed, "ABCDE", labels, lost)


def _put(key: str) -> str:
    """SQL for best edits of a state with one more turn put behind them."""
    role = {"0": "user", "1": "user", "2": "assistant", "3": "user"}
    return _edit(f"b{key}", "5", "I", f"'{role[key]}:'")


def _edit(best: str, cost: str, letter: str, line: str | None) -> str:
    """SQL for best edits (cost, audit, lines) with one more edit; null stays null."""
    lines = f"{best}.r" if line is None else f"{best}.r || chr(10) || {line}"
    return f"CASE WHEN {best} IS NOT NULL THEN {{'c': {best}.c + {cost}, 'a': {best}.a || '{letter}', 'r': {lines}}} END"


def _repair_sql() -> str:
    """A shortest path row by row: the best (cost, audit, lines) of each of the four states."""
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    can = "CASE WHEN {} THEN {} END"
    named, free = "role || ':' || text", "fault NOT IN ('blank', 'duplicate')"

    def kept(best: str, initial: str) -> str:
        return can.format(f"{free} AND role[1] = '{initial}'", _edit(best, more, "K", named))

    def renamed(best: str, role: str) -> str:
        return can.format(free, _edit(best, f"1 + {more}", "R", f"'{role}:' || text"))

    to = {
        "0": [_edit("e0", "2", "D", None)],
        "1": [_edit("e1", "2", "D", None), kept("e0", "s")],
        "2": [_edit("e2", "2", "D", None)] + [f(e, r) for e in ("e0", "e1", "e3") for f, r in ((kept, "u"), (renamed, "user"))],
        "3": [_edit("e3", "2", "D", None), kept("e2", "a"), renamed("e2", "assistant")],
    }
    u = f"list_min([b2, {_put('0')}, {_put('1')}, {_put('3')}])"
    a = f"list_min([b3, {_edit(u, '5', 'I', chr(39) + 'assistant:' + chr(39))}])"
    step = "list_reduce(list_concat([4294967295], [CAST(ascii(h) AS BIGINT) FOR h IN string_split(name, '')]), lambda c, b: " \
        "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"  # fmt: skip
    return rf"""
    WITH RECURSIVE named AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
      FROM conversations),
    ruled AS (SELECT *, xor({step}, 4294967295) % 20 AS rule FROM named),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN rule = 4 THEN 'user' ELSE role END AS role,
             CASE rule WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN rule = 3 THEN [0, 1] ELSE [0] END) AS again
      FROM ruled WHERE rule <> 0),
    placed AS (
      SELECT *, row_number() OVER w AS place, row_number() OVER same AS seen, lag(role[1]) OVER w AS before,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
      FROM damaged
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again),
             same AS (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again)),
    faulty AS (
      SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                     WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
      FROM placed),
    counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) AS n,
             count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
      FROM faulty GROUP BY conv_id),
    best AS (
      SELECT conv_id, 0 AS k, {{'c': 0, 'a': '', 'r': ''}} AS b0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) AS b1,
             CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) AS b2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) AS b3
      FROM counts
      UNION ALL
      SELECT conv_id, k + 1, {", ".join(f"list_min([{', '.join(to[s])}])" for s in "0123")}
      FROM (SELECT conv_id, k, b0 AS e0, b1 AS e1, {u} AS e2, {a} AS e3 FROM best) met
      JOIN faulty USING (conv_id) WHERE faulty.place = met.k + 1),
    ends AS (SELECT conv_id, list_min([b0, {a}]) AS done FROM best JOIN counts USING (conv_id) WHERE k = n)
    SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
           CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(done.c, 0) AS BIGINT) AS cost,
           coalesce(done.a, '') AS audit, sha256(coalesce(done.r[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts USING (conv_id) LEFT JOIN ends USING (conv_id)
    """


@query(_repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))
