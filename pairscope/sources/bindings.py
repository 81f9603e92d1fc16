"""Relations of the evaluation's shape, derived from the driver's tables; SQL holds the same derivations for DuckDB.

The derivations are this project's own: conversations become question/answer pairs, answers
are replaced by templates so that all stances occur, event averages stand in for scores of conditions, orders for
annotators' answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairscope.functions import text as T
from pairscope.functions import vocabulary as V

CONDITIONS = ("multimodal_conflict", "text_only_conflict", "multimodal_clean")
SCORE_CONDITIONS = ("view", "click", "signup", "purchase")
TEMPLATES = (
    "There is no {} in the image.",
    "The image does not contain any {}.",
    "I cannot see the image.",
    "The {} is not visible.",
    "There are no clouds visible in the image.",
    "The picture has a train, not a {}.",
    "I am not sure where the {} is.",
    None,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by hash of key, in as many partitions as shuffles have. The next window or grouping by key needs no other
    exchange, and adaptive execution doesn't fold these partitions for their few bytes: text kernels after it cost far
    more than bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant's next: image_id, conflict_type, question, answer, ref_words, pred_words."""
    ahead = Window.partitionBy("conv_id").orderBy("turn")
    rows = dealt(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", "role", "text", F.lead("text").over(ahead).alias("answer"), F.lead("role").over(ahead).alias("next_role"))
    pairs = rows.where("role = 'user' AND next_role = 'assistant'")
    kind = F.element_at(F.array(F.lit("attribute"), F.lit("object"), F.lit("relation")), (F.col("conv_id") % 3 + 1).cast("int"))
    return pairs.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("image_id"), "conv_id", "turn", kind.alias("conflict_type"), F.col("text").alias("question"), "answer",
        T.tokens(F.col("text")).alias("ref_words"), T.tokens(F.col("answer")).alias("pred_words"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair under three conditions, with a templated prediction: image_id, condition, conflict_type, question, reference, prediction."""
    rows = qa(spark, sf_dir).select("*", F.posexplode(F.array(*map(F.lit, CONDITIONS))).alias("k", "condition"))
    word = F.coalesce(F.get(T.content_tokens(F.col("ref_words")), 0), F.lit("thing"))
    bucket = (F.col("conv_id") * 7 + F.col("turn") + F.col("k")) % len(TEMPLATES)
    said: Column | None = None
    for i, template in enumerate(TEMPLATES):
        value = F.array_join("pred_words", " ") if template is None else F.replace(F.lit(template), F.lit("{}"), word)
        said = F.when(bucket == i, value) if said is None else said.when(bucket == i, value)
    return rows.select("image_id", "condition", "conflict_type", "question", F.array_join("ref_words", " ").alias("reference"), said.alias("prediction"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per user and type: image_id, condition, conflict_type, score."""
    kind = F.when(F.col("user_id") % 2 == 0, "object").otherwise("relation")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("image_id"), F.col("event_type").alias("condition")).agg(F.round(F.avg("value"), 6).alias("score"), F.first(kind).alias("conflict_type"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: id, score, probability, target, before, after, effect, stratum, image_hash."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    effect = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "helps").when((F.col("quality") == 0) & (F.col("toxic") == 1), "harms").otherwise("tie")
    return joined.select(
        F.col("doc_id").alias("id"), (F.col("n_chars") % 997).alias("score"), ((F.col("n_chars") % 101) / 101).alias("probability"), (F.col("quality") == 1).alias("target"),
        F.col("toxic").cast("int").alias("before"), F.col("quality").cast("int").alias("after"), effect.alias("effect"), F.col("lang").alias("stratum"), F.sha2("text", 256).alias("image_hash"), "source",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as annotators' answers of a customer: question_id, image_id, stratum, answers, majority."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("own"))
    per = orders.groupBy("o_custkey").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("own"), F.max(F.struct("n", "o_orderpriority")).alias("best"))
    joined = per.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_custkey").alias("question_id"), F.col("c_nationkey").cast("long").alias("image_id"), F.col("c_mktsegment").alias("stratum"), F.transform("own", lambda x: x["o_orderpriority"]).alias("answers"), F.col("best.o_orderpriority").alias("majority"))


def logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def tokens_sql(text: str) -> str:
    numbers = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.NUMBER_WORDS.items())
    bare = f"regexp_replace({text}, '^\\s*(?:[-*]|\\d+[.)])\\s*', '')"
    words = f"string_split(regexp_replace(lower({bare}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')"
    return f"list_transform(list_filter({words}, lambda w: w NOT IN ('', 'a', 'an', 'the')), lambda w: CASE w {numbers} ELSE w END)"


def stem_sql(w: str) -> str:
    return f"""CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y'
 WHEN length({w}) > 4 AND regexp_matches({w}, '(ses|xes|zes|ches|shes)$') THEN left({w}, length({w}) - 2)
 WHEN length({w}) > 3 AND {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"""


def content_sql(words: str) -> str:
    stop = ", ".join(map(_quoted, V.CONTENT_STOPWORDS))
    return f"list_sort(list_distinct(list_filter(list_transform(list_filter({words}, lambda w: w NOT IN ({stop})), lambda w: {stem_sql('w')}), lambda w: length(w) > 1)))"


def _said_sql() -> str:
    parts = []
    for i, template in enumerate(TEMPLATES):
        value = "array_to_string(pred_words, ' ')" if template is None else f"replace({_quoted(template)}, '{{}}', coalesce(content[1], 'thing'))"
        parts.append(f"WHEN {i} THEN {value}")
    return f"CASE (conv_id * 7 + turn + k) % {len(TEMPLATES)} {' '.join(parts)} END"


#: Common table expressions by name; those that others need come first.
SQL = {
    "qa": f"""qa AS (SELECT conv_id * 1000 + turn AS image_id, conv_id, turn, ['attribute', 'object', 'relation'][conv_id % 3 + 1] AS conflict_type, text AS question, answer,
  {tokens_sql("text")} AS ref_words, {tokens_sql("answer")} AS pred_words
  FROM (SELECT *, lead(text) OVER o AS answer, lead(role) OVER o AS next_role FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')""",
    "gen": f"""gen AS (SELECT image_id, condition, conflict_type, question, array_to_string(ref_words, ' ') AS reference, {_said_sql()} AS prediction
  FROM (SELECT *, {content_sql("ref_words")} AS content FROM qa), (VALUES (0, 'multimodal_conflict'), (1, 'text_only_conflict'), (2, 'multimodal_clean')) c(k, condition))""",
    "scores": "scores AS (SELECT user_id AS image_id, event_type AS condition, round(avg(value), 6) AS score, CASE WHEN user_id % 2 = 0 THEN 'object' ELSE 'relation' END AS conflict_type FROM events GROUP BY user_id, event_type)",
    "labeled": """labeled AS (SELECT doc_id AS id, n_chars % 997 AS score, (n_chars % 101) / 101.0::DOUBLE AS probability, quality = 1 AS target, toxic::INT AS before, quality::INT AS after,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'helps' WHEN quality = 0 AND toxic = 1 THEN 'harms' ELSE 'tie' END AS effect, lang AS stratum, sha256(text) AS image_hash, source FROM documents JOIN labels USING (doc_id))""",
    "answers": """answers AS (SELECT c_custkey AS question_id, c_nationkey::BIGINT AS image_id, c_mktsegment AS stratum, a.answers, a.majority
  FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS answers, substr(any_value(best), 11) AS majority FROM (SELECT *, max(n || '|' || o_orderpriority) OVER (PARTITION BY o_custkey) AS best FROM (SELECT *, lpad(count(*) OVER (PARTITION BY o_custkey, o_orderpriority)::VARCHAR, 9, '0') AS n FROM orders)) GROUP BY o_custkey) a JOIN customer ON c_custkey = o_custkey)""",
    "logprobs": "logprobs AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS \"values\" FROM embeddings)",
}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    needed = [n for n in SQL if n in names.split() or (n == "qa" and "gen" in names.split())]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(SQL[n] for n in needed)} {body}" if needed else body
