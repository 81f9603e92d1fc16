"""Line deduplication over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is a window, known by two 64-bit hashes; so is a whole text of one or two lines,
which meets only other whole texts of as many. A window that occurs more than once keeps its first occurrence, by
(doc_id, hash of text, line); the later occurrences' lines are merged per document and removed.

Defined results: windows of blank lines alone do not count; a null text stays null, an empty one empty; a null doc_id
sorts first; rows equal in doc_id and text count as one document and are treated alike; an empty table gives no rows;
other columns, whatever their names, pass through unchanged (dedup's own n_lines and n_removed take the place of
columns of these names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import free_names, parted, saved, table

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """A row per window of docs (doc_id, th, text): doc_id, th, pos and the window's hashes h1, h2."""
    split = docs.select("doc_id", "th", F.split("text", "\n").alias("lines"))
    lines = split.where(F.size("lines") >= WINDOW)
    tails = [F.slice("lines", i + 1, F.size("lines") - (WINDOW - 1)).alias(f"l{i}") for i in range(WINDOW)]
    runs = lines.select("doc_id", "th", F.posexplode(F.arrays_zip(*tails)).alias("pos", "run"))
    own = [F.col(f"run.l{i}") for i in range(WINDOW)]
    blank = F.lit(True)
    for line in own:
        blank = blank & (F.trim(line) == "")
    full = runs.where(~blank).select("doc_id", "th", "pos", F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(WINDOW), *own).alias("h2"))
    short = split.where(F.size("lines").between(1, WINDOW - 1) & F.exists("lines", lambda x: F.trim(x) != ""))
    end = F.concat(F.lit("end"), F.size("lines").cast("string"))
    return full.unionByName(short.select("doc_id", "th", F.lit(0).alias("pos"), F.xxhash64(end, "lines").alias("h1"), F.xxhash64(F.lit(WINDOW), end, "lines").alias("h2")))


def repeated(found: DataFrame) -> DataFrame:
    """The windows that occur more than once, with their first occurrence. Combined on the map side, so a hot window is a row per task."""
    first = F.min(F.struct("doc_id", "th", "pos")).alias("first")
    return found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").drop("n")


def removals(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, th) the first lines of the windows to remove."""
    found = windows(docs)
    later = found.join(repeated(found), ["h1", "h2"]).where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("later"))


def _marked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with the repeated windows' later occurrences cut from text, and the names of two more columns: lines and removed.

    Documents that lose nothing stay where they are; the others meet their windows."""
    own = free_names(docs.columns, "th", "id", "gone", "later", "split", "lines", "removed")
    keyed = docs.withColumn(own["th"], F.xxhash64("text"))
    gone, _ = saved(removals(keyed.select("doc_id", F.col(own["th"]).alias("th"), "text")), "removals")
    held, whole = parted(keyed, F.xxhash64("doc_id", own["th"]), gone.select(F.xxhash64("doc_id", "th")))
    gone = gone.toDF(own["id"], own["gone"], own["later"])
    joined = held.join(gone, F.col("doc_id").eqNullSafe(F.col(own["id"])) & (F.col(own["th"]) == F.col(own["gone"])), "left")
    joined = joined.withColumn(own["split"], F.split("text", "\n"))
    lines, later = F.col(own["split"]), F.col(own["later"])
    last = F.size(lines) - 1
    covered = F.flatten(F.transform(later, lambda p: F.sequence(p, F.least(p + (WINDOW - 1), last))))
    kept = F.array_except(F.sequence(F.lit(0), last), covered)
    text = F.when(later.isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    removed = F.when(later.isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    columns = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias(own["lines"])
    cut = joined.select(*columns, n_lines, removed.alias(own["removed"]))
    return cut.unionByName(whole.select(*docs.columns, n_lines, F.lit(0).cast("long").alias(own["removed"]))), own


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the lines of repeated windows' later occurrences; adds n_lines and n_removed, in place of own columns of these names."""
    found, own = _marked(docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")]))
    return found.withColumnsRenamed({own["lines"]: "n_lines", own["removed"]: "n_removed"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after line deduplication, with the lines they had and lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", "n_lines", "n_removed")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated windows' later occurrences; one that lost lines and has none but blank ones left goes."""
    found, own = _marked(docs)
    return found.where((F.col(own["removed"]) == 0) | (F.trim(F.regexp_replace("text", "\n", " ")) != "")).select(*docs.columns)


def _lines_sql(source: str) -> str:
    """Common table expressions l6 (lines), w6 (windows) and g6 (removed lines) over source (rid, doc_id, text). A short text's window lacks its last lines."""
    return f"""l6 AS (SELECT rid, doc_id, len(p) AS n, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS p FROM {source})),
w6 AS (SELECT * FROM (SELECT rid, doc_id, i, n, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM l6 WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE (c IS NOT NULL OR (n < 3 AND i = 1)) AND NOT (trim(a) = '' AND trim(coalesce(b, '')) = '' AND trim(coalesce(c, '')) = '')),
f6 AS (SELECT rid, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM w6),
g6 AS (SELECT DISTINCT rid, i + j AS i FROM f6, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1)"""


ORACLE_SQL = f"""WITH d6 AS (SELECT doc_id AS rid, doc_id, text FROM documents),
{_lines_sql("d6")}
SELECT d6.doc_id, coalesce(string_agg(l6.line, chr(10) ORDER BY l6.i) FILTER (g6.i IS NULL), '') AS text,
  count(l6.i) AS n_lines, count(g6.i) AS n_removed
FROM d6 LEFT JOIN l6 USING (rid) LEFT JOIN g6 ON g6.rid = l6.rid AND g6.i = l6.i GROUP BY d6.doc_id"""
