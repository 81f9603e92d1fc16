"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size: an item of q shingles belongs to the class of the least power of two L >= q. For
each class present, a document is searched in windows of 2 L shingles that advance by L, so a whole item lies
within one window however long the document is, and the Jaccard similarity of an item at the threshold and its
window stays above 0.19. Window and item meet if one of HASHES minimum hashes agrees (the chance to miss such an
item is below 2 in a million). A bitmap, sized by the items and 128 MB at most, tells which minimum hashes occur among
them, so only those leave the scan. Documents and items that meet are verified on all their shingles; the items that a
document is asked about come to it in slices of bounded size, however many they are.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; a shingle is five words.
Defined results: an item or document of fewer words has one shingle, its whole sequence; one without words
matches nothing; a null text counts as empty; items of equal text are all reported; rows equal in doc_id and
text are reported once each; null ids are kept; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm import common
from pairscope.llm.common import bitmap, drop_path, marked, parted, saved, splitmix, table

SHINGLE, PERCENT = 5, 80
HASHES = 64
#: Bytes of items' shingles that one row holds beside a document, about.
SLICE_BYTES = 4 << 20
_XOR = splitmix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
_ODD = splitmix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _shingled(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its first row, the shingle hashes in order, and each row's part of them."""
    data, offsets = common.text_buffers(column)
    for first, last in common.chunks(offsets):
        part = common.LOWER[data[offsets[first] : offsets[last]]]
        _, _, rows, hashes = common.words(part, offsets[first : last + 1] - offsets[first], common.NOT_WORD)
        values, owners, _ = common.shingles(rows, hashes, SHINGLE, last - first)
        yield first, values, common.by_row(owners, last - first)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, values, at in _shingled(column):
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(values[a:b])


def _key(lows: np.ndarray, hash_: int, size: int) -> np.ndarray:
    return splitmix(lows + np.uint64(hash_ * 0x9E37 + size * 0x85EBCA6B))


def item_index(items: DataFrame) -> DataFrame:
    """Per item (item_id, text): rid, item_id, size class, its set and the keys of its minimum hashes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bodies, keys = [], [], []
            for values in _sets(batch.column(1)):
                size = 1 << (max(len(values), 1) - 1).bit_length()
                sizes.append(size)
                bodies.append(values.tobytes())
                own = [_key(((values ^ x) * o).min()[None], h, size)[0] for h, (x, o) in enumerate(zip(_XOR, _ODD, strict=True))] if len(values) else []
                keys.append(np.array(own, dtype=np.uint64).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["item_id", "size", "body", "keys"])

    found = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(find, "item_id long, size long, body binary, keys array<bigint>")
    return found.where(F.size("keys") > 0).select(F.xxhash64("body").alias("rid"), "item_id", "size", "body", "keys")


def _window_keys(values: np.ndarray, at: np.ndarray, size: int, field: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows' minimum hashes those whose place is marked: rows and keys."""
    places = np.arange(len(values)) - np.repeat(at[:-1], np.diff(at))
    starts = np.flatnonzero(places % size == 0)
    rows = np.searchsorted(at, starts, side="right") - 1
    joined = rows[:-1] == rows[1:]
    found_rows, found_keys = [], []
    for h, (x, o) in enumerate(zip(_XOR, _ODD, strict=True)):
        lows = np.minimum.reduceat((values ^ x) * o, starts)
        lows[:-1][joined] = np.minimum(lows[:-1], lows[1:])[joined]
        keys = _key(lows, h, size)
        hit = np.flatnonzero(marked(field, keys, bits))
        found_rows.append(rows[hit])
        found_keys.append(keys[hit])
    return np.concatenate(found_rows), np.concatenate(found_keys)


def meetings(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Documents (doc_id, th) and items (rid) that share a minimum hash."""
    spark = docs.sparkSession
    keys = index.select(F.explode("keys").alias("key"), "rid")
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # powers of two
    bits = common.bitmap_bits(index.agg(F.sum(F.size("keys"))).first()[0] or 0, 64)
    shared = spark.sparkContext.broadcast(bitmap(keys.select("key"), bits))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.working("decontaminate")
        field = shared.value
        for batch in batches:
            for first, values, at in _shingled(batch.column(2)):
                if not len(values):
                    continue
                parts = [_window_keys(values, at, size, field, bits) for size in sizes]
                rows, found = np.concatenate([r for r, _ in parts]), np.concatenate([k for _, k in parts])
                if len(rows):
                    pairs = np.unique(np.stack([rows.astype(np.int64) + first, found.view(np.int64)]), axis=1)
                    chosen = pa.array(pairs[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(pairs[1])], names=["doc_id", "th", "key"])

    hits = docs.select("doc_id", "th", "text").mapInArrow(find, "doc_id long, th long, key long")
    return hits.join(keys, "key").select("doc_id", "th", "rid").distinct()


def _document() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "th")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (doc_id, th, item_id, shared, n_shingles): the document has at least PERCENT of the item's shingles; th: hash of the text."""
    docs = common.small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text")))
    index, index_path = saved(item_index(items), "items")
    bodies = index.select("rid", "body").dropDuplicates(["rid"])
    met, met_path = saved(meetings(docs, index), "meetings")
    weighed = met.join(bodies.select("rid", F.length("body").alias("bytes")), "rid").groupBy("doc_id", "th").agg(F.sum("bytes").alias("bytes"))
    slices = weighed.select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), F.ceil(F.col("bytes") / SLICE_BYTES).alias("slices"))
    placed = met.join(slices, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))).select("doc_id", "th", "rid", F.pmod("rid", "slices").alias("slice"))
    asked = placed.join(bodies, "rid").groupBy("doc_id", "th", "slice").agg(F.collect_list(F.struct("rid", "body")).alias("asked"))
    asked = asked.select(F.col("doc_id").alias("id"), F.col("th").alias("hash"), "asked")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, th, items_, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), _sets(batch.column(3)), strict=True):
                for item in items_.values:
                    body = np.frombuffer(item["body"].as_buffer(), dtype=np.uint64)
                    at = np.searchsorted(values, body)
                    shared = int((values[np.minimum(at, len(values) - 1)] == body).sum())
                    if 100 * shared >= PERCENT * len(body):
                        out.append((doc_id, th, item["rid"].as_py(), shared, len(body)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], names=["doc_id", "th", "rid", "shared", "n_shingles"])

    held, _ = parted(docs, _document(), met.select(_document()))
    joined = held.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash"))).select("doc_id", "th", "asked", "text")
    verified = joined.mapInArrow(check, "doc_id long, th long, rid long, shared long, n_shingles long")
    result, _ = saved(verified.join(index.select("rid", "item_id"), "rid").select("doc_id", "th", "item_id", "shared", "n_shingles"), "contaminated")
    drop_path(docs.sparkSession, index_path)
    drop_path(docs.sparkSession, met_path)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds, with the share of the item's shingles."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "n_shingles", F.round(F.col("shared") / F.col("n_shingles"), 6).alias("containment"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    own = common.free_names(docs.columns, "id", "th")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    held, clean = parted(docs, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), found.select(_document()))
    gone = found.select("doc_id", "th").distinct().toDF(own["id"], own["th"])
    kept = held.join(gone, F.col("doc_id").eqNullSafe(F.col(own["id"])) & (F.xxhash64("text") == F.col(own["th"])), "left_anti")
    return kept.select(*docs.columns).unionByName(clean)


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles_sql(source: str, key: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    runs = f"CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END"
    return f"SELECT DISTINCT {key}, unnest({runs}) AS s FROM (SELECT {key}, {words} AS w FROM {source}) WHERE len(w) > 0"


def pairs_sql(source: str) -> str:
    """The pairs as a query over source (doc_id, text) and benchmark."""
    return f"""SELECT d.doc_id, i.item_id, count(*) AS shared, any_value(n) AS n_shingles
FROM ({_shingles_sql(source, "doc_id")}) d JOIN (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM ({_shingles_sql("benchmark", "item_id")})) i ON d.s = i.s
GROUP BY d.doc_id, i.item_id HAVING 100 * count(*) >= {PERCENT} * any_value(n)"""


ORACLE_SQL = f"SELECT *, round(shared / n_shingles, 6) AS containment FROM ({pairs_sql('documents')})"
