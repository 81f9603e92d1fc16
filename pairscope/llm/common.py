"""Shared pieces: scratch tables in the shared folder, and a vectorised tokeniser over Arrow text buffers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.sources.io import drop_path, scratch, shared_dir

__all__ = ["drop_path", "scratch", "shared_dir"]

#: Bytes of text that one vectorised pass holds; a longer document makes a pass of its own.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole texts that go to Python at once, at most.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches set to BATCH_ROWS rows, if they are larger: Spark's 10,000 are made for numbers,
    and of whole texts are tens of MB, several times over, on both sides of each worker."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


_held: dict[str, Callable[[], object]] = {}


def working(name: str, forget: Callable[[], object] | None = None) -> None:
    """Said by a worker process that starts a task of the operator ``name``: drops what others remember between tasks.

    Workers are used again for other stages, where such memory would only be in the way."""
    others = [n for n in _held if n != name]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()
    give_back()
    if forget is not None:
        _held[name] = forget


def give_back() -> None:
    """Returns what this process has freed, and its allocators keep, to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def release(spark: SparkSession) -> None:
    """Has the executors and the driver collect their garbage now and give the room back to the system.

    A heap that earlier work has filled stays at its bound, and with it the buffers outside the heap and the compiled
    plans that only old garbage holds, while what comes next needs memory outside it. One task a core, as all are free.
    The driver does likewise, in its JVM and in Python."""
    n = max(spark.sparkContext.defaultParallelism, 1)
    collect = F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collect.alias("done")).write.format("noop").mode("overwrite").save()
    give_back()
    spark._jvm.java.lang.System.gc()


def free_names(taken: list[str], *wanted: str) -> dict[str, str]:
    """A name for each of wanted that no column has, whatever its case."""
    held, out = {c.lower() for c in taken}, {}
    for name in wanted:
        out[name] = f"__{name}"
        while out[name].lower() in held:
            out[name] = f"_{out[name]}"
    return out


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LANES = splitmix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Words are what stands between spaces, tabs and line ends.
SPACES = byte_set(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters and digits and of whatever is not ASCII.
NOT_WORD = ~byte_set(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string column; a null counts as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text is at most limit bytes, or single rows."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows' words in order: start, end (bytes), row and 64-bit hash. data is lower-cased by the caller.

    Long texts go in pieces, cut between words, and so does a word longer than a piece: beside the result, memory is
    bounded for any text."""
    size = len(data)
    if size <= 2 * CHUNK_BYTES:
        return _words(data, offsets, separators)
    found, at = [], 0
    while at < size:
        end = _bound_after(data, offsets, separators, min(at + CHUNK_BYTES, size))
        if end - at > 2 * CHUNK_BYTES:  # nothing parts the bytes from at + CHUNK_BYTES to the last before end
            begin = _bound_before(data, offsets, separators, at, at + CHUNK_BYTES)
            stop = end - int(separators[data[end - 1]])
            found.append(_part(data, offsets, separators, at, begin))
            row = int(np.searchsorted(offsets, begin, side="right")) - 1
            found.append((np.array([begin]), np.array([stop]), np.array([row]), _long_hash(data[begin:stop])))
        else:
            found.append(_part(data, offsets, separators, at, end))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _part(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of data[first:last], placed in the whole."""
    row = int(np.searchsorted(offsets, first, side="right")) - 1
    upto = int(np.searchsorted(offsets, last, side="left"))
    own = np.concatenate([[0], offsets[row + 1 : upto] - first, [last - first]])
    starts, ends, rows, hashes = _words(data[first:last], own, separators)
    return starts + first, ends + first, rows + row, hashes


def _bound_after(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, at: int) -> int:
    """The first place from at on where a row ends or a separator has just passed."""
    edge = int(offsets[np.searchsorted(offsets, at, side="left")])
    for first in range(at, edge, CHUNK_BYTES):
        gap = np.flatnonzero(separators[data[first : min(first + CHUNK_BYTES, edge)]])[:1]
        if len(gap):
            return first + int(gap[0]) + 1
    return edge


def _bound_before(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, low: int, high: int) -> int:
    """The last place in low..high where a row begins or a separator has just passed."""
    edge = max(low, int(offsets[np.searchsorted(offsets, high, side="right") - 1]))
    gap = np.flatnonzero(separators[data[edge:high]])[-1:]
    return edge + int(gap[0]) + 1 if len(gap) else edge


def _long_hash(word: np.ndarray) -> np.ndarray:
    """As in _words, of one word of any length."""
    power, total = _powers(2 * CHUNK_BYTES)[0], 0
    for at in range(0, len(word), CHUNK_BYTES):
        part = word[at : at + CHUNK_BYTES]
        inner = int((_BYTE_VALUES[part] * power[: len(part)]).sum(dtype=np.uint64))
        total = (total + inner * pow(int(_BASE), at, 1 << 64)) % (1 << 64)
    return splitmix(np.array([total], dtype=np.uint64))


def _words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = len(data)
    none = np.zeros(0, dtype=np.int64)
    if not size:
        return none, none, none, none.astype(np.uint64)
    inside = ~separators[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(size, dtype=bool)
    before[0], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(size, dtype=bool)
    after[-1], after[:-1] = True, ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    power, inverse = _powers(2 * CHUNK_BYTES)
    terms = _BYTE_VALUES[data] * power[:size]
    sums = np.cumsum(terms, dtype=np.uint64)
    hashes = (sums[ends - 1] - sums[starts] + terms[starts]) * inverse[starts]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows, splitmix(hashes)


def shingles(rows: np.ndarray, hashes: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (of the whole sequence in a row with fewer), their rows, and the words per row."""
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, dtype=np.int64)
    total = len(hashes)
    if total >= k:
        mixed = hashes[: total - k + 1] * _LANES[0]
        for j in range(1, k):
            mixed = mixed + hashes[j : total - k + 1 + j] * _LANES[j]
        whole = rows[: total - k + 1] == rows[k - 1 :]
        values, owners = splitmix(mixed[whole]), rows[: total - k + 1][whole]
    else:
        values, owners = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += hashes[first[has] + j] * _LANES[j]
        values = np.concatenate([values, splitmix(extra + counts[short].astype(np.uint64) * _LANES[63])])
        owners = np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        values, owners = values[order], owners[order]
    return values, owners, counts


def by_row(owners: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of each row's part in arrays ordered by owner."""
    return np.searchsorted(owners, np.arange(n_rows + 1))


#: A row of a bitmap table holds 2^_ROW bits (4 KB); the largest table has 2^_MOST bits (32 MB).
_ROW, _MOST = 15, 28


def bitmap_table(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """Rows (bucket, taken), to be broadcast, and their bits: which of 2^bits places the longs of keys (key) take by their high bits.

    One other key in sixteen hits a taken place at most, up to 2^_MOST bits; by SQL functions alone."""
    bits = min(_MOST, max(20, (16 * max(n_keys, 1) - 1).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    rows = keys.groupBy(F.shiftrightunsigned(place, _ROW).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << _ROW) - 1))).alias("taken"))
    return F.broadcast(rows), bits  # 2^bits / 8 bytes


def bucket(key: Column, bits: int) -> Column:
    """The row of a bitmap table that key falls in."""
    return F.shiftrightunsigned(key, 64 - bits + _ROW)


def is_taken(key: Column, taken: Column, bits: int) -> Column:
    """Whether key's place is taken in the row that it falls in (NULL: no row)."""
    place = F.shiftrightunsigned(key, 64 - bits).bitwiseAND(F.lit((1 << _ROW) - 1))
    byte = F.conv(F.hex(F.substring(taken, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0, F.lit(False))


def parted(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two: the rows whose key may be among keys (one column of longs, a table), and those whose key is not.

    So a join with few of many documents needn't shuffle the texts of the others."""
    table_, bits = bitmap_table(keys.toDF("key"), keys.count())
    own = free_names(docs.columns, "key", "bucket", "taken")
    joined = docs.withColumn(own["key"], key).join(table_.toDF(own["bucket"], own["taken"]), bucket(F.col(own["key"]), bits) == F.col(own["bucket"]), "left")
    held = is_taken(F.col(own["key"]), F.col(own["taken"]), bits)
    return joined.where(held).select(*docs.columns), joined.where(~held).select(*docs.columns)


_BITMAP_BLOCK = 1 << 13


def bitmap_bits(n_keys: int, spare: int = 8) -> int:
    """Bits for a bitmap of so many keys, in which one other key in spare hits a taken place at most; 2^30 (128 MB) is the largest."""
    return min(30, max(20, (spare * max(n_keys, 1) - 1).bit_length()))


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Which of 2^bits places the 64-bit keys (one column) take by their high bits: 2^bits / 8 bytes in the driver.

    Keys are dealt by the block of the map that they fall in, so a block is made in one place and none is merged."""
    block_bits = (_BITMAP_BLOCK * 8).bit_length() - 1
    key = F.col(keys.columns[0])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            places = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            if not len(places):
                continue
            numbers, first = np.unique(places >> block_bits, return_index=True)
            for number, part in zip(numbers.tolist(), np.split(places, first[1:]), strict=True):
                field = blocks.setdefault(number, np.zeros(_BITMAP_BLOCK, dtype=np.uint8))
                inner = part - (number << block_bits)
                at, begin = np.unique(inner >> 3, return_index=True)
                field[at] |= np.bitwise_or.reduceat((128 >> (inner & 7)).astype(np.uint8), begin)
        numbers = list(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([blocks[i].tobytes() for i in numbers], pa.binary())], names=["block", "bits"])

    n_blocks = max(1, (1 << bits) >> block_bits)
    dealt = keys.select(key.alias("key")).repartition(min(n_blocks, 4 * max(keys.sparkSession.sparkContext.defaultParallelism, 4)), F.shiftrightunsigned("key", 64 - bits + block_bits))
    out = np.zeros((n_blocks, _BITMAP_BLOCK), dtype=np.uint8)
    for row in dealt.mapInArrow(mark, "block int, bits binary").collect():
        out[row["block"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


def marked(field: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Of each key, whether its place in a field of bitmap() is taken."""
    at = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return ((field[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
