"""Exact Jaccard self-join of documents' word shingles: a grouped prefix join.

1. A count sketch of fixed size over all documents' shingles orders the shingles, rare ones first.
2. A document's prefix is the part of its set, in that order, of which two sets at the threshold share at least
   one member. Documents with equal sets form a class; classes with identical prefixes and size form a group,
   and only groups post their prefixes.
3. In each list of postings, every group is first paired with one leader, the group with the fewest rare
   shingles. Pairs pass the length and position filters, are expanded to their classes and verified on the whole
   sets. That links nearly all of a large group of near copies by as many pairs as it has members.
4. Of what the lists still hold, all pairs that are not yet in one component are filtered, expanded and verified.
   Lists are split into bands of length, whose neighbours alone can link, and a parity signature of 256 bits bounds
   the sets' difference from below before any set is fetched. So no link between different components is lost, and
   pairs within a component are not spelled out.

Order and sketch steer the work only; any order gives the same result. Sets hold 64-bit hashes of shingles; a class
is known by a 128-bit hash of its set, a group by one of its prefix.

Defined results: a null or wordless text has an empty set and is linked with nothing; repeated rows are linked
with each other; a null doc_id is never a component's name unless all of its ids are null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm import common
from pairscope.llm.common import drop_path, saved, splitmix, table
from pairscope.llm.graph import components


@dataclass(frozen=True)
class JoinConfig:
    """Sets are linked at percent of their union; shingle: words of a shingle."""

    shingle: int = 4
    percent: int = 85
    sketch_bits: int = 21


_BLOCK = 1 << 14
_SKETCH_ROWS = 2
#: Stored bytes that one task of the sketch reads, where there are many: each task's counters are 16 MB.
_SKETCH_BYTES = 256 << 20
#: Words of 64 bits in a parity signature.
_PARITY = 4


def text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes of its lower-cased words."""
    data, offsets = common.text_buffers(column)
    for first, last in common.chunks(offsets):
        part = common.LOWER[data[offsets[first] : offsets[last]]]
        _, _, rows, hashes = common.words(part, offsets[first : last + 1] - offsets[first], common.SPACES)
        values, owners, _ = common.shingles(rows, hashes, k, last - first)
        at = common.by_row(owners, last - first)
        for i in range(last - first):
            yield np.unique(values[at[i] : at[i + 1]])


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [((values >> np.uint64(bits * r)) & mask).astype(np.int64) for r in range(_SKETCH_ROWS)]


def sketch(docs: DataFrame, config: JoinConfig) -> np.ndarray:
    """Count sketch of all documents' shingles: _SKETCH_ROWS x 2^sketch_bits counters, whatever the input's size."""
    size, k, bits = 1 << config.sketch_bits, config.shingle, config.sketch_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.working("ngram_join")
        total = np.zeros((_SKETCH_ROWS, size), dtype=np.uint32)
        for batch in batches:
            held: list[np.ndarray] = []
            for values in text_sets(batch.column(0), k):
                held.append(values)
                if sum(map(len, held[-64:])) > 1 << 18 or len(held) == 64:
                    _add(total, np.concatenate(held), bits)
                    held = []
            if held:
                _add(total, np.concatenate(held), bits)
        flat = total.reshape(-1, _BLOCK)
        for i in range(len(flat)):
            if flat[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([flat[i].tobytes()], pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                totals.setdefault(i, np.zeros(_BLOCK, dtype=np.uint64))
                totals[i] += np.frombuffer(counts.as_buffer(), dtype=np.uint32)
        packed = [np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    texts = docs.select("text")
    stored = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = max(2 * max(docs.sparkSession.sparkContext.defaultParallelism, 4), ceil(stored / _SKETCH_BYTES) if stored < 1 << 60 else 0)  # a larger size means an unknown one
    parts = texts.coalesce(tasks).mapInArrow(count, "block int, counts binary")
    n_blocks = _SKETCH_ROWS * size // _BLOCK
    out = np.zeros((n_blocks, _BLOCK), dtype=np.uint32)
    for row in parts.repartition(min(n_blocks, tasks), "block").mapInArrow(merge, "block int, counts binary").collect():  # of fixed size
        out[row["block"]] = np.frombuffer(row["counts"], dtype=np.uint32)
    return out.reshape(_SKETCH_ROWS, size)


def _add(total: np.ndarray, values: np.ndarray, bits: int) -> None:
    for own, places in zip(total, _places(values, bits), strict=True):
        np.add.at(own, places, np.uint32(1))


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def prefixes(docs: DataFrame, counts: np.ndarray, config: JoinConfig) -> DataFrame:
    """Per document of docs (doc_id, th, text): doc_id, th, n, c (its set's hash), gid (its prefix' and size's hash), rarity,
    its parity signature and the prefix."""
    shared, bits, k, percent = docs.sparkSession.sparkContext.broadcast(counts), config.sketch_bits, config.shingle, config.percent

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.working("ngram_join")
        seen = shared.value
        for batch in batches:
            ns, cs, gids, rare, parity, prefix = [], [], [], [], [], []
            for values in text_sets(batch.column(2), k):
                n = len(values)
                ns.append(n)
                cs.append(_set_hash(values, n))
                parity.append(_parity(values))
                if not n:
                    gids.append(b"")
                    rare.append(0)
                    prefix.append(values.view(np.int64))
                    continue
                one, two = _places(values, bits)
                often = np.minimum(seen[0][one], seen[1][two]).astype(np.float64)
                order = np.argsort((np.log2(often + 1) * 2040).astype(np.uint16), kind="stable")
                own = values[order[: prefix_length(n, percent)]]
                gids.append(_set_hash(own, n))
                rare.append(int((1 / np.maximum(often, 1)).mean() * 0x7FFF))
                prefix.append(own.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefix])]), pa.int32()), pa.array(np.concatenate(prefix) if prefix else [], pa.int64()))
            signs = pa.ListArray.from_arrays(pa.array(np.arange(len(parity) + 1) * _PARITY, pa.int32()), pa.array(np.concatenate(parity) if parity else [], pa.int64()))
            columns = [batch.column(0), batch.column(1), pa.array(ns, pa.int32()), pa.array(cs, pa.binary()), pa.array(gids, pa.binary()), pa.array(rare, pa.int64()), signs, lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "c", "gid", "rarity", "parity", "prefix"])

    return docs.select("doc_id", "th", "text").mapInArrow(find, "doc_id long, th long, n int, c binary, gid binary, rarity long, parity array<bigint>, prefix array<bigint>")


def _set_hash(values: np.ndarray, n: int) -> bytes:
    """128 bits of a set of n members, of which values are hashed; n counts apart."""
    salts = np.array([0x9E3779B97F4A7C15, 0xA0761D6478BD642F], dtype=np.uint64)
    with np.errstate(over="ignore"):
        sums = [np.add.reduce(splitmix(values + salt), dtype=np.uint64) if len(values) else np.uint64(0) for salt in salts]
        return splitmix(np.array(sums, dtype=np.uint64) + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93)).tobytes()


def _parity(values: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of members falls on it: where two sets' bits differ, so do the sets."""
    odd = np.bincount((values >> np.uint64(40)).astype(np.int64) % (64 * _PARITY), minlength=64 * _PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(n1: Column, n2: Column, p1: Column, p2: Column, percent: int) -> Column:
    """Length and position filters at a shared prefix member at places p1 and p2."""
    lengths = (F.least(n1, n2) * 100) >= (F.greatest(n1, n2) * percent)
    return lengths & (F.least(n1 - p1, n2 - p2) * (100 + percent) >= (n1 + n2) * percent)


def _may_differ(n1: Column, n2: Column, s1: Column, s2: Column, percent: int) -> Column:
    """Whether the signatures differ in no more bits than sets at the threshold differ in members."""
    differ = sum((F.bit_count(F.get(s1, i).bitwiseXOR(F.get(s2, i))) for i in range(_PARITY)), F.lit(0))
    return differ * (100 + percent) <= (n1 + n2) * (100 - percent)


def _band(n: Column, percent: int) -> Column:
    """Lengths in bands so wide that two sets at the threshold are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(-log(percent / 100) * 1.000001)).cast("int")


def _sets(docs: DataFrame, touched: DataFrame, classes: DataFrame, most: int, k: int) -> DataFrame:
    """touched (c), at most so many -> (c, body): the classes' sets.

    Documents are found by a scan that two bitmaps guide: one of the ids that stand for classes, one of the classes.
    Their sizes follow most; what they let pass besides does no harm. A set comes once from each task that finds it:
    more often than once only where an id is repeated."""
    bits = common.bitmap_bits(most)
    wanted = classes.join(touched, "c").select(F.xxhash64("rep").alias("id"), _name_key(F.col("c")).alias("name"))
    spark = docs.sparkSession
    ids, names = (spark.sparkContext.broadcast(common.bitmap(wanted.select(x), bits)) for x in ("id", "name"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            chosen = common.marked(ids.value, batch.column(0).to_numpy().view(np.uint64), bits)
            if not chosen.any():
                continue
            held: list[tuple[bytes, np.ndarray]] = []
            size = 0
            for values in text_sets(batch.column(1).filter(pa.array(chosen)), k):
                name = _set_hash(values, len(values))
                if name in done or not common.marked(names.value, np.array([int.from_bytes(name[:7], "big") << 8], dtype=np.uint64), bits)[0]:
                    continue
                done.add(name)
                held.append((name, values.view(np.int64)))
                size += len(values)
                if size > _SLICE:
                    yield _set_batch(held)
                    held, size = [], 0
            if held:
                yield _set_batch(held)

    return docs.select(F.xxhash64("doc_id"), "text").mapInArrow(find, "c binary, body array<bigint>")


#: Members of sets that a worker hands over at once (4 MB).
_SLICE = 1 << 19


def _name_key(c: Column) -> Column:
    """A class name's first seven bytes as the high ones of a long."""
    return F.shiftleft(F.conv(F.hex(F.substring(c, 1, 7)), 16, 10).cast("long"), 8)


def _set_batch(held: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(v) for _, v in held])])
    bodies = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([v for _, v in held]), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.binary()), bodies], names=["c", "body"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are at the threshold."""
    one, two = sets.select(F.col("c").alias("a"), F.col("body").alias("body1")), sets.select(F.col("c").alias("b"), F.col("body").alias("body2"))
    shared = F.size(F.array_intersect("body1", "body2"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("m"), (F.size("body1") + F.size("body2")).alias("both"))
    return met.where(F.col("m") * 100 >= (F.col("both") - F.col("m")) * percent).select("a", "b")


def _checked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, config: JoinConfig, label: str) -> tuple[DataFrame | None, str]:
    """Those of pairs (a, b) of classes that are at the threshold, in a table of its own; None where there are no pairs."""
    pairs, path = saved(pairs, f"{label}-pairs")
    n_pairs = pairs.count()
    if not n_pairs:
        return None, path
    touched = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    sets, sets_path = saved(_sets(docs, touched, classes, 2 * n_pairs, config.shingle), f"{label}-sets")
    if not sets.groupBy("c").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        once, once_path = saved(sets.dropDuplicates(["c"]), f"{label}-sets")
        drop_path(docs.sparkSession, sets_path)
        sets, sets_path = once, once_path
    found, found_path = saved(_verified(pairs, sets, config.percent), label)
    for old in (path, sets_path):
        drop_path(docs.sparkSession, old)
    return found, found_path


@dataclass
class _Lists:
    """What both joins start from: documents, classes of equal sets, postings that meet, classes of groups with several, and their tables' paths."""

    own: DataFrame
    classes: DataFrame
    lists: DataFrame
    groups: DataFrame
    large: DataFrame
    paths: list[str]


def _keyed(docs: DataFrame) -> DataFrame:
    return common.small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"))


def _lists(docs: DataFrame, config: JoinConfig) -> _Lists:
    own, own_path = saved(prefixes(docs, sketch(docs, config), config), "prefixes")
    filled = own.where("n > 0")
    classes, classes_path = saved(filled.groupBy("c").agg(F.first("n").alias("n"), F.first("gid").alias("gid"), F.min("doc_id").alias("rep"), F.first("parity").alias("parity")), "classes")
    # a list is led by the group of the lowest rank: a long, so that lists are counted and led by a hash aggregate
    rank = F.shiftleft("rarity", 48).bitwiseOR(F.xxhash64("gid").bitwiseAND(F.lit((1 << 48) - 1)))
    heads, heads_path = saved(filled.dropDuplicates(["gid"]).select("gid", "n", rank.alias("rank"), "prefix"), "heads")
    posted = heads.select("gid", "n", "rank", F.posexplode("prefix").alias("p", "token"))
    met = posted.groupBy("token").agg(F.min("rank").alias("lead"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    lists = posted.join(met, "token").select("token", "gid", "n", "p", (F.col("rank") == F.col("lead")).alias("leads"))
    lists, lists_path = saved(lists, "lists")
    drop_path(docs.sparkSession, heads_path)
    groups = classes.groupBy("gid").agg(F.min("c").alias("first"), F.count(F.lit(1)).alias("size"))
    large = classes.join(groups.where("size > 1"), "gid")
    return _Lists(own, classes, lists, groups, large, [own_path, classes_path, lists_path])


def _members(found: _Lists, placed: DataFrame) -> DataFrame:
    """Rows (token, c, n, p, and placed's columns) of all classes in all lists; a group of several classes is a list of its own."""
    inner = found.large.select(F.xxhash64("gid").alias("token"), "gid", "n", F.lit(0).alias("p")).distinct()
    return found.lists.select("token", "gid", "n", "p").union(inner).join(placed, "gid").drop("gid")


def _near(members: DataFrame, percent: int, roots: bool) -> DataFrame:
    """Distinct pairs (a, b) of members that share a list and pass the filters; with roots, of different roots only.

    A member meets those of its own and of the next bands of length in its list."""
    banded = members.withColumn("band", _band(F.col("n"), percent))
    x = banded.withColumn("meets", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("x")
    y = banded.alias("y")
    # within a band each pair once, by name; between bands from the lower one
    once = (F.col("x.band") < F.col("y.band")) | (F.col("x.c") < F.col("y.c"))
    near = (F.col("x.token") == F.col("y.token")) & (F.col("x.meets") == F.col("y.band")) & once & _may_link(F.col("x.n"), F.col("y.n"), F.col("x.p"), F.col("y.p"), percent)
    near = near & _may_differ(F.col("x.n"), F.col("y.n"), F.col("x.parity"), F.col("y.parity"), percent)
    if roots:
        near = near & (F.col("x.root") != F.col("y.root"))
    return x.join(y, near).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def links(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """Every link between documents of different sets, as pairs (doc_id, other_id) of their classes' smallest ids.

    Its output grows with the square of a group of near copies; :func:`join` gives components without it."""
    docs = _keyed(docs)
    found = _lists(docs, config)
    members = _members(found, found.classes.select("gid", "c", "parity"))
    checked, checked_path = _checked(docs, found.classes, _near(members, config.percent, False), config, "links")
    if checked is None:
        checked = docs.sparkSession.createDataFrame([], _EDGES)
    names = found.classes.select("c", "rep")
    out = checked.distinct().join(names.select(F.col("c").alias("a"), F.col("rep").alias("ra")), "a").join(names.select(F.col("c").alias("b"), F.col("rep").alias("rb")), "b")
    result, _ = saved(out.select(F.least("ra", "rb").alias("doc_id"), F.greatest("ra", "rb").alias("other_id")), "linked")
    for path in (*found.paths, checked_path):
        drop_path(docs.sparkSession, path)
    return result


_EDGES = "a binary, b binary"


def _joined(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """Per document of docs (doc_id, th, text): doc_id, th, n, class_id, component_id, and root, the component's own name (NULL: an empty set)."""
    spark, percent = docs.sparkSession, config.percent
    found = _lists(docs, config)
    common.release(spark)
    own, classes, lists, groups, large = found.own, found.classes, found.lists, found.groups, found.large

    lead = lists.where("leads").select("token", F.col("gid").alias("lead_gid"), F.col("n").alias("lead_n"), F.col("p").alias("lead_p"))
    led = lists.where("NOT leads").join(lead, "token").where(_may_link(F.col("n"), F.col("lead_n"), F.col("p"), F.col("lead_p"), percent)).select("gid", "lead_gid").distinct()
    one = classes.select("gid", F.col("c").alias("a"), F.col("n").alias("n1"), F.col("parity").alias("s1"))
    heads = groups.select(F.col("gid").alias("lead_gid"), F.col("first").alias("b"))
    two = heads.join(classes.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("parity").alias("s2")), "b")
    led = led.join(one, "gid").join(two, "lead_gid").where(_may_differ(F.col("n1"), F.col("n2"), F.col("s1"), F.col("s2"), percent)).select("a", "b")
    star = led.union(large.where("c <> first").select(F.col("c").alias("a"), F.col("first").alias("b"))).distinct()

    edges, edges_path = _checked(docs, classes, star, config, "star")
    if edges is None:
        edges = spark.createDataFrame([], _EDGES)
    roots = components(edges)

    placed = classes.select("gid", "c").join(roots, F.col("c") == F.col("node"), "left").select("gid", "c", F.coalesce("root", "c").alias("root"))
    members, members_path = saved(_members(found, placed), "members")
    split = members.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    parted = members.join(split, "token").join(classes.select("c", "parity"), "c")
    common.release(spark)
    more, more_path = _checked(docs, classes, _near(parted, percent, True), config, "rest")
    if more is not None and not more.isEmpty():
        roots = components(edges.union(more))

    named = classes.select("c", "rep").join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = named.join(lowest, "root").select("c", F.col("rep").alias("class_id"), "component_id", "root")
    result, _ = saved(own.select("doc_id", "th", "n", "c").join(final, "c", "left").drop("c"), "components")
    for path in (*found.paths, edges_path, members_path, more_path):
        drop_path(spark, path)
    return result


def join(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, n_shingles, class_id and component_id."""
    found = _joined(_keyed(docs), config)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over all documents, at 4-word shingles and 85 percent."""
    return join(table(spark, sf_dir, "documents"))


#: The pipeline's near copies: five words and a similarity of 0.8.
STAGE = JoinConfig(shingle=5, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: of its smallest id (an id before none), the text with the lowest hash. Rows without words stay."""
    found = _joined(_keyed(docs), STAGE).where("n > 0")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keepers, _ = saved(first.groupBy("root").agg(F.min("th").alias("low"), F.count(F.lit(1)).alias("rows")), "keepers")
    several = keepers.where("rows > 1").select(F.col("root").alias("of"), "low")
    spare = first.join(several, F.col("root") == F.col("of")).where("th <> low")
    copies = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "th").union(spare.select("doc_id", "th")).distinct()
    gone, _ = saved(copies, "gone")
    inner = common.free_names(docs.columns, "id", "gone", "th")
    left = docs.withColumn(inner["th"], F.xxhash64("text"))

    def same(names: dict[str, str]) -> Column:
        return F.col("doc_id").eqNullSafe(F.col(names["id"])) & (F.col(inner["th"]) == F.col(names["gone"]))

    held, clean = common.parted(left, F.xxhash64(F.col("doc_id").cast("long"), F.col(inner["th"])), gone.select(F.xxhash64("doc_id", "th")))
    kept = held.join(gone.toDF(inner["id"], inner["gone"]), same(inner), "left_anti").unionByName(clean)
    if several.isEmpty():
        return kept.select(*docs.columns)
    # rows that repeat a keeper's id and text: one of them stays
    again = first.join(several, F.col("root") == F.col("of")).where("th = low").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "th")
    again = again.toDF(inner["id"], inner["gone"])
    once = kept.join(again, same(inner), "left_semi").dropDuplicates(["doc_id", inner["th"]])
    return kept.join(again, same(inner), "left_anti").unionByName(once).select(*docs.columns)


ORACLE_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b, m = x.n AND m = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT b AS doc_id, min(a) AS low FROM e WHERE same GROUP BY b)
SELECT r.doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, any_value(least(r.doc_id, coalesce(c.low, r.doc_id))) AS class_id, min(root) AS component_id
FROM r LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY r.doc_id"""
