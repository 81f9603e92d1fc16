"""SimHash fingerprints and their exact search in block tables, in DataFrame functions only.

Each word of the lower-cased text votes with its weight on 128 signed bits. A word of up to four letters weighs
1 and a longer one its length + 1, so rare words rule over function words without a pass for counts. Votes are
summed two to a 64-bit column, in lanes of 32 bits; a text's weights add up to less than 2^31 as no word weighs
more than the bytes it and its separator take.

To meet its next one, each document goes to a group of neighbours by (doc_id, hash of text), so a doc_id that many
rows share, or lack, is spread over groups too; rows equal in both stay together.

Defined results: a null text counts as empty and has the fingerprint 0; equal texts have equal fingerprints;
a null doc_id sorts below all others; rows of equal doc_id follow by descending xxhash64 of their text; the only row of a
table is its own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairscope.llm.common import saved, table

HALVES, LANES = 2, 32
BITS = HALVES * 64
RADIUS, BLOCKS = 16, 6
#: Documents that one group of neighbours aims at, the most groups there are (whose bounds the driver holds), and the
#: documents a group that are sampled to place the bounds, which steer the work only.
GROUP_ROWS, MOST_GROUPS, SAMPLED = 500, 1 << 16, 8
#: Searches are asked for the documents whose id this divides.
ASKED = 100
_LOWEST = -(1 << 63)


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Fingerprints f0, f1 (64 bits each) of the texts of rows, one per distinct keys. Summed on the map side."""
    split = rows.select(*keys, F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word"))
    size = F.char_length("word")
    weighed = split.select(*keys, F.xxhash64("word").alias("h0"), F.when(size == 0, 0).when(size < 5, 1).otherwise(size + 1).cast("long").alias("w"))
    hashed = weighed.withColumn("h1", F.xxhash64("h0"))
    pair = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned(f"h{h}", k).bitwiseAND(pair) * F.col("w")).alias(f"s{h}_{k}") for h in range(HALVES) for k in range(LANES)]
    counted = hashed.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    low = F.lit((1 << 32) - 1)

    def half(h: int) -> Column:
        pairs, more = F.array(*[F.col(f"s{h}_{k}") for k in range(LANES)]), F.col("total")

        def bit(at: Column, k: Column) -> Column:
            both = F.get(pairs, k)
            one = F.when(both.bitwiseAND(low) * 2 > more, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(0)
            two = F.when(F.shiftrightunsigned(both, 32) * 2 > more, F.call_function("shiftleft", F.lit(1 << 32), k)).otherwise(0)
            return at.bitwiseOR(one).bitwiseOR(two)

        return F.aggregate(F.sequence(F.lit(0), F.lit(LANES - 1)), F.lit(0).cast("long"), bit)

    return counted.select(*keys, *[half(h).alias(f"f{h}") for h in range(HALVES)])


def _long_array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


Bound = tuple[int, int]  # doc_id, hash of text


def _below(bounds: list[Bound], key: Column, tie: Column) -> Column:
    """How many of the ascending bounds are below (key, tie): a binary search."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    keys, ties = _long_array([k for k, _ in bounds]), _long_array([t for _, t in bounds])

    def step(at: Column, s: Column) -> Column:
        own, other = F.get(keys, at + s - 1), F.get(ties, at + s - 1)
        return F.when((own < key) | ((own == key) & (other < tie)), at + s).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _placed(docs: DataFrame) -> DataFrame:
    """docs with the two by which they are in order: key and tie."""
    return docs.withColumns({"key": F.coalesce("doc_id", F.lit(_LOWEST)), "tie": F.xxhash64(F.coalesce("text", F.lit("")))})


def neighbour_bounds(docs: DataFrame) -> list[Bound]:
    """Ascending bounds that part docs (doc_id, text) into groups of about GROUP_ROWS; each is the largest of its group."""
    n = docs.count()
    groups = max(1, min(MOST_GROUPS, n // GROUP_ROWS))
    slim = _placed(docs).select("key", "tie")
    sample = slim.sample(min(1.0, SAMPLED * groups / max(n, 1)), seed=1).agg(F.sort_array(F.collect_list(F.struct("key", "tie"))).alias("s"))  # of at most SAMPLED * MOST_GROUPS rows
    picked = F.transform(F.sequence(F.lit(1), F.lit(groups)), lambda i: F.get("s", F.floor(i * F.size("s") / groups).cast("int") - 1))
    rough = sample.select(F.array_compact(picked).alias("s")).first()["s"]
    rough = sorted({(r["key"], r["tie"]) for r in rough}) or [(0, 0)]
    tops = slim.groupBy(_below(rough, F.col("key"), F.col("tie")).alias("g")).agg(F.max(F.struct("key", "tie")).alias("top"))
    return sorted((r["top"]["key"], r["top"]["tie"]) for r in tops.collect())  # a row per group


def in_groups(docs: DataFrame, bounds: list[Bound]) -> DataFrame:
    """docs (doc_id, text, ...) with key, tie, group and guest: each group also gets the row that follows its last, as a guest."""
    placed = _placed(docs).withColumn("own", _below(bounds, F.col("key"), F.col("tie")))
    here, there = F.struct(F.col("own").alias("group"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("own") + 1, F.lit(len(bounds))).alias("group"), F.lit(True).alias("guest"))
    top = (F.get(_long_array([k for k, _ in bounds]), F.col("own")) == F.col("key")) & (F.get(_long_array([t for _, t in bounds]), F.col("own")) == F.col("tie"))
    places = F.when(top, F.array(here, there)).otherwise(F.array(here))
    return placed.select("*", F.explode(places).alias("place")).select(*docs.columns, "key", "tie", "place.group", "place.guest")


def edited(docs: DataFrame, bounds: list[Bound]) -> DataFrame:
    """Each document's text with its last third replaced from the next one, by descending doc_id."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("group").orderBy("guest", F.desc("key"), F.desc("tie"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    rows = in_groups(slim, bounds).withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.withColumn("edited", F.when(F.col("guest"), F.lit("")).otherwise(text))


def within(fingerprints: DataFrame, asked: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs of asked (q0, q1) and fingerprints (f0, f1, both distinct) at most radius bits apart, by block tables.

    Each block has a number of bits, spare, that it may differ by; as they and one more per block add up to more than
    radius, some block of a pair keeps to it. A fingerprint is stored once a block, and asked for by every value
    that near to its block's. A pair comes from its first such block only."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    spare = [(radius + 1 + i) // blocks - 1 for i in reversed(range(blocks))]

    def block(halves: tuple[Column, Column], i: int) -> Column:
        out, at = F.lit(0).cast("long"), 0
        for half in range(HALVES):
            first, last = max(edges[i], half * 64), min(edges[i + 1], half * 64 + 64)
            if first < last:
                part = F.shiftrightunsigned(halves[half], first - half * 64).bitwiseAND(F.lit((1 << (last - first)) - 1))
                out, at = out.bitwiseOR(F.shiftleft(part, at)), at + last - first
        return out

    def flips(i: int) -> list[int]:
        width = edges[i + 1] - edges[i]
        return [sum(1 << b for b in chosen) for n in range(spare[i] + 1) for chosen in combinations(range(width), n)]

    def probe(i: int) -> Column:
        return F.transform(_long_array(flips(i)), lambda m: F.struct(F.lit(i).alias("u"), block(other, i).bitwiseXOR(m).alias("v")))

    used = [i for i in range(blocks) if spare[i] >= 0]
    own, other = (F.col("f0"), F.col("f1")), (F.col("q0"), F.col("q1"))
    stored = fingerprints.select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("t"), block(own, i).alias("k")) for i in used])))
    differ = (other[0].bitwiseXOR(own[0]), other[1].bitwiseXOR(own[1]))
    apart, first = F.bit_count(differ[0]) + F.bit_count(differ[1]), F.lit(True)
    for i in used:
        first = first & ((F.col("t") <= i) | (F.bit_count(block(differ, i)) > spare[i]))
    # asked is small but its probes are not: they are never broadcast
    probes = asked.select("*", F.inline(F.concat(*map(probe, used))))
    met = probes.join(stored.hint("merge"), (F.col("u") == F.col("t")) & (F.col("v") == F.col("k")) & (apart <= radius) & first)
    return met.drop("t", "k", "u", "v")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, the halves of its own, its edited text's and the next one's fingerprint."""
    slim = docs.select("doc_id", "text")
    bounds = neighbour_bounds(slim)
    if not bounds:
        bounds = [(0, 0)]
    rows = edited(slim, bounds).withColumn("rid", F.monotonically_increasing_id()).withColumn("sha", F.sha2("edited", 256))
    sides = F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body"))))
    keys = ["group", "guest", "key", "tie", "rid", "side", "doc_id", "n_chars", "sha"]
    prints = votes(rows.select(*[c for c in keys if c != "side"], F.inline(sides)), keys, "body")
    order = Window.partitionBy("group").orderBy("guest", F.desc("key"), F.desc("tie"), "rid", "side")
    ahead = [F.lead(f"f{h}", i).over(order).alias(f"{name}{h}") for i, name in ((1, "e"), (2, "n")) for h in range(HALVES)]
    return prints.select("*", *ahead).where("side = 0 AND NOT guest").select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "f0", "f1", "e0", "e1", "n0", "n1")


def _hex(halves: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in reversed(halves)]))


def _own(name: str) -> list[Column]:
    return [F.col(f"{name}{h}") for h in range(HALVES)]


def _likeness(a: str, b: str) -> Column:
    apart = sum((F.bit_count(F.col(f"{a}{h}").bitwiseXOR(F.col(f"{b}{h}"))) for h in range(HALVES)), F.lit(0))
    return 1 - apart / F.lit(float(BITS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their likeness to the edited and the next text, and for every hundredth id
    near: the distinct fingerprints within RADIUS bits (its own included), and n_near: how many other documents have one of them."""
    prints, _ = saved(fingerprint(table(spark, sf_dir, "documents")), "prints")
    distinct = prints.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("copies"))
    searched = F.coalesce(F.col("doc_id") % ASKED == 0, F.lit(False))
    asked = prints.where(searched).select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    near = within(distinct, asked).groupBy("q0", "q1").agg((F.sum("copies") - 1).alias("n_near"), F.collect_list(F.struct("f0", "f1")).alias("near"))
    # the rows not asked for stay out of the join: large classes of equal fingerprints would meet in one task
    found = prints.where(searched).join(near, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1"))).drop("q0", "q1")
    joined = found.unionByName(prints.where(~searched), allowMissingColumns=True)
    listed = F.sort_array(F.transform("near", lambda x: _hex([x[f"f{h}"] for h in range(HALVES)])))
    prints_of = {"fingerprint": _hex(_own("f")), "edited_fingerprint": _hex(_own("e")), "near_edited": _likeness("f", "e"), "near_next": _likeness("f", "n")}
    return joined.select("doc_id", "n_chars", "edited_sha256", *[c.alias(n) for n, c in prints_of.items()], "n_near", listed.alias("near"))
