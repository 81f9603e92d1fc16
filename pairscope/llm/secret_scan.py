"""Secret scans by a trigram inverted index, in DataFrame functions only.

Every rule's regex gives a Boolean trigram query (an OR of ANDs) by reading the regex' parse tree. The index
holds a posting (trigram, document key) for each trigram that some rule asks for and that occurs in the
lower-cased text. Postings are intersected per clause, the documents found are verified with the regex itself,
and a rule without mandatory trigrams scans every document in place. A bitmap of the found documents' keys, 32 MB at
most, tells the scan whose texts go on to be verified; others leave it with their spans alone.

Document key: a hash of (doc_id, text), so equal rows share a fate and copies spread over all partitions.
Defined results: a null text counts as empty; repeated rows and equal or null doc_ids give a row each; an empty
table gives no rows; other columns are ignored. Spans count code points, end exclusive.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import bitmap_table, bucket, is_taken, saved, table

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as sre
    from re import _parser as sre_parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of regex whose group has at least min_chars characters."""

    kind: str
    regex: str
    group: int = 0
    min_chars: int = 0
    base: bool = False


#: The first three are given; the others add spans of further kinds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

Query = frozenset  # an OR of ANDs: a set of sets of trigrams; an empty inner set is "any document"
ANY: Query = frozenset([frozenset()])
_MOST = 64


def _both(a: Query, b: Query) -> Query:
    if ANY in (a, b):
        return b if a == ANY else a
    if len(a) * len(b) > _MOST:
        return a if len(a) < len(b) else b
    return _least(frozenset(x | y for x, y in product(a, b)))


def _least(q: Query) -> Query:
    """Without clauses that another clause implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _read(tree) -> tuple[set[str] | None, Query]:
    """Of a parse tree: all the strings it matches (None: too many), and its query where there are too many."""
    runs, query, whole = {""}, ANY, True
    for op, arg in tree:
        exact, inner = _node(op, arg)
        if exact is not None and len(exact) * len(runs) <= _MOST:
            runs = {a + b for a, b in product(runs, exact)}
            continue
        query = _both(_both(query, _of_strings(runs)), inner if exact is None else _of_strings(exact))
        runs, whole = {""}, False
    return (runs, ANY) if whole else (None, _both(query, _of_strings(runs)))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < _MOST:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if op is sre.SUBPATTERN:
        return _read(arg[-1])
    if op is sre.BRANCH:
        found = [_read(x) for x in arg[1]]
        if all(exact is not None for exact, _ in found):
            return set().union(*(exact for exact, _ in found)), ANY
        parts = [q if exact is None else _of_strings(exact) for exact, q in found]
        return None, ANY if ANY in parts else _least(frozenset().union(*parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _read(inner)
        if low == 0:
            return (exact | {""}, ANY) if high == 1 and exact is not None else (None, ANY)
        if exact is not None and low == high and len(exact) ** low <= _MOST:
            return {"".join(p) for p in product(exact, repeat=low)}, ANY
        return None, query if exact is None else _of_strings(exact)
    if op is sre.AT:
        return {""}, ANY
    return None, ANY


def trigram_query(regex: str) -> Query:
    """What lower-cased trigrams any match of the regex must bring along."""
    exact, query = _read(sre_parser.parse(regex))
    return query if exact is None else _of_strings(exact)


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: a row (trigram, key) where the lower-cased text has the trigram."""
    low = docs.select(F.col("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """Per key of docs (key, text) the kinds whose query it meets; without the rules that have no query."""
    clauses = [(r.kind, i, sorted(clause)) for r in rules if (q := trigram_query(r.regex)) != ANY for i, clause in enumerate(sorted(q, key=sorted))]
    if not clauses:
        return None
    spark = docs.sparkSession
    asked = [(kind, i, t, 1 << j, (1 << len(clause)) - 1) for kind, i, clause in clauses for j, t in enumerate(clause)]
    wanted = F.broadcast(spark.createDataFrame(asked, "kind string, clause int, trigram string, bit long, all_bits long"))  # as many rows as the rules' clauses have
    index = postings(docs, sorted({t for _, _, clause in clauses for t in clause}))
    met = index.join(wanted, "trigram").groupBy("key", "kind", "clause", "all_bits").agg(F.bit_or("bit").alias("bits")).where("bits = all_bits")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """An array of structs (start, rank, end) of the rule's matches; text must not hold U+0001 and U+0002."""
    parts = F.split(F.regexp_replace(text, F.lit(rule.regex), F.lit("\u0001$0\u0002")), "\u0001")

    def step(at: Column, part: Column) -> Column:
        match = F.substring_index(part, "\u0002", 1)
        end = at["pos"] + F.char_length(match)
        held = F.lit(True) if not rule.min_chars else F.char_length(match if not rule.group else F.regexp_extract(match, rule.regex, rule.group)) >= rule.min_chars
        span = F.array(F.struct(at["pos"].alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct((at["pos"] + F.char_length(part) - 1).alias("pos"), F.when(held, F.concat(at["spans"], span)).otherwise(at["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    start = F.struct(F.char_length(F.element_at(parts, 1)).alias("pos"), none.alias("spans"))
    return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.size(parts)), start, step, lambda at: at["spans"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of every document: doc_id and spans, an array of (start, kind, end) by start, then in the rules' order."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", document_key())
    marks = F.contains("text", F.lit("\u0001")) | F.contains("text", F.lit("\u0002"))
    text = F.when(marks, F.translate("text", "\u0001\u0002", "\u0003\u0003")).otherwise(F.col("text"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    guided = {rank for rank, rule in enumerate(rules) if trigram_query(rule.regex) != ANY}
    everywhere = [_matches(F.col("text"), rule, rank) for rank, rule in enumerate(rules) if rank not in guided]
    here = F.concat(none, *everywhere)
    found = candidates(docs, rules)
    if found is None:
        return docs.withColumn("text", text).select("doc_id", F.array_sort(here).alias("spans"))
    found, _ = saved(found, "candidates")
    bitmap, bits = bitmap_table(found.select("key"), found.count())
    asked = docs.withColumn("text", text).join(bitmap, bucket(F.col("key"), bits) == F.col("bucket"), "left")
    slim = asked.select("doc_id", "key", here.alias("here"), F.when(is_taken(F.col("key"), F.col("taken"), bits), F.col("text")).alias("text"))
    each = [F.when(F.array_contains("kinds", F.lit(rules[rank].kind)), _matches(F.col("text"), rules[rank], rank)).otherwise(none) for rank in sorted(guided)]
    return slim.join(found, "key", "left").select("doc_id", F.array_sort(F.concat("here", *each)).alias("spans"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def _count(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in all documents."""
    found = scan(table(spark, sf_dir, "documents"))
    bases = [i for i, r in enumerate(RULES) if r.base]
    base = F.filter("spans", lambda s: s["rank"] <= max(bases))
    counts = [_count(i).alias(f"n_{RULES[i].kind}") for i in bases]
    return found.select("doc_id", *counts, F.sha2(_listed(base, RULES), 256).alias("base_sha256"), _listed(F.col("spans"), RULES).alias("spans"))


def _oracle() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = []
    for rank, r in enumerate(RULES):
        held = f"length(regexp_extract(m, {quoted(r.regex)}, {r.group})) >= {r.min_chars}" if r.min_chars else "true"
        parts.append(f"""SELECT rid, {rank} AS rank, '{r.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT rid, i, before AS s, left(part, strpos(part, chr(2)) - 1) AS m FROM (
    SELECT rid, i, part, sum(length(part) - (i > 1)::INT) OVER (PARTITION BY rid ORDER BY i) - (length(part) - (i > 1)::INT) AS before FROM (
      SELECT rid, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (
        SELECT rid, string_split(regexp_replace(t, {quoted(r.regex)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM d) WHERE len(p) > 1)) WHERE i > 1)
WHERE {held}""")
    union = "\nUNION ALL\n".join(parts)
    listed = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
f AS ({union})
SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce({listed} FILTER (rank <= 2), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""


ORACLE_SQL = _oracle()

__all__ = ["ORACLE_SQL", "RULES", "Rule", "candidates", "postings", "query", "scan", "trigram_query"]
