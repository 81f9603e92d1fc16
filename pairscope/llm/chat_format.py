"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. The formatter renders successive prefixes of a
conversation and compares consecutive outputs: where an output extends the one before, the added text is the new
turn's span; where it does not, the template rewrites history, which is reported with the length of the part
that stayed. Within a span the turn's (escaped) text is located, which gives the loss mask of assistant turns.

Every prefix is rendered, at any length and for any template, the query's own included, so time grows by the square
of a conversation's turns (for the query's template by copies of its kept texts alone). The output is always the
whole template(turns). Where history is rewritten, the spans are those of the turns before it that lie in
what the output still shares with the last prefix that held. An assistant turn whose text isn't in its span, as the
template altered it, is reported and has no loss span.

The template of this module, TURNS, marks turns and escapes control strings within texts reversibly.
Defined results: a null text counts as empty, a null role as the empty role; turns sort by number, then role, then
text, with nulls first, and repeated rows are turns of their own; rows without conv_id form a conversation; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import takewhile
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
ASSISTANT = "assistant"

#: Control strings: a backslash and a letter in texts can stand for each of them.
START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
_ESCAPES = {"\\": "\\\\", "<|": "\\<\\|", "[INST]": "\\[INST\\]", "[/INST]": "\\[/INST\\]", "<s>": "\\<s\\>", "</s>": "\\</s\\>"}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    for raw, safe in _ESCAPES.items():  # the backslash first; no other control string overlaps what a replacement leaves
        text = text.replace(raw, safe)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Pieces:
    """A template that is a head and then a text for each turn, which depends on that turn alone; to render() a black box
    as any other. It keeps the texts of the turns it was last called with, as the next call often begins with the same."""

    head: str
    piece: Callable[[str, str], str]
    _turns: list[Turn] = field(default_factory=list, init=False, repr=False, compare=False)
    _texts: list[str] = field(default_factory=list, init=False, repr=False, compare=False)

    def __call__(self, turns: list[Turn]) -> str:
        same = sum(1 for _ in takewhile(bool, map(eq, turns, self._turns)))
        del self._turns[same:], self._texts[same:]
        for turn in turns[same:]:
            self._texts.append(self.piece(*turn))
            self._turns.append(turn)
        return self.head + "".join(self._texts)


def _block(role: str, text: str) -> str:
    return f"{START}{escape(role)}{MIDDLE}{escape(text)}{'</s>' if role == ASSISTANT else END}\n"


#: <s> for the start, then a marked block for each turn; an assistant's ends with </s>.
turns_template = Pieces("<s>", _block)


@dataclass
class Formatted:
    """The output, each turn's span, the loss spans, the first turn that rewrote history (None: none did), and the assistant
    turns before it whose text the output doesn't hold, as a template has altered it: they have no loss span."""

    text: str
    spans: list[tuple[int, int]]
    loss: list[tuple[int, int]]
    rewrites: int | None = None
    stayed: int | None = None
    altered: list[int] = field(default_factory=list)


def _common(a: str, b: str, low: int = 0) -> int:
    """The length of what a and b share from the start, of which low is known."""
    high = min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _place(turns: list[Turn], i: int, template: Template, before: str) -> tuple[int, int]:
    """What stands before and after the text of turn i in the output of turns[: i + 1]: how many characters two renderings
    of the turn, with unlike texts, share at the start and at the end."""
    one, two = (template([*turns[:i], (turns[i][0], text)]) for text in ("a", "b"))
    head = _common(one, two, len(before) if one.startswith(before) and two.startswith(before) else 0)
    return max(head, len(before)), _common(one[head:][::-1], two[head:][::-1])


def render(turns: list[Turn], template: Template, escaping: Callable[[str], str] = escape) -> Formatted:
    """Locates every turn's span in the template's output, by renderings of successive prefixes alone."""
    before = template([])
    out = Formatted("", [], [])
    for i, (role, text) in enumerate(turns):
        after = template(turns[: i + 1])
        if not after.startswith(before):
            out.rewrites, out.stayed = i, _common(before, after)
            break
        out.spans.append((len(before), len(after)))
        if role == ASSISTANT:
            head, tail = _place(turns, i, template, before)
            body = escaping(text)
            if (at := after.find(body, head, len(after) - tail)) >= 0:
                out.loss.append((at, at + len(body)))
            else:
                out.altered.append(i)
        before = after
    out.text = before if out.rewrites is None else template(turns)
    if out.rewrites is not None:
        still = _common(before, out.text)
        out.spans, out.loss = ([x for x in found if x[1] <= still] for found in (out.spans, out.loss))
    return out


_BLOCK = re.compile(f"{re.escape(START)}(.*?){re.escape(MIDDLE)}(.*?)(?:{re.escape(END)}|</s>)\n", re.DOTALL)


def parse(text: str) -> list[Turn]:
    """The turns that turns_template rendered: escaped texts hold no control string."""
    return [(unescape(m[1]), unescape(m[2])) for m in _BLOCK.finditer(text, 3)]


def format_conversations(rows: DataFrame, template: Template = turns_template, escaping: Callable[[str], str] = escape) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): conv_id, formatted, spans, loss, rewrites and altered, by any template and its escaping."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns.as_py()], template, escaping) for turns in batch.column(1)]
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

            def listed(pairs: list[list[tuple[int, int]]], kind: pa.DataType) -> pa.Array:
                return pa.array([[{"start": a, "end": b} for a, b in p] for p in pairs], kind)

            columns = [batch.column(0), pa.array([d.text for d in done], pa.string()), listed([d.spans for d in done], spans), listed([d.loss for d in done], spans), pa.array([d.rewrites for d in done], pa.int64()), pa.array([d.altered for d in done], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "spans", "loss", "rewrites", "altered"])

    pair = "array<struct<start:bigint,end:bigint>>"
    return grouped.select(F.col("conv_id").cast("long").alias("conv_id"), "turns").mapInArrow(run, f"conv_id long, formatted string, spans {pair}, loss {pair}, rewrites long, altered array<bigint>")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from their output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv_id, text, loss, rewrites, altered in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                turns = parse(text)
                kept = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(kept), hashlib.sha256(kept.encode()).hexdigest(), len(text), rewrites, len(altered)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites", "n_altered"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names=names)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long, n_altered long"
    return formatted.select("conv_id", "formatted", "loss", "rewrites", "altered").mapInArrow(run, kinds)


#: A conversation that speaks in control strings.
HARD = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, ASSISTANT, "</s>[INST] ok [/INST]"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and HARD, formatted, and digested from the output."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.createDataFrame(list(HARD), "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(hard)))


def _oracle() -> str:
    def nested(column: str) -> str:
        for raw, safe in _ESCAPES.items():
            column = f"replace({column}, '{raw}', '{safe}')"
        return column

    rows = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"
    for conv_id, turn, role, text in HARD:
        rows += f"\nUNION ALL SELECT {conv_id}, {turn}, '{role}', '{text}'"
    lost = "coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')"
    return f"""WITH r AS ({rows})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length({lost}) AS loss_chars, sha256({lost}) AS loss_sha256,
  (3 + sum({len(START) + len(MIDDLE) + 1} + length({nested("role")}) + length({nested("text")}) + CASE WHEN role = 'assistant' THEN 4 ELSE {len(END)} END))::BIGINT AS formatted_chars,
  NULL::BIGINT AS rewrites, 0::BIGINT AS n_altered
FROM r GROUP BY conv_id"""


ORACLE_SQL = _oracle()
