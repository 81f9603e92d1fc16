"""SentencePiece encoding and decoding as weighted finite-state transduction.

Machines are compiled from a model file, composed with each input lazily, and the shortest path in the tropical
semiring is the encoding:

* ``Normaliser``: from a text to marked text. Its arcs are the rules of the model's character map (longest match first)
  and the identity on other characters; its states tell whether a space has just been written, for models that drop
  extra spaces. Spaces become marks, and a mark is put in front.
* ``Lexicon``: from characters to pieces. States are the prefixes of pieces; the weight stands on the last arc.
* ``Fallback``: from a character that is no piece to its UTF-8 bytes' ids, or to the unknown id.
* ``Merges`` (BPE only): an acceptor of piece sequences. A BPE model prescribes an order of merges. That is a weight on
  neighbouring pieces: zero if the pair stands, that is if merging the pair's characters on their own gives the same
  two pieces, infinite otherwise. Merges across the pieces' bounds in a text would also happen in one of its pairs on
  its own, and the other way round, so just one path is finite, and it is the library's result. Pairs are judged once
  and remembered. A unigram model has no such machine: a piece weighs its negative score. Of its paths of equal weight
  (the same pieces in another order) the library takes the one that rounding to 32 bits prefers, this module the one
  whose last tokens start first.

Where no piece goes on over a white space mark, paths of the parts between marks are found apart and remembered; so
are those of parts between two characters that follow each other in no piece.

Defined results: a null or empty text has no ids; repeated rows and null ids are encoded like others; an empty table
gives no rows; a text of any length is encoded whole, part by part, and what a worker remembers is bounded, by number,
and dropped when it turns to another operator's tasks. Decoding gives the text back under the identity normaliser, save that U+2581 comes back
as a space, as in the library; ids beside the vocabulary raise an error. Other columns pass through; columns named as
the added ones are replaced. Models with user-defined or unused pieces, or with marks behind words, raise an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairscope.llm import common
from pairscope.llm.common import table

MARK = "▁"
#: Parts and pairs that a worker remembers at most, parts in each of two generations, and the longest part it remembers.
MEMORY_PARTS, MEMORY_PAIRS, MEMORY_CHARS = 100_000, 250_000, 64
_ENDS = "".join(chr(x) for x in range(0x21, 0x7F) if not chr(x).isalnum())
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: In paths, a character of the fallback is this less its code point.
_FALLBACK = -1
#: An unknown character weighs so much more than the worst piece.
_UNKNOWN = 10.0

Arc = tuple[int, int, float]


def shortest_path(length: int, arcs: Callable[[int], list[Arc]], stands: Callable[[int, int], bool] | None, last: Callable[[int], bool]) -> list[int]:
    """The tokens of the path of least weight from 0 to length.

    arcs: of a place, (end, token, weight), weights not negative, short ones first. stands: whether two tokens may follow
    each other (else the weight is infinite), so a state is a place and its last token; None: any may, and a state is a
    place. last: whether a token may be a path of its own.

    Best first. A queue by weight, then by the place reached, then by the token's start; where tokens are weighed by
    stands alone, all finite weights are equal, and a stack is such a queue."""
    done: list[tuple[int, int]] = []
    queue: list[tuple[float, int, int, int, int]] = []
    push, pop = (heapq.heappush, heapq.heappop) if stands is None else (list.append, list.pop)
    for end, token, weight in arcs(0):
        if end < length or last(token):
            push(queue, (weight, -end, 0, token, -1))
    seen = set()
    while queue:
        weight, end, _, token, before = pop(queue)
        if stands is None:
            state = end
        elif before >= 0 and not stands(done[before][0], token):  # judged only when its turn has come
            continue
        else:
            state = (end, token)
        if state in seen:
            continue
        seen.add(state)
        here, end = len(done), -end
        done.append((token, before))
        if end == length:
            out = []
            while here >= 0:
                token, here = done[here]
                out.append(token)
            return out[::-1]
        for stop, following, more in arcs(end):
            push(queue, (weight + more, -stop, end, following, here))
    raise ValueError("no path")


class Normaliser:
    """The transducer from texts to marked texts."""

    def __init__(self, spec):
        if not spec.escape_whitespaces:
            raise ValueError("only models that mark white space are compiled")
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        rules = spec.precompiled_charsmap
        size = int.from_bytes(rules[:4], "little")
        #: the character map: a double array over UTF-8 bytes, whose values are places in a string of results
        self.units = np.frombuffer(rules[4 : 4 + size], dtype="<u4").tolist()
        self.results = rules[4 + size :]
        self.identity = not self.units and not self.trim
        self.starts: dict[str, bool] = {}

    def _rule(self, raw: bytes) -> tuple[int, str] | None:
        """The longest rule at the start of raw: its length in bytes and its result."""
        units, found = self.units, None
        at = units[0] >> 10 << ((units[0] & 0x200) >> 6)
        for n, byte in enumerate(raw, 1):
            at ^= byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                break
            unit = units[at]
            at ^= unit >> 10 << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = n, units[at] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.results.index(b"\0", found[1])
        return found[0], self.results[found[1] : end].decode()

    def arcs(self, text: str) -> Iterator[str]:
        """What the arcs along text write, in order."""
        at = 0
        while at < len(text):
            first = text[at]
            if (begins := self.starts.get(first)) is None:  # whether any rule begins with this character
                raw = first.encode("utf-8", "replace")
                begins = self.starts[first] = bool(self.units) and self._begins(raw)
            found = self._rule(text[at : at + 16].encode("utf-8", "replace")) if begins else None
            if found is None:
                yield first
                at += 1
            else:
                yield found[1]
                at += len(text[at : at + 16].encode("utf-8", "replace")[: found[0]].decode("utf-8", "ignore"))

    def _begins(self, raw: bytes) -> bool:
        at = self.units[0] >> 10 << ((self.units[0] & 0x200) >> 6)
        for byte in raw:
            at ^= byte
            if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
                return False
            at ^= self.units[at] >> 10 << ((self.units[at] & 0x200) >> 6)
        return True

    def output(self, text: str) -> str:
        """The marked text."""
        if not text:
            return ""
        if self.identity:
            return (MARK if self.prefix else "") + text.replace(" ", MARK)
        out: list[str] = []
        space = self.trim  # the state: after a space, or at the start, where spaces are dropped
        for written in self.arcs(text):
            if space:
                written = written.lstrip(" ")
            if written:
                out.append(written)
                space = self.trim and written[-1] == " "
        whole = "".join(out).replace(" ", MARK)
        if self.trim:
            whole = whole.rstrip(MARK)
        return (MARK if self.prefix else "") + whole if whole or not self.trim else ""


class Lexicon:
    """The transducer from characters to pieces."""

    def __init__(self, scores: dict[str, tuple[int, float]], bpe: bool):
        most = max([0.0, *(s for _, s in scores.values())])
        #: weights of unigram pieces are shifted by a constant a character, which no choice of a path depends on
        self.shift = 0.0 if bpe else most
        self.worst = min((s for _, s in scores.values()), default=0.0) - _UNKNOWN
        self.bpe = bpe
        #: a state: its arcs by character, and the piece that ends there with its weight
        self.start: list = [{}, None]
        for piece, (token, score) in scores.items():
            state = self.start
            for c in piece:
                state = state[0].setdefault(c, [{}, None])
            state[1] = (token, 0.0 if bpe else self.shift * len(piece) - score)

    def arcs(self, text: str, at: int) -> list[Arc]:
        """(end, token, weight) of the pieces that start here, composed with the fallback where no piece is the character."""
        out, end = [], at
        state = self.start[0].get(text[at])
        if state is None or state[1] is None:
            out.append((at + 1, _FALLBACK - ord(text[at]), 0.0 if self.bpe else self.shift - self.worst))
        while state is not None:
            following, last = state
            end += 1
            if last is not None:
                out.append((end, last[0], last[1]))
            if end == len(text):
                break
            state = following.get(text[end])
        return out


class Fallback:
    """The transducer from characters beside the lexicon to bytes' ids, or to the unknown id."""

    def __init__(self, byte_ids: dict[int, int], unknown: int):
        self.byte_ids, self.unknown = byte_ids, unknown
        self.bytes = {i: b for b, i in byte_ids.items()}

    def output(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]


class Merges:
    """The acceptor of the piece sequences that merging gives."""

    def __init__(self, scores: dict[str, tuple[int, float]], text: Callable[[int], str]):
        self.scores, self.text = scores, text
        self.joined = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}

    def stands(self, left: int, right: int) -> bool:
        pair = (left << 22) + right  # tokens and code points have 21 bits
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) > MEMORY_PAIRS:
                self.pairs.clear()
            found = self.pairs[pair] = self.merged(self.text(left), self.text(right))
        return found

    def merged(self, left: str, right: str) -> bool:
        """Whether merging by score, leftmost first, ends in just left and right."""
        if right and left[-1] + right[0] not in self.joined:  # nothing merges over the bound
            return self.merged(left, "") and self.merged(right, "")
        parts: list[str | None] = list(left + right)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(parts) and (found := self.scores.get(text := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-found[1], i, text))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, text = heapq.heappop(queue)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[i] + parts[j] != text:
                continue
            if i < len(left) < i + len(text):
                return False
            parts[i], parts[j], after[i] = text, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None] == [p for p in (left, right) if p]


class Pieces:
    """The machines of a model file, and their composition with texts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.treat_whitespace_as_suffix or kinds & {4, 5} or model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with marks before words and without user-defined or unused pieces are compiled")
        self.names = [p.piece for p in model.pieces]
        #: what a piece reads as: control pieces as nothing
        self.shown = ["" if p.type == 3 else " \u2047 " if p.type == 2 else p.piece for p in model.pieces]
        #: pieces that read as their characters, and the ids of the others
        self.plain = {i: p.piece.replace(MARK, " ") for i, p in enumerate(model.pieces) if p.type == 1}
        self.odd = {i for i, p in enumerate(model.pieces) if p.type != 1}
        scores = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        self.bpe = model.trainer_spec.model_type == 2
        self.normaliser, self.lexicon = Normaliser(model.normalizer_spec), Lexicon(scores, self.bpe)
        byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.fallback = Fallback(byte_ids, next((i for i, p in enumerate(model.pieces) if p.type == 2), 0))
        self.merges = Merges(scores, self._text)
        self.joined = self.merges.joined
        #: whether no piece goes on over a mark
        self.parted = all(MARK not in p.lstrip(MARK) for p in scores)
        #: what is remembered of texts
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _text(self, token: int) -> str:
        return self.names[token] if token >= 0 else chr(_FALLBACK - token)

    def path(self, text: str) -> list[int]:
        """The ids of normalised text."""
        arcs = self.lexicon.arcs
        stands = self.merges.stands if self.bpe else None
        tokens = shortest_path(len(text), lambda at: arcs(text, at), stands, lambda t: not self.bpe or t < 0 or self.merges.merged(self._text(t), ""))
        out: list[int] = []
        for i in tokens:
            if i >= 0:
                out.append(i)
            else:
                out += self.fallback.output(chr(_FALLBACK - i))
        return out

    def _part(self, part: str) -> bytes:
        """The ids of a part between spaces; one that starts with a line end has no white space mark."""
        known = self.older.get(part)
        if known is None:
            core = part.rstrip(_ENDS)
            if core and len(core) < len(part) and core != "\n" and core[-1] + part[len(core)] not in self.joined:
                head = self.known.get(core)
                return (self._part(core) if head is None else head) + self._tail(part[len(core) :])
            known = _packed(self.path(part if part[:1] == "\n" else MARK + part))
        if len(part) <= MEMORY_CHARS:
            if len(self.known) > MEMORY_PARTS:
                self.known, self.older = {}, self.known
            self.known[part] = known
        return known

    def _tail(self, marks: str) -> bytes:
        """The ids of marks that end a part."""
        known = self.tails.get(marks)
        if known is None:
            if len(self.tails) > MEMORY_PARTS // 10:
                self.tails.clear()
            known = _packed(self.path(marks))
            if len(marks) <= MEMORY_CHARS:
                self.tails[marks] = known
        return known

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        normaliser = self.normaliser
        if not normaliser.identity or not self.parted or not normaliser.prefix or text[0] == " " or text[-1] == " " or "  " in text or MARK in text or " \n" in text:
            whole = normaliser.output(text)
            ids = [i for run in (_RUNS.findall(whole) if self.parted else [whole] if whole else []) for i in self.path(run)]
            return _packed(self._unknown_once(ids))
        if text[0] == "\n":
            text = "\0" + text[1:]  # kept apart: only here the mark stands before a line end
            parts = text.replace("\n", " \n").split(" ")
            out = _packed(self.path(MARK + "\n" + parts[0][1:])) + self._joined(parts[1:])
        else:
            out = self._joined(text.replace("\n", " \n").split(" "))
        return out if self.fallback.byte_ids else _packed(self._unknown_once(np.frombuffer(out, dtype="<i4").tolist()))

    def _joined(self, parts: list[str]) -> bytes:
        out = []
        for p in parts:
            found = self.known.get(p)
            out.append(self._part(p) if found is None else found)
        return b"".join(out)

    def _unknown_once(self, ids: list[int]) -> list[int]:
        """Without bytes, neighbouring unknown characters are one unknown id."""
        if self.fallback.byte_ids:
            return ids
        return [i for n, i in enumerate(ids) if not n or i != self.fallback.unknown or ids[n - 1] != i]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes put together, marks as spaces, without the mark put in front."""
        ids = list(ids)
        if not self.normaliser.trim and self.odd.isdisjoint(ids):
            try:
                text = "".join(map(self.plain.__getitem__, ids))
            except KeyError as e:
                raise IndexError(f"no piece {e}") from None
            return text[1:] if self.normaliser.prefix and text[:1] == " " else text
        out, raw, front = [], bytearray(), self.normaliser.prefix or self.normaliser.trim
        for i in ids:
            if (b := self.fallback.bytes.get(i)) is not None:
                raw.append(b)
                front = False
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i < 0:
                raise IndexError(f"no piece {i}")
            piece = self.shown[i]
            if front and piece[:1] == MARK:
                piece, front = piece[1:], self.normaliser.trim
            front = front and not piece
            out.append(piece.replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One set of machines per worker process, so its tasks share what they remember."""
    return Pieces(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with ids (array<int>), n_ids and round_trip (whether decoding the ids gives the text back); a clashing column of docs is replaced."""
    added = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    names = [c for c in docs.columns if c not in added.names]
    at = names.index("text")
    own = common.small_batches(docs.select(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.working("sentence_pieces", pieces.cache_clear)
        machine = pieces(model_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [x.as_py() or "" for x in part.column(at)]
                found = [machine.encode(t) for t in texts]
                ids = [np.frombuffer(f, dtype="<i4") for f in found]
                same = [machine.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())], names=[*names, *added.names])

    return own.mapInArrow(run, T.StructType(own.schema.fields + added.fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip."""
    import public_tokenizers

    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [hashlib.sha256(x.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()).hexdigest() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sums, pa.string()), batch.column(3)], names=["doc_id", "n_ids", "ids_sha256", "round_trip"])

    return found.select("doc_id", "ids", "n_ids", "round_trip").mapInArrow(digest, "doc_id long, n_ids long, ids_sha256 string, round_trip boolean")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
