"""Token ids in sorted-string-table shards.

Defined results: a null text counts as empty and holds the end id alone; a null doc_id sorts first; rows of
equal doc_id follow in the order of a hash of their text, and repeated rows are all kept; an empty table
writes no shard and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairscope.llm import common, sstable
from pairscope.llm.common import saved, scratch, table

END_ID = 2
#: Distinct words whose ids a worker remembers at most, in each of two generations.
MEMORY_WORDS = 300_000
#: Where the tokenizer and str.split() may see other words than white space bounds.
_UNUSUAL = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Kinds of Latin-1 characters: space, letter, mark (a run is one piece), digit (each is one piece), or none of these.
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KINDS = np.full(256, _OTHER, dtype=np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_MARKS = "".join(chr(x) for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27)
_KINDS[list(map(ord, _MARKS))] = _MARK
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[0x20] = _SPACE
#: What a word's core may end in, so that marks after it are a piece of their own.
_CORE_ENDS = frozenset(chr(x) for x in range(256) if _KINDS[x] in (_LETTER, _DIGIT))
_WORD_END = "</w>"


class WordEncoder:
    """The tokenizers library behind a memory of words.

    The vocabulary's rules (NFC, lower case, white space dropped, pieces within words) never join what white
    space parts, so a text's ids are its words' ids in a row. New words of Latin-1 go to the library many at a
    time; every piece ends in a token with the vocabulary's word end, and the pieces of a word can be counted, so
    the ids can be dealt out again. Texts with separators that only str.split() knows, or with marks of special
    tokens, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None  # for words that it would leave as they are
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(_WORD_END)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        new = []
        for w in words:
            if (ids := self.older.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = ids
        other = []
        for i in range(0, len(new), 100):
            run = new[i : i + 100]
            try:
                kinds = _KINDS[np.frombuffer((" ".join(run) + " ").encode("latin-1"), dtype=np.uint8)]
            except UnicodeEncodeError:
                kinds = np.array([_OTHER])
            if (kinds == _OTHER).any():
                plain = [w for w in run if max(w) <= "\xff" and not (_KINDS[np.frombuffer(w.encode("latin-1"), dtype=np.uint8)] == _OTHER).any()]
                kept = set(plain)
                other += [w for w in run if w not in kept]
                run = plain
                kinds = _KINDS[np.frombuffer("".join(w + " " for w in run).encode("latin-1"), dtype=np.uint8)]
            if not run:
                continue
            starts = (kinds != _SPACE) & ((kinds == _DIGIT) | (kinds != np.append(_SPACE, kinds[:-1])))
            pieces = np.cumsum(starts)[kinds == _SPACE]
            joined = " ".join(run)
            own = self.plain if joined == joined.lower() else self.tokenizer
            ids = np.array(own.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != pieces[-1]:
                other += run
                continue
            raw, cuts = ids.tobytes(), [0, *(ends[pieces - 1] * self.dtype.itemsize).tolist()]
            self.known.update(zip(run, [raw[a:b] for a, b in pairwise(cuts)], strict=True))
        if other:
            self.known.update(zip(other, self._direct(other), strict=True))

    def _missing(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that aren't known. What is remembered are words without marks at their end, and those marks."""
        known, cores, need = self.known, {}, set()
        for w in words:
            core = w.rstrip(_MARKS)
            if core and len(core) < len(w) and core[-1] in _CORE_ENDS:
                cores[w] = core
                if core not in known:
                    need.add(core)
                if (tail := w[len(core) :]) not in known:
                    need.add(tail)
            else:
                need.add(w)
        self._learn(list(need))
        return {w: known[core] + known[w[len(core) :]] for w, core in cores.items()}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids, little-endian, of dtype's width."""
        for text in texts:
            if any(x in text for x in _UNUSUAL):
                yield self._direct([text])[0]
                continue
            if len(self.known) > MEMORY_WORDS:
                self.known, self.older = {}, self.known
            try:
                text.encode("latin-1")  # here lower case is a matter of single characters, as in the library
                parts = text.lower().split()
            except UnicodeEncodeError:
                parts = text.split()
            known = self.known
            found = list(map(known.get, parts))
            if holes := [i for i, ids in enumerate(found) if ids is None]:
                extra = self._missing({parts[i] for i in holes})
                for i in holes:
                    found[i] = extra[w] if (w := parts[i]) in extra else known[w]
            yield b"".join(found)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so tasks share its memory of words."""
    return WordEncoder(path)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encodes docs (doc_id, text) and writes shards in ascending doc_id order; returns their manifest."""
    from pyspark.sql import types as T

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.working("token_output", word_encoder.cache_clear)
        encoder, writer, first, shard = word_encoder(tokenizer_path), None, None, TaskContext.get().partitionId()
        end, width = np.array([end_id], dtype=encoder.dtype).tobytes(), encoder.dtype.itemsize
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc_id, tokens in zip(ids, encoder.encode(texts), strict=True):
                if writer is None:
                    writer, first = sstable.Writer(folder, f"shard-{shard:06d}"), doc_id
                writer.add(doc_id, tokens + end, width)
        if writer is not None:
            path = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "first_key": [sstable.key_bytes(first)], "n_docs": [len(writer.keys)], "n_tokens": [writer.tokens]})

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("path", T.StringType()), T.StructField("first_key", T.BinaryType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return common.small_batches(ordered).mapInArrow(write, schema)


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, read back from the shards: doc_id, start, n_tokens, ids_crc32. manifest: one row per shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = sstable.Reader(folder, path)
                rows: list[tuple] = []
                for doc_id, ids in reader.scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield _digest(rows)
                        rows = []
                reader.close()
                if rows:
                    yield _digest(rows)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "start", "shard").repartition(parts, "shard").select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=list(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes the shards to the shared folder and reads every document back."""
    import public_tokenizers

    folder = scratch(spark, "shards")
    manifest, _ = saved(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder), "manifest")
    return read_shards(manifest, folder)
