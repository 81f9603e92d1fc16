"""Language identification by a linear-chain conditional random field over words.

A word's features are its byte trigrams with a mark at its end, its affixes (first two bytes with a mark, first
and last four bytes) and its entry in a lexicon of the training words. The field's transitions are learned with
them: as documents come with one language each, training sequences splice runs of words from documents of
different languages, as in code-switched text. Forward-backward gives every word's marginal probabilities;
a document's score for a language is the mean of its words' marginals.

The field learns every language of the labels. It is fitted on a bounded, documented sample (PER_LANG documents a
language, chosen by a hash of doc_id; of a longer text a run of words of at most MOST_CHARS characters, from a
place chosen by that hash). All documents are labelled, whole, in sequences of up to STEPS words, and so many words
at a time that memory is bounded for texts and words of any length.

Defined results: a text that is null or has no letter is ``und`` with score 0; without training rows every text
is; ties go to the language that sorts first; repeated rows and null ids are labelled like others (a null id is
never held out and never trained on); an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm import common
from pairscope.llm.common import splitmix, table

#: Bounds of the training sample: documents a language, and characters of each.
PER_LANG, MOST_CHARS = 800, 20_000
#: Words of a sequence.
STEPS = 32
#: Words and bytes that are labelled at a time, and bytes of a word beyond which its grams are summed in pieces.
WORDS_AT_ONCE, BYTES_AT_ONCE, LONG_WORD = 1 << 13, 1 << 17, 1 << 14
#: Documents that a worker takes and gives at a time.
ROWS_AT_ONCE = 512
GRAM_BITS, LEXICON_BITS = 15, 16
SEQUENCES, BATCH, EPOCHS, RATE, DECAY = 6_000, 200, 4, 0.3, 1e-6
UNKNOWN = "und"


@dataclass
class Field:
    """A fitted field: languages, weights of byte grams and of the lexicon's slots, the slots' words, transitions."""

    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    slots: np.ndarray
    steps: np.ndarray


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram indices ordered by word, the first of each word, and each word's slot in the lexicon (or the spare one)."""
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes + 3)])[:-1]
    total = int((sizes + 3).sum())
    word = np.repeat(np.arange(len(starts)), sizes + 3)
    place = np.arange(total) - first[word]
    padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)]).astype(np.uint64)

    def byte(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.where((at >= low) & (at < high), padded[np.clip(at, 0, len(padded) - 1)], np.uint64(0))

    at, low, high = starts[word] + place, starts[word], ends[word]
    inside = place < sizes[word]
    own = padded[np.minimum(at, len(padded) - 1)] | byte(at + 1, low, high) << np.uint64(8) | byte(at + 2, low, high) << np.uint64(16)
    head = sum((byte(starts + i, starts, ends) << np.uint64(8 * i) for i in range(4)), np.zeros(len(starts), dtype=np.uint64))
    tail = sum((byte(ends - 1 - i, starts, ends) << np.uint64(8 * i) for i in range(4)), np.zeros(len(starts), dtype=np.uint64))
    keys = np.where(inside, own, np.uint64(0))
    for extra, values in enumerate((head & np.uint64(0xFFFF), head, tail)):
        keys[first + sizes + extra] = values | np.uint64((extra + 1) << 32)
    index = _gram(keys)
    slot = (hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
    return index, first, np.where(slots[slot] == hashes, slot, len(slots))


def _gram(keys: np.ndarray) -> np.ndarray:
    return (splitmix(keys + np.uint64(1)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _emissions(grams: np.ndarray, lexicon: np.ndarray, index: np.ndarray, first: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return np.add.reduceat(grams[index], first, axis=0) + lexicon[slot]


def _marginals(scores: np.ndarray, held: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward. scores: (sequences, STEPS, languages); held: which steps are words. Marginals of words and, summed, of transitions."""
    n, length, k = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(steps - steps.max())
    ahead = np.empty_like(emit)
    at = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    ahead[:, 0] = at
    for t in range(1, length):
        new = (at @ move) * emit[:, t]
        at = np.where(held[:, t, None], new / new.sum(axis=1, keepdims=True), at)
        ahead[:, t] = at
    back = np.ones((n, k), dtype=emit.dtype)
    pairs = np.zeros((k, k))
    out = np.empty_like(emit)
    out[:, -1] = ahead[:, -1]
    for t in range(length - 2, -1, -1):
        right = emit[:, t + 1] * back
        both = held[:, t + 1]
        mass = ((ahead[:, t] @ move) * right).sum(axis=1)
        pairs += move * (ahead[both, t].T @ (right[both] / mass[both, None]))
        new = right @ move.T
        back = np.where(both[:, None], new / new.sum(axis=1, keepdims=True), back)
        got = ahead[:, t] * back
        out[:, t] = got / got.sum(axis=1, keepdims=True)
    return out, pairs


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per chunk of rows: first row, lower-cased bytes and the words' starts, ends, rows and hashes."""
    data, offsets = common.text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    for first, last in common.chunks(offsets):
        part = data[offsets[first] : offsets[last]]
        starts, ends, rows, hashes = common.words(part, offsets[first : last + 1] - offsets[first], common.NOT_WORD)
        yield first, part, starts, ends, rows, hashes, last - first


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Field | None:
    """Fits a field to documents of one language each."""
    names = sorted(set(langs))
    if not names:
        return None
    rng, k = np.random.default_rng(seed), len(names)
    n_sequences = max(SEQUENCES, SEQUENCES * k // 64)  # many languages get their share of words too
    label = np.array([names.index(x) for x in langs])
    parts = list(_tokens(pa.array(texts, pa.large_string())))
    shift = np.cumsum([0] + [len(p[1]) for p in parts])
    data = np.concatenate([p[1] for p in parts])
    starts, ends = (np.concatenate([p[j] + s for p, s in zip(parts, shift)]) for j in (2, 3))
    rows, hashes = np.concatenate([p[4] + p[0] for p in parts]), np.concatenate([p[5] for p in parts])
    del parts  # as much again
    if not len(starts):
        return None
    slots = np.zeros(1 << LEXICON_BITS, dtype=np.uint64)
    found, often = np.unique(hashes, return_counts=True)
    found = found[often >= 3][np.argsort(often[often >= 3], kind="stable")]
    slots[(found >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)] = found  # the most frequent word of a slot stays
    # sequences of runs of words: runs of one document each, most sequences of one to three languages
    of_lang = [np.flatnonzero(label[rows] == i) for i in range(k)]
    chosen = np.zeros((n_sequences, STEPS), dtype=np.int64)
    truth = np.zeros((n_sequences, STEPS), dtype=np.int64)
    for s in range(n_sequences):
        at = 0
        while at < STEPS:
            run = min(STEPS - at, int(rng.geometric(1 / 20)))
            lang = int(rng.integers(k))
            if not len(of_lang[lang]):
                continue
            begin = of_lang[lang][rng.integers(len(of_lang[lang]))]
            words = np.minimum(begin + np.arange(run), len(rows) - 1)
            words = words[label[rows[words]] == lang]
            chosen[s, at : at + len(words)], truth[s, at : at + len(words)] = words, lang
            at += len(words)
    grams = np.zeros((1 << GRAM_BITS, k))
    lexicon = np.zeros(((1 << LEXICON_BITS) + 1, k))
    steps = np.zeros((k, k))
    past = [np.full_like(x, 1e-6) for x in (grams, lexicon, steps)]
    held = np.ones((BATCH, STEPS), dtype=bool)
    for _ in range(EPOCHS):
        order = rng.permutation(n_sequences)
        for b in range(0, n_sequences - BATCH + 1, BATCH):
            picked = order[b : b + BATCH]
            words, real = chosen[picked].ravel(), truth[picked]
            index, first, slot = _features(data, starts[words], ends[words], hashes[words], slots)
            scores = _emissions(grams, lexicon, index, first, slot).reshape(BATCH, STEPS, k)
            got, pairs = _marginals(scores, held, steps)
            error = (got - np.eye(k)[real]).reshape(-1, k) / BATCH
            slope = [np.zeros_like(grams), np.zeros_like(lexicon), pairs.copy()]
            sizes = np.diff(np.append(first, len(index)))
            for j in range(k):
                slope[0][:, j] = np.bincount(index, weights=np.repeat(error[:, j], sizes), minlength=len(grams))
                slope[1][:, j] = np.bincount(slot, weights=error[:, j], minlength=len(lexicon))
            np.subtract.at(slope[2], (real[:, :-1].ravel(), real[:, 1:].ravel()), 1.0)
            slope[2] /= BATCH
            for weight, seen, g in zip((grams, lexicon, steps), past, slope, strict=True):
                g += DECAY * weight
                seen += g * g
                weight -= RATE * g / np.sqrt(seen)
    lexicon[-1] = 0
    return Field(names, grams.astype(np.float32), lexicon.astype(np.float32), slots, steps.astype(np.float32))


def _scores(field: Field, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per word the sums of its features' weights, by language."""
    long = np.flatnonzero(ends - starts > LONG_WORD)
    index, first, slot = _features(data, starts, np.minimum(ends, starts + LONG_WORD), hashes, field.slots)
    out = _emissions(field.grams, field.lexicon, index, first, slot)
    for i in long:
        out[i] = _long_score(field, data[starts[i] : ends[i]], int(slot[i]))
    return out


def _long_score(field: Field, word: np.ndarray, slot: int) -> np.ndarray:
    """As _scores, of one long word. Its affixes come from a word of its first and last bytes, less that one's grams."""
    total = np.zeros(len(field.langs))
    for at in range(0, len(word), LONG_WORD):
        part = np.concatenate([word[at : at + LONG_WORD + 2], np.zeros(2, dtype=np.uint8)]).astype(np.uint64)
        own = part[:-2] | part[1:-1] << np.uint64(8) | part[2:] << np.uint64(16)
        total += field.grams[_gram(own[: min(LONG_WORD, len(word) - at)])].sum(axis=0)
    index, _, _ = _features(np.concatenate([word[:4], word[-4:]]), np.array([0]), np.array([8]), np.zeros(1, dtype=np.uint64), field.slots)
    return (total + field.grams[index[-3:]].sum(axis=0) + field.lexicon[slot]).astype(field.grams.dtype)


def _labelled(field: Field, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of words, whole sequences each, with their words' probabilities of the languages."""
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    place = (np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))) % STEPS
    heads, at = np.append(np.flatnonzero(place == 0), len(rows)), 0
    while at < len(heads) - 1:
        first = int(heads[at])
        upto = min(first + WORDS_AT_ONCE, int(np.searchsorted(starts, starts[first] + BYTES_AT_ONCE)))
        stop = max(int(np.searchsorted(heads, upto, side="right")) - 1, at + 1)
        last = int(heads[stop])
        low, own = int(starts[first]), slice(first, last)
        scores = _scores(field, part[low : int(ends[last - 1])], starts[own] - low, ends[own] - low, hashes[own])
        sequence = np.cumsum(place[own] == 0) - 1
        padded = np.zeros((sequence[-1] + 1, STEPS, len(field.langs)), dtype=np.float32)
        held = np.zeros(padded.shape[:2], dtype=bool)
        padded[sequence, place[own]] = scores
        held[sequence, place[own]] = True
        found, _ = _marginals(padded, held, field.steps)
        yield first, last, found[sequence, place[own]]
        at = stop


def word_marginals(field: Field, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per word the probabilities of the languages."""
    return np.concatenate([found for _, _, found in _labelled(field, part, starts, ends, rows, hashes)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def passage(text: Column, doc_id: Column) -> Column:
    """text, or of one beyond MOST_CHARS a run of its words, from a place chosen by a hash of doc_id."""
    size = F.char_length(text)
    start = F.pmod(F.xxhash64(doc_id, F.lit("passage")), F.greatest(size - MOST_CHARS + 1, F.lit(1))).cast("int")
    cut = F.substring(text, start + 1, F.lit(MOST_CHARS))
    # words that the cut went through are left out, unless nothing else is there
    inner = F.regexp_replace(F.when(start > 0, F.regexp_replace(cut, r"^\S+", "")).otherwise(cut), r"(?<!\S)\S++$", "")
    return F.when(size <= MOST_CHARS, text).otherwise(F.when(F.trim(inner) == "", cut).otherwise(inner))


def train(docs: DataFrame) -> Field | None:
    """Fits a field on the bounded sample of docs (doc_id, text, lang).

    One task of the executors fits; the driver gets the field alone, as the sample and its words' features take more."""
    common.small_batches(docs)
    rows = docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, PER_LANG / r["count"])) for r in counts], "__lang string, share double")
    found = rows.join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(dice < F.col("share"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = found.select("doc_id", passage(F.col("text"), F.col("doc_id")).alias("text"), "lang").orderBy(*order).limit(2 * PER_LANG * len(counts))
    learn = fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.working("lang_crf")
        texts, langs = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
        field = learn(texts, langs)
        del texts, langs
        common.give_back()  # the worker goes on with other tasks
        if field is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(field)], pa.binary())], names=["field"])

    got = sample.coalesce(1).sortWithinPartitions(*order).select("text", "lang").mapInArrow(run, "field binary").collect()
    return pickle.loads(got[0]["field"]) if got else None


def _judged(field: Field | None, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The best language of each text, and its share of the words' probabilities."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if field is not None:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        for first, part, starts, ends, rows, hashes, n in _tokens(texts):
            if not len(starts):
                continue
            total = np.zeros((n, len(field.langs)))
            for a, b, found in _labelled(field, part, starts, ends, rows, hashes):
                low, high = int(rows[a]), int(rows[b - 1]) + 1
                for j in range(len(field.langs)):
                    total[low:high, j] += np.bincount(rows[a:b] - low, weights=found[:, j], minlength=high - low)
            best = total.argmax(axis=1)
            sums = total.sum(axis=1)
            for i in np.flatnonzero((sums > 0) & letters[first : first + n]):
                langs[first + i], scores[first + i] = field.langs[best[i]], min(1.0, total[i, best[i]] / sums[i])
    return pa.array(langs, pa.string()), pa.array(scores, pa.float64())


def predict(docs: DataFrame, field: Field | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score to docs by their text, under names that docs hasn't."""
    names = [*docs.columns, lang, score]
    at = docs.columns.index("text")
    shared = common.small_batches(docs).sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.working("lang_crf")
        own = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                langs, scores = _judged(own, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, langs, scores], names=names)

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    field = train(docs.select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text"), field)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told, or with a score below MIN_SCORE, are rejected."""
    own = common.free_names(docs.columns, "lang", "score")
    found = predict(docs, train(docs.select("doc_id", "text", "lang")), own["lang"], own["score"])
    return found.where((F.col(own["lang"]) != UNKNOWN) & (F.col(own["score"]) >= MIN_SCORE)).select(*docs.columns)


#: Least mean marginal of the predicted language that the pipeline accepts.
MIN_SCORE = 0.5
