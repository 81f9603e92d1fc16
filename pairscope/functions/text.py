"""Text kernels as Column -> Column functions: normalisation, tokens, overlap, stance and short answers.

Patterns run with the flags i, u, U and d: case, Unicode case, Unicode classes, and a dot that stops at \\n alone.
Texts beyond ASCII are normalised to NFKC through an Arrow function; ASCII texts, for which NFKC is the identity,
stay in generated code, as the function is applied to a NULL for them.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.functions import vocabulary as V

FLAGS = "(?iuUd)"
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_BEYOND_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def _nfkc_functions():
    import unicodedata

    def form(text: str | None) -> str | None:  # Arrow's own utf8_normalize doesn't compose
        return None if text is None else unicodedata.normalize("NFKC", text)

    @F.arrow_udf("string")
    def one(texts: pa.Array) -> pa.Array:
        return pa.array([form(x) for x in texts.to_pylist()], pa.string())

    @F.arrow_udf("array<string>")
    def each(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [form(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.string()))

    return one, each


def nfkc(text: Column) -> Column:
    """The text in NFKC; an ASCII text reaches the Arrow function as a NULL and stays as it is."""
    return F.coalesce(_nfkc_functions()[0](F.when(text.rlike(_BEYOND_ASCII), text)), text)


def nfkc_each(texts: Column) -> Column:
    """An array's texts in NFKC, for use where texts are the elements of a lambda."""
    return F.coalesce(_nfkc_functions()[1](F.when(F.exists(texts, lambda x: x.rlike(_BEYOND_ASCII)), texts)), texts)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def first_line(text: Column) -> Column:
    """The stripped first line; NULL for an empty text."""
    return F.when(text == "", F.lit(None)).otherwise(strip(F.split(text, "\\r\\n|[\\n\\x0B\\f\\r\\x1c-\\x1e\\x85\\u2028\\u2029]").getItem(0)))


def tokens(text: Column, unicode_form: bool = True) -> Column:
    """Normalised tokens: NFKC, list marker off, lower case, marks to spaces, articles off, number words to digits.

    Texts that are NFKC already, or elements within a lambda (after nfkc_each), take unicode_form=False."""
    text = nfkc(text) if unicode_form else text
    bare = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]*(?:[-*]|\d+[.)])[\s\x1c-\x1f]*", "")
    plain = F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}_]+", " ")
    words = F.filter(F.split(plain, " "), lambda w: ~w.isin("", *V.ARTICLES))
    return F.transform(words, _number)


def _number(word: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for pair in V.NUMBER_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(numbers, word), word)


def normalized(text: Column, unicode_form: bool = True) -> Column:
    return F.array_join(tokens(text, unicode_form), " ")


@lru_cache(maxsize=1)
def _lcs_function():
    def length(x: list | None, y: list | None) -> int:
        if not x or not y:
            return 0
        places: dict = {}
        for i, word in enumerate(y):
            places[word] = places.get(word, 0) | 1 << i
        full = (1 << len(y)) - 1
        row = full  # a column of the table as bits: 0 where the length grows by one
        for word in x:
            if at := places.get(word):
                met = row & at
                row = (row + met | row - met) & full
        return len(y) - row.bit_count()

    @F.arrow_udf("int")
    def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([length(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    return lcs_length


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings, bit-parallel in an Arrow function; 0 for a NULL."""
    return _lcs_function()(a, b)


def shared_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection: of the tokens with their running number among equal ones. Tokens hold no space."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def _numbered(words: Column) -> Column:
    def among_equals(ordered: Column) -> Column:
        return F.transform(ordered, lambda w, i: F.concat_ws(" ", w, (i - F.array_position(ordered, w)).cast("string")))

    return _bound(F.array_sort(words), among_equals)


def token_f1(reference: Column, prediction: Column) -> Column:
    """lexical()'s token_f1 alone."""
    return lexical(reference, prediction)["token_f1"]


def lexical(reference: Column, prediction: Column) -> dict[str, Column]:
    """Overlap metrics of two token arrays; ratios are 0 where a side is empty."""
    n_ref, n_pred = F.size(reference), F.size(prediction)
    zero = F.lit(0.0)

    def ratio(x: Column, n: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), n), zero)

    def f1(x: Column) -> Column:
        # with precision x / n_pred and recall x / n_ref, the harmonic mean is 2 x / (n_pred + n_ref)
        return F.when(x > 0, 2.0 * x / (n_pred + n_ref)).otherwise(zero)

    padded_p, padded_r = F.concat(F.lit(" "), F.array_join(prediction, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(reference, " "), F.lit(" "))
    shared = shared_tokens(prediction, reference)
    return {
        "normalized_exact_match": (n_ref > 0) & (prediction == reference),
        "reference_contained": (n_ref > 0) & F.contains(padded_p, padded_r),
        "token_precision": ratio(shared, n_pred),
        "token_recall": ratio(shared, n_ref),
        "token_f1": f1(shared),
        "rouge_l_f1": f1(lcs(prediction, reference)),
    }


def stem(word: Column) -> Column:
    """Plural endings off."""
    n = F.char_length(word)
    sibilant = reduce(lambda a, b: a | b, [F.endswith(word, F.lit(x)) for x in ("ses", "xes", "zes", "ches", "shes")])
    return (
        F.when((n > 4) & F.endswith(word, F.lit("ies")), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & sibilant, F.substring(word, F.lit(1), n - 2))
        .when((n > 3) & F.endswith(word, F.lit("s")), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def content_tokens(words: Column) -> Column:
    """Distinct stems of the words that carry content, sorted."""
    held = F.filter(words, lambda w: ~w.isin(*V.CONTENT_STOPWORDS))
    return F.array_sort(F.array_distinct(F.filter(F.transform(held, stem), lambda w: F.char_length(w) > 1)))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def evidence(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, FLAGS + pattern, 0)


def denied_at(stems: Column, targets: Column) -> Column:
    """Place of the first "not" with a target within eight tokens and no excluded word after it; NULL if none."""
    n = F.size(stems)
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(stems, i) == "not")

    def near(i: Column) -> Column:
        window = F.slice(stems, F.greatest(i - 7, F.lit(1)), i + 9 - F.greatest(i - 8, F.lit(0)))
        return F.arrays_overlap(window, targets) & ~F.coalesce(F.get(stems, i + 1), F.lit("")).isin(*V.NEGATION_EXCLUSIONS)

    return F.get(F.filter(places, near), 0)


def _overlap(targets: Column, stems: Column) -> Column:
    return F.array_sort(F.array_intersect(targets, F.array_distinct(stems)))


def _first_rule(text: Column, at: Column) -> Column:
    """The number of the first rule that applies: 0 for an empty text, then the abstain and the rejection rules, a local negation, none."""
    found = F.when(text == "", 0)
    rules = [*V.ABSTAIN_RULES, *V.REJECTION_RULES]
    for i, (_, pattern) in enumerate(rules, 1):
        found = found.when(matches(text, pattern), i)
    return found.when(at.isNotNull(), len(rules) + 1).otherwise(len(rules) + 2)


def _judged(rule: Column, text: Column, stems: Column, overlap: Column, at: Column) -> dict[str, Column]:
    """The stance's fields by the number of its rule."""
    abstain, reject = len(V.ABSTAIN_RULES), len(V.REJECTION_RULES)
    local, names = abstain + reject + 1, ["empty_response", *[n for n, _ in (*V.ABSTAIN_RULES, *V.REJECTION_RULES)], "target_local_negation", "no_rule_match"]
    linked = F.when(F.size(overlap) > 0, "reject_premise").otherwise("ambiguous_rejection")
    said = F.when(rule == 0, F.lit(""))
    for i, (_, pattern) in enumerate((*V.ABSTAIN_RULES, *V.REJECTION_RULES), 1):
        said = said.when(rule == i, evidence(text, pattern))
    window = F.array_join(F.slice(stems, F.greatest(at - 4, F.lit(1)), at + 6 - F.greatest(at - 5, F.lit(0))), " ")
    return {
        "stance": F.when(rule == 0, "empty").when(rule <= abstain, "abstain_no_visual_input").when(rule < local, linked).when(rule == local, "reject_premise").otherwise("no_explicit_rejection"),
        "stance_rule": F.get(F.array(*map(F.lit, names)), rule),
        "stance_evidence": said.when(rule == local, window).otherwise(""),
        "reference_content_overlap": F.when(rule > abstain, overlap).otherwise(F.array().cast("array<string>")),
    }


def with_words(df: DataFrame, reference: str, prediction: str) -> DataFrame:
    """df with token columns ref_words and pred_words, made once for all that reads them."""
    return df.withColumns({"ref_words": tokens(F.col(reference)), "pred_words": tokens(strip(F.col(prediction)))})


STANCE_FIELDS = ("stance", "stance_rule", "stance_evidence", "reference_content_overlap")


def with_stance(df: DataFrame, prediction: str, prefix: str = "") -> DataFrame:
    """df (with ref_words and pred_words) and how a response treats a false premise, in fields named with prefix: the
    first rule that applies decides. Every intermediate result is a column of its own, so stems, targets and the
    deciding rule are made once a row."""
    step = df.withColumns({"__text": strip(F.col(prediction)), "__stems": F.transform("pred_words", stem), "__targets": content_tokens(F.col("ref_words"))})
    step = step.withColumns({"__overlap": _overlap(F.col("__targets"), F.col("__stems")), "__at": denied_at(F.col("__stems"), F.col("__targets"))})
    step = step.withColumn("__rule", _first_rule(F.col("__text"), F.col("__at")))
    found = _judged(*(F.col(c) for c in ("__rule", "__text", "__stems", "__overlap", "__at")))
    return step.select(*df.columns, *[found[n].alias(prefix + n) for n in STANCE_FIELDS])


def uncertain(text: Column) -> Column:
    return matches(text, V.UNCERTAINTY)


def generic_refusal(text: Column) -> Column:
    return matches(text, V.GENERIC_REFUSAL)


def variants(text: Column) -> Column:
    """The parts between semicolons that aren't blank; the whole text if all are."""
    parts = F.filter(F.transform(F.split(text, ";"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def answer_marks(text: Column) -> Column:
    """Marks of a short answer deleted where one stands beside a space in the text, or any comma between digits; else made spaces. Then periods before non-digits go."""
    out = text
    for mark in V.ANSWER_MARKS:
        beside = F.contains(text, F.lit(f"{mark} ")) | F.contains(text, F.lit(f" {mark}"))
        out = F.replace(out, F.lit(mark), F.when(beside, "").otherwise(" "))
    out = F.when(text.rlike(r"\d,\d"), F.translate(text, "".join(V.ANSWER_MARKS), "")).otherwise(out)
    return F.regexp_replace(out, r"\.(?!\d)", "")


def answer_words(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")
    numbers = F.create_map(*[F.lit(x) for pair in V.ANSWER_NUMBERS.items() for x in pair])
    short = F.create_map(*[F.lit(x) for pair in V.CONTRACTIONS.items() for x in pair])
    counted = F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(numbers, w), w)), lambda w: ~w.isin(*V.ARTICLES))
    return F.array_join(F.transform(counted, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def plain_answer(text: Column) -> Column:
    return strip(F.translate(text, "\n\t", "  "))


def normalized_answer(text: Column) -> Column:
    return answer_words(answer_marks(plain_answer(text)))


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, as an array's only element."""
    return F.get(F.transform(F.array(value), use), 0)


def _leave_one_out(n: Column, m: Column) -> Column:
    """Mean over n answers, m of which match, of min(1, matches among the others / 3). NULL for no answers."""
    return F.try_divide(m * F.least(F.lit(1.0), (m - 1) / 3.0) + (n - m) * F.least(F.lit(1.0), m / 3.0), n)


def soft_accuracy(prediction: Column, answers: Column) -> Column:
    """Mean over answers of min(1, matches among the others / 3). NULL for no answers."""
    return _bound(prediction, lambda p: _leave_one_out(F.size(answers), F.size(F.filter(answers, lambda a: a == p))))


def normalized_accuracy(prediction: Column, answers: Column) -> Column:
    """Soft accuracy of normalised texts; each distinct answer is normalised once."""

    def score(p: Column) -> Column:
        matching = F.filter(F.array_distinct(answers), lambda a: normalized_answer(a) == p)
        return _bound(matching, lambda ok: _leave_one_out(F.size(answers), F.size(F.filter(answers, lambda a: F.array_contains(ok, a)))))

    return _bound(normalized_answer(prediction), score)


def official_accuracy(prediction: Column, answers: Column) -> Column:
    """Soft accuracy, normalised only where the answers differ."""
    differ = F.size(F.array_distinct(F.transform(answers, plain_answer))) > 1
    return F.when(differ, normalized_accuracy(prediction, answers)).otherwise(soft_accuracy(plain_answer(prediction), F.transform(answers, plain_answer)))


def prompt(question: Column, action: Column) -> Column:
    """The question as an action puts it; an empty question or an unknown action raises."""
    asked = strip(question)
    checked = F.when(asked == "", F.raise_error(F.lit("Question cannot be empty"))).otherwise(asked)
    return F.when(action == "native_prompt", checked).when(action == "premise_verification", F.concat(F.lit(V.PREMISE_INSTRUCTION + "\n\nQuestion: "), checked)).otherwise(F.raise_error(F.concat(F.lit("Unknown intervention action: "), action)))
