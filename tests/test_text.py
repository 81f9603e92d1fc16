import math

import pytest
from pyspark.sql import functions as F

from pairscope.functions import arrays as A
from pairscope.functions import text as T
from pairscope.operators import review as R


def one(spark, **columns):
    """The values of columns over a single row."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def stance(spark, reference, prediction):
    rows = spark.createDataFrame([(reference, prediction)], "reference string, prediction string")
    return T.with_stance(T.with_words(rows, "reference", "prediction"), "prediction").first()


def test_normalize(spark):
    assert one(spark, x=T.normalized(F.lit("1. The image does not contain two chairs!"))).x == "image does not contain 2 chairs"
    assert one(spark, x=T.normalized(F.lit("don’t ﬁx"))).x == "don t fix"
    assert one(spark, x=T.normalized(F.lit("ﬁve ２ Café"))).x == "5 2 café"
    assert one(spark, x=T.normalized(F.lit(""))).x == ""


def test_lexical(spark):
    row = one(spark, **T.lexical(T.tokens(F.lit("Two red cars.")), T.tokens(F.lit("There are two red cars."))))
    assert not row.normalized_exact_match and row.reference_contained
    assert row.token_precision == pytest.approx(0.6) and row.token_recall == 1.0
    assert row.token_f1 == pytest.approx(0.75) and row.rouge_l_f1 == pytest.approx(0.75)


def test_lexical_of_empty_sides_is_zero(spark):
    row = one(spark, **T.lexical(T.tokens(F.lit("")), T.tokens(F.lit("a dog"))))
    assert tuple(row) == (False, False, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("a, b, n", [("abcbdab", "bdcaba", 4), ("abc", "abc", 3), ("", "a", 0), ("ab", "cd", 0)])
def test_lcs(spark, a, b, n):
    assert one(spark, x=T.lcs(F.split(F.lit(a), "") if a else F.array().cast("array<string>"), F.split(F.lit(b), ""))).x == n


def test_normal_forms_of_a_table(spark):
    """Composed, full-width, ligature and superscript texts beside ASCII ones and nulls, as the standard library has them."""
    import unicodedata

    texts = ["plain text", None, "", "Café au lait", "Ｆｕｌｌ　ｗｉｄｔｈ １２", "ﬁne ﬂow", "x² ½", "ẛ̣", "Ⅷ ㎏", "한글", "é é", "；a；"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", T.nfkc(F.col("t")).alias("x")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    lists = spark.createDataFrame([(0, texts[3:6] + [None]), (1, None), (2, []), (3, ["a", "b"]), (4, texts[6:])], "i int, t array<string>")
    got = {r.i: r.x for r in lists.select("i", T.nfkc_each(F.col("t")).alias("x")).collect()}
    normal = lambda xs: [None if x is None else unicodedata.normalize("NFKC", x) for x in xs]
    assert got == {0: normal(texts[3:6] + [None]), 1: None, 2: [], 3: ["a", "b"], 4: normal(texts[6:])}


def test_lcs_and_shared_tokens_match_brute_force(spark):
    import random
    from collections import Counter

    rng, cases = random.Random(6), []
    for n in [0, 1, 2, 5, 70, 130, 300]:
        for m in [0, 1, 3, 64, 65, 200]:
            cases.append(([rng.choice("abcdefg") for _ in range(n)], [rng.choice("abcdefgh") for _ in range(m)]))
    cases += [(None, ["a"]), (["a"], None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    for r in rows.select("i", T.lcs(F.col("a"), F.col("b")).alias("n"), T.shared_tokens(F.col("a"), F.col("b")).alias("m")).collect():
        a, b = cases[r.i]
        line = [0] * (len(b or []) + 1)
        for x in a or []:
            line = [0] + [max(line[j + 1], 0) if x != y else line[j] + 1 for j, y in enumerate(b or [])]
            line = [max(line[: j + 1]) for j in range(len(line))]
        assert r.n == line[-1], r.i
        if a is not None and b is not None:
            assert r.m == sum((Counter(a) & Counter(b)).values())


@pytest.mark.parametrize("word, stemmed", [("berries", "berry"), ("boxes", "box"), ("cats", "cat"), ("bus", "bus"), ("churches", "church"), ("ties", "tie")])
def test_stem(spark, word, stemmed):
    assert one(spark, x=T.stem(F.lit(word))).x == stemmed


BICYCLES = "The image does not contain any bicycles."


@pytest.mark.parametrize(
    "reference, prediction, expected, rule",
    [
        (BICYCLES, "There are no bicycles visible in the image.", "reject_premise", "there_is_no"),
        (BICYCLES, "There are no clouds visible in the image.", "ambiguous_rejection", "there_is_no"),
        (BICYCLES, "I cannot see the image. Please upload it.", "abstain_no_visual_input", "no_visual_input"),
        ("There is a train and no bus.", "The picture has a train, not a bus.", "reject_premise", "target_local_negation"),
        ("The book is on the table.", "I am not sure where the book is.", "no_explicit_rejection", "no_rule_match"),
        (BICYCLES, "  ", "empty", "empty_response"),
    ],
)
def test_stance(spark, reference, prediction, expected, rule):
    row = stance(spark, reference, prediction)
    assert (row.stance, row.stance_rule) == (expected, rule)


def test_stance_overlap(spark):
    assert stance(spark, BICYCLES, "There are no bicycles visible in the image.").reference_content_overlap == ["bicycle"]
    assert stance(spark, BICYCLES, "I cannot see the image, nor bicycles.").reference_content_overlap == []


@pytest.mark.parametrize(
    "reference, prediction, review, reason",
    [
        ("Skis.", "Skis.", False, ""),
        ("Skis.", "The airplane is equipped with skis.", False, ""),
        ("flowers", "I am not sure; possibly flowers or a plant.", True, "clean_containment_is_uncertain"),
        ("a dog", "a cat", True, "clean_answer_requires_semantic_review"),
    ],
)
def test_clean_rows(spark, reference, prediction, review, reason):
    row = R.scored(spark.createDataFrame([(reference, prediction)], "reference string, prediction string"), "reference", "prediction", F.lit(False)).first()
    assert row.manual_review_required == review and row.manual_review_reason == reason and row.stance == "not_applicable"


@pytest.mark.parametrize(
    "question, reference, prediction, verdict, utility",
    [
        ("What color is the collar?", "The dog is not wearing a collar.", "The dog is not wearing a collar.", "correct", 1),
        ("What color is the collar?", "The dog is not wearing a collar.", "The collar is blue.", "incorrect", 0),
        ("What color is the collar?", "The dog is not wearing a collar.", "The image does not provide information about it.", "uncertain", None),
        ("How many dogs?", "There are no dogs.", "0", "correct", 1),
    ],
)
def test_false_premise_verdict(spark, question, reference, prediction, verdict, utility):
    rows = spark.createDataFrame([(question, reference, prediction)], "question string, reference string, prediction string")
    row = R.judged(rows, "question", "reference", "prediction").first()
    assert (row.verdict, row.utility) == (verdict, utility)


def test_variants(spark):
    assert one(spark, x=T.variants(F.lit("First; Second;"))).x == ["First", "Second"]
    assert one(spark, x=T.variants(F.lit(" ; "))).x == [" ; "]


@pytest.mark.parametrize("raw, plain", [("The two cats.", "2 cats"), ("Dont, guess!", "don't guess"), ("1,000 a/b", "1000 ab"), ("a-b", "b"), ("3.5 m.", "3.5 m")])
def test_normalized_answer(spark, raw, plain):
    assert one(spark, x=T.normalized_answer(F.lit(raw))).x == plain


def test_soft_accuracy(spark):
    answers = F.array(*[F.lit("blue")] * 3, *[F.lit("red")] * 7)
    row = one(spark, **{c: T.official_accuracy(F.lit(c), answers) for c in ("blue", "red", "green")})
    assert row.blue == pytest.approx(0.9) and row.red == 1.0 and row.green == 0.0
    same = F.array(*[F.lit("yes")] * 10)
    assert one(spark, x=T.official_accuracy(F.lit("Yes"), same)).x == 0.0
    assert one(spark, x=T.normalized_accuracy(F.lit("Yes"), same)).x == 1.0
    assert one(spark, x=T.normalized_accuracy(F.lit("Yes"), F.array().cast("array<string>"))).x is None


def test_soft_accuracy_is_leave_one_out(spark):
    import random

    rng = random.Random(4)
    cases = [([rng.choice("abc") for _ in range(rng.randint(1, 10))], rng.choice("abcd")) for _ in range(200)]
    rows = spark.createDataFrame([(a, p) for a, p in cases], "answers array<string>, p string").select(T.soft_accuracy(F.col("p"), F.col("answers")).alias("x")).collect()
    for (answers, p), row in zip(cases, rows, strict=True):
        loop = [min(1, sum(a == p for j, a in enumerate(answers) if j != i) / 3) for i in range(len(answers))]
        assert row.x == pytest.approx(sum(loop) / len(loop))


def test_prompt(spark):
    row = one(spark, a=T.prompt(F.lit(" Why? "), F.lit("native_prompt")), b=T.prompt(F.lit("Why?"), F.lit("premise_verification")))
    assert row.a == "Why?" and row.b.endswith("directly.\n\nQuestion: Why?")
    with pytest.raises(Exception, match="empty"):
        one(spark, a=T.prompt(F.lit(" "), F.lit("native_prompt")))


def test_first_line(spark):
    assert one(spark, x=T.first_line(F.lit(" a \r\nb"))).x == "a"
    assert one(spark, x=T.first_line(F.lit(""))).x is None


def test_logprobs(spark):
    row = one(spark, **A.logprob_statistics(F.array(F.lit(-1.0), F.lit(-3.0))))
    assert row.n == 2 and row.mean == -2.0 and row.perplexity == pytest.approx(math.exp(2))
    assert one(spark, **A.nonzero_statistics(F.array(F.lit(0.0)))).mean is None


def test_variant_features(spark):
    row = one(spark, **A.variant_features(F.array(F.lit(-0.2), F.lit(-0.5), F.lit(-0.3)), F.lit(-0.4)))
    assert row.identity == pytest.approx(0.2) and row.low == pytest.approx(-0.1) and row.positive_fraction == pytest.approx(2 / 3)


def test_labels(spark):
    yes, no, unsure = map(F.lit, ("yes", "no", "uncertain"))
    row = one(spark, a=R.effect_of_labels(no, yes), b=R.effect_of_labels(yes, no), c=R.effect_of_labels(yes, yes), d=R.effect_of_labels(unsure, yes))
    assert tuple(row) == ("intervention_helps", "intervention_harms", "semantic_tie", "uncertain")
    helps, harms, tie = F.lit("intervention_helps"), F.lit("intervention_harms"), F.lit("semantic_tie")
    row = one(spark, a=R.overall_action(helps, tie), b=R.overall_action(helps, harms), c=R.overall_action(harms, helps), d=R.overall_action(tie, harms), e=R.overall_action(tie, tie))
    assert tuple(row) == ("choose_intervention", "uncertain", "choose_native", "choose_native", "either")
