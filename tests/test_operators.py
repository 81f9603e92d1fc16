import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscope.operators import align as J
from pairscope.operators import contracts as C
from pairscope.operators import review as R
from pairscope.operators import sampling as O
from pairscope.operators import select as M
from pairscope.operators import stats as T
from pairscope.operators import summarize as S
from pairscope.sources import io


def test_contracts_give_the_violations(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", None)], "k long, m string, v string")
    assert [r.k for r in C.duplicate_keys(df, ["k"]).collect()] == [1]
    assert [(r.k, r.missing) for r in C.incomplete_sets(df, "k", "m", ["a", "b"]).collect()] == [(2, "b")]
    assert C.unequal_values(df, "k", "v").count() == 0
    assert [r.k for r in C.unequal_values(df, "k", "m").collect()] == [1]
    assert {(r.k, r.side) for r in C.key_set_difference(df, spark.createDataFrame([(2,), (3,)], "k long"), ["k"]).collect()} == {(1, "left"), (3, "right")}
    assert C.not_in_domain(df, "v", ["x"]).count() == 1
    with pytest.raises(C.ContractError, match="duplicate.*n_rows.*2"):
        C.assert_empty(C.duplicate_keys(df, ["k"]), "duplicate keys")
    pins = {(r.m, r.n_rows, r.expected) for r in C.wrong_counts(df, "m", {"a": 2, "c": 1}).collect()}
    assert pins == {("b", 1, 0), ("c", 0, 1)}


def test_pairs_need_one_row_of_each_kind(spark):
    df = spark.createDataFrame([(1, None), (1, "object"), (2, None)], "k long, kind string")
    assert [r.k for r in C.not_paired(df, "k", "kind").collect()] == [2]


def test_misaligned_pairs_raise(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,), (3,)], "k long")
    with pytest.raises(C.ContractError, match="not pair-aligned"):
        J.aligned(a, b, ["k"])


def test_last_wins(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "k long, i long, v string")
    assert {(r.k, r.v) for r in J.last_wins(df, ["k"], "i").collect()} == {(1, "b"), (2, "c")}


def test_upsert_keeps_and_guards(spark):
    base = spark.createDataFrame([(1, None), (2, "x")], "k long, v string")
    assert {(r.k, r.v) for r in J.upsert(base, spark.createDataFrame([(1, "n"), (2, "x")], "k long, v string"), "k", ["v"]).collect()} == {(1, "n"), (2, "x")}
    with pytest.raises(C.ContractError, match="disagree"):
        J.upsert(base, spark.createDataFrame([(2, "y")], "k long, v string"), "k", ["v"])


def test_transitions_count_all_cells(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    assert tuple(df.agg(*[c.alias(n) for n, c in S.transitions(F.col("a"), F.col("b")).items()]).first()) == (1, 1, 1, 1)


def test_signs(spark):
    row = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (-1.0,)], "d double").agg(*[c.alias(n) for n, c in S.signs(F.col("d")).items()]).first()
    assert (row.positive, row.positive_rate) == (3, 0.75)


def binomial(f, g):
    n = f + g
    return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(f, g) + 1)) / 2**n)


def test_exact_test(spark):
    cases = [(f, g) for f in range(0, 30, 3) for g in range(0, 30, 4)] + [(3, 1), (700, 640)]
    rows = spark.createDataFrame(cases, "f long, g long").select(T.exact_two_sided(F.col("f"), F.col("g")).alias("p")).collect()
    for (f, g), row in zip(cases, rows, strict=True):
        assert row.p == pytest.approx(binomial(f, g), abs=1e-10)


def pairwise_auroc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auroc_and_precision_match_their_definitions(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 9) / 10, rng.random() < 0.4) for _ in range(150)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    assert T.auroc(df, "s", "y", []).first().auroc == pytest.approx(pairwise_auroc(*zip(*rows)))
    p, y = np.array([r[0] for r in rows]), np.array([int(r[1]) for r in rows])
    want = sum((y[p == t].sum() / y.sum()) * (y[p >= t].sum() / (p >= t).sum()) for t in np.unique(p))
    assert T.average_precision(df, "s", "y", []).first().average_precision == pytest.approx(want)
    assert M.average_precision(p, y) == pytest.approx(want)
    assert T.auroc(df.where("y"), "s", "y", []).first().auroc is None


def test_pearson_is_null_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(T.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None
    assert df.limit(1).agg(T.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_bootstrap_is_deterministic_and_has_the_right_size(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(11)], "i long, g boolean")
    one, two = (sorted(map(tuple, T.resampled(df.repartition(n), ["i"], 3, 4, ["g"]).select("replicate", "i").collect())) for n in (1, 5))
    assert one == two and len(one) == 44


def test_numbers_within_groups(spark):
    from pairscope.operators.ordering import numbered

    rows = [(g, i, f"{g}{i}") for g, n in (("a", 700), ("b", 3), (None, 40)) for i in range(n)]
    got = numbered(spark.createDataFrame(rows, "g string, i long, v string").repartition(7), ["g"], ["i"]).collect()
    assert len(got) == len(rows) and all(r.row_idx == r.i for r in got)
    assert sorted(r.row_idx for r in numbered(spark.range(50), [], ["id"]).collect()) == list(range(50))


def test_threshold_choice_is_the_scan_over_cuts(spark):
    rng = random.Random(6)
    for _ in range(4):
        rows = [(rng.randint(0, 6) / 6, float(rng.randint(0, 1)), float(rng.randint(0, 1))) for _ in range(40)]
        got = T.threshold_choice(spark.createDataFrame(rows, "p double, b double, a double"), "p", "b", "a", []).first()
        p, b, a = map(np.array, zip(*rows))
        assert got.threshold == pytest.approx(M.threshold(p, b, a))
    assert M.threshold(np.array([0.9, 0.8, 0.2]), np.zeros(3), np.array([1.0, 0.0, -1.0])) == 0.9


@pytest.mark.parametrize("size, quotas", [(500, [79, 328, 93]), (200, [32, 131, 37]), (50, [8, 33, 9])])
def test_quotas(spark, size, quotas):
    df = spark.createDataFrame([("attribute",)] * 318 + [("object",)] * 1311 + [("relation",)] * 371, "kind string")
    assert [r.quota for r in O.quotas(df, "kind", size).orderBy("kind").collect()] == quotas


def greedy(rows, wanted, seed):
    import hashlib

    queues = {s: sorted((hashlib.sha256(f"{seed}:{k}".encode()).hexdigest(), k, u) for k, t, u in rows if t == s) for s in wanted}
    taken, out, left = set(), [], dict(wanted)
    while any(left.values()):
        for s in sorted(left):
            if left[s]:
                while queues[s] and queues[s][0][2] in taken:
                    queues[s].pop(0)
                if not queues[s]:
                    return None
                _, k, u = queues[s].pop(0)
                taken.add(u)
                out.append(k)
                left[s] -= 1
    return out


def test_balanced_sample_is_the_greedy_one(spark):
    rng = random.Random(2)
    for trial in range(4):
        rows = [(k, rng.choice("xyz"), rng.randint(0, 7)) for k in range(50)]
        df, wanted = spark.createDataFrame(rows, "k long, s string, u long"), {"x": 2, "y": 2, "z": 2}
        want = greedy(rows, wanted, trial)
        if want is None:
            with pytest.raises(C.ContractError):
                O.balanced(df, "k", "s", "u", wanted, trial)
        else:
            assert [r.k for r in O.balanced(df, "k", "s", "u", wanted, trial).orderBy("sample_order").collect()] == want


def test_samples_are_nested(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "k long, s string")
    rows = O.nested(df, "k", "s", {"outer": 20, "inner": 8}, 1).collect()
    assert sum(r.outer for r in rows) == 20 and sum(r.inner for r in rows) == 8 and all(r.outer for r in rows if r.inner)
    with pytest.raises(ValueError):
        O.top(df, [F.col("k")], 0)


def test_confirmation_touches_open_rows_only(spark):
    df = spark.createDataFrame([(1, "high", ""), (2, "low", "edit"), (3, "low", None)], "k long, c string, human_confirmation string")
    rows = {r.k: (r.human_confirmation, r.changed) for r in R.confirm(df, F.col("c") == "low").collect()}
    assert rows == {1: ("", False), 2: ("edit", False), 3: ("accept", True)}


def test_csv_and_json_keep_texts(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nof two lines'), (2, ""), (3, "é😀")]
    df = spark.createDataFrame(rows, "k long, t string")
    io.write_csv(df, str(tmp_path / "c"), ["k", "t"])
    assert sorted((int(r.k), r.t) for r in io.read_csv(spark, str(tmp_path / "c"), ["k", "t"]).collect()) == rows
    io.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(map(tuple, io.read_json_lines(spark, str(tmp_path / "j"), "k long, t string").collect())) == rows
    io.write_small_csv(df, str(tmp_path / "s.csv"), ["k", "t"], bom=True)
    assert (tmp_path / "s.csv").read_bytes().startswith(b"\xef\xbb\xbfk,t\n")


def test_append_resumes(spark, tmp_path):
    path = str(tmp_path / "done")
    assert io.append_new(spark.range(5), path, ["id"]) == 5
    assert io.append_new(spark.range(8), path, ["id"]) == 3
    assert spark.read.parquet(path).count() == 8 and io.append_new(spark.range(8), path, ["id"]) == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):  # an unreadable table isn't taken for no table
        io.append_new(spark.range(3), str(tmp_path / "broken"), ["id"])


def test_digests_read_in_chunks(spark, tmp_path):
    import hashlib

    (tmp_path / "files").mkdir()
    for name, raw in (("a.bin", b"x" * 5000), ("b.bin", b"y")):
        (tmp_path / "files" / name).write_bytes(raw)
    found = io.file_digests(spark, str(tmp_path / "files"), chunk=64)
    assert {r.file.rsplit("/", 1)[1]: r.sha256 for r in found.collect()} == {"a.bin": hashlib.sha256(b"x" * 5000).hexdigest(), "b.bin": hashlib.sha256(b"y").hexdigest()}
    assert sorted(r.name for r in io.unpinned(found, {"a.bin": hashlib.sha256(b"x" * 5000).hexdigest(), "b.bin": "0", "c.bin": "1"}).collect()) == ["b.bin", "c.bin"]


def test_cells_of_any_type(spark):
    import json

    values = [("t", ["a", None, 'q"'], {"é": 2}, 3, True, (1, [2])), (None, None, None, None, None, None)]
    df = spark.createDataFrame(values, "s string, l array<string>, m map<string,int>, n long, b boolean, w struct<x:int,y:array<int>>")
    got = df.select(*[io.text_or_json(df, c).alias(c) for c in df.columns]).collect()
    one = values[0]
    assert tuple(got[0]) == ("t", *[json.dumps(x, ensure_ascii=False) for x in (one[1], one[2], one[3], one[4], {"x": 1, "y": [2]})])
    assert tuple(got[1]) == ("",) * 6


def study_rows(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        effect = rng.random() < 0.4
        rows.append((i, int(effect), 0, int(effect), float(effect) + rng.gauss(0, 0.3), rng.gauss(0, 1), f"g{i // 2}", "target" if i >= n // 2 else "source"))
    return spark.createDataFrame(rows, "id long, target int, before int, after int, strong double, weak double, grp string, scope string")


STUDY = M.Study({"strong": ("strong",), "weak": ("weak",)}, group="grp", folds=3, repeats=2, penalties=(0.1, 1.0))


def test_folds_keep_groups_whole():
    rng = np.random.default_rng(0)
    y, groups = rng.integers(0, 2, 80), np.arange(80) // 3
    fold = M.group_folds(y, groups, 4, 5)
    assert all(len(set(fold[groups == g])) == 1 for g in set(groups)) and set(fold) == {0, 1, 2, 3}
    assert (fold == M.group_folds(y, groups, 4, 5)).all()


def test_folds_of_a_table(spark):
    rng = random.Random(8)
    rows = [(i, i // rng.choice((1, 2, 3)), int(rng.random() < 0.3)) for i in range(300)] + [(1000 + i, 5000, i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, g long, y int")
    found = {r.g: r.folds for r in M.fold_groups(df, "g", "y", 4, [1, 1001]).collect()}
    assert set(found) == {g for _, g, _ in rows} and found == {r.g: r.folds for r in M.fold_groups(df.repartition(5), "g", "y", 4, [1, 1001]).collect()}
    assert any(a != b for a, b in found.values())
    for seed in (0, 1):
        for fold in range(4):
            rest = [y for _, g, y in rows if found[g][seed] != fold]
            assert 0 < sum(rest) < len(rest) and len(rest) < len(rows)
    each = {r.id: r.folds[0] for r in M.fold_groups(df, "id", "y", 5, [7]).collect()}
    for label in (0, 1):
        sizes = [sum(each[i] == f for i, _, y in rows if y == label) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    with pytest.raises(C.ContractError):
        M.fold_groups(df.where("y = 1"), "g", "y", 3, [1])


def test_selectors_beyond_the_sample_score_every_row(spark, monkeypatch):
    monkeypatch.setattr(M, "FIT_ROWS", 80)
    df = study_rows(spark, 400)
    out = M.nested_cv(df, M.Study({"strong": ("strong",)}, group="grp", folds=3, repeats=1, penalties=(1.0,)))
    assert out.count() == 400 and out.select("id").distinct().count() == 400
    scored = out.join(df, "id").withColumn("y", F.col("target") == 1)
    assert T.auroc(scored, "probability", "y", []).first().auroc > 0.9
    one = M.out_of_fold(df, ("strong",), "target", "grp", "id", 3, 1, 1.0)
    assert one.count() == 400 and len(M.sample(df, ["target"], "grp", "id")) <= 80


def test_out_of_fold_matches_a_plain_loop(spark):
    df = study_rows(spark, 90)
    rows = df.toPandas()
    fold = {r.grp: r.folds[0] for r in M.fold_groups(df, "grp", "target", 3, [4]).collect()}
    folds = rows["grp"].map(fold).to_numpy()
    x, y, want = rows[["strong", "weak"]].to_numpy(), rows["target"].to_numpy(), {}
    for f in range(3):
        mean, std = x[folds != f].mean(axis=0), x[folds != f].std(axis=0)
        w = M.fit((x[folds != f] - mean) / std, y[folds != f], 0.5)
        want |= dict(zip(rows["id"][folds == f], M.predict(w, (x[folds == f] - mean) / std)))
    got = {r.id: r.probability for r in M.out_of_fold(df, ("strong", "weak"), "target", "grp", "id", 3, 4, 0.5).collect()}
    assert got == pytest.approx(want)


def test_thresholds_match_a_scan():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        p, before, after = rng.integers(0, 12, n) / 11, rng.integers(0, 2, n).astype(float), rng.integers(0, 2, n).astype(float)
        best = max((round(float(np.where(p >= c, after, before).mean()), 12), -int((p >= c).sum()), c) for c in (0.0, *p, np.nextafter(1, 2)))
        assert M.threshold(p, before, after) == best[2]


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, rng.random(), float(rng.randint(0, 3))])) for _ in range(400)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.0, "q": 0.37, "median": 0.5, "high": 1.0}
    for r in T.quantiles(df, "v", ["g"], shares).collect():
        own = [v for g, v in rows if g == r.g and v is not None]
        assert [r[n] for n in shares] == pytest.approx([np.quantile(own, s) for s in shares.values()])
    assert T.quantiles(df, "v", [], {"q": 0.9}).first().q == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.9))


def test_nested_cv_decides_every_row_once_a_repeat(spark):
    df = study_rows(spark)
    out = M.nested_cv(df, STUDY).cache()
    assert out.count() == 2 * 2 * 60 and out.groupBy("feature_set", "repeat", "id").count().where("count <> 1").isEmpty()
    again = M.nested_cv(df.repartition(3), STUDY)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    gain = M.compare_sets(out, df.withColumn("target", F.col("target") == 1), "id", "target").first()
    assert (gain["first"], gain["second"]) == ("strong", "weak") and gain.gain < 0


def test_transfer_without_shared_groups(spark):
    df = study_rows(spark, 80)
    out = M.transfer(df.where("scope = 'source'"), df.where("scope = 'target'"), STUDY, "strong").withColumn("y", F.col("target") == 1)
    assert T.auroc(out, "probability", "y", []).first().auroc > 0.9
