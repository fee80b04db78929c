import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.operators import bayes, evaluate, ordering, split, tfidf, tuning
from forumlens.operators.tfidf import VocabularyRule
from forumlens.operators.tuning import Choice
from tests import helpers
from tests.helpers import rows


def labelled(seed=3, n=90):
    rng = np.random.default_rng(seed)
    docs = helpers.random_docs(seed, n)
    labels = {i: "bio" if rng.random() < 0.35 else "env" for i in docs}
    for i, terms in docs.items():
        if terms and rng.random() < 0.7:
            terms.append("gene" if labels[i] == "bio" else "sea")
    docs[n] = []
    labels[n] = "env"
    return {i: (labels[i], [str(t) for t in docs[i]]) for i in docs}


def frame(spark, data, **extra):
    return spark.createDataFrame([(i, c, t, *(v[i] for v in extra.values())) for i, (c, t) in data.items()],
                                 "id long, label string, terms array<string>" + "".join(f", {k} int" for k in extra))


# splits

def test_hash_rank_equals_a_plain_sort(spark):
    import hashlib
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', concat('g', id % 7)) g")
    got = {r["id"]: (r["pos"], r["group_size"]) for r in ordering.hash_rank(df, "g", "id", seed=4).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["g"], []).append(r["id"])
    for ids in groups.values():
        ids.sort(key=lambda i: (hashlib.md5(f"{i}#4".encode()).hexdigest(), i))
        assert [got[i] for i in ids] == [(k, len(ids)) for k in range(len(ids))]


def test_ranking_never_windows_over_a_whole_group(spark):
    df = spark.range(500).selectExpr("id", "concat('g', id % 2) g")
    plan = ordering.hash_rank(df, "g", "id")._jdf.queryExecution().optimizedPlan().toString()
    row_number = plan.split("row_number() windowspecdefinition(")[1]
    assert row_number.startswith("g#") and row_number.split(", ")[1].startswith("_bucket#")


def test_folds_and_split_are_balanced_whole_and_reproducible(spark):
    df = frame(spark, labelled()).select("id", "label")
    folds = split.stratified_folds(df, "label", n_folds=4)
    assert folds.count() == df.count() == folds.select("id").distinct().count()
    sizes = folds.groupBy("label", "fold").count().groupBy("label").agg(F.max("count") - F.min("count"))
    assert all(r[1] <= 1 for r in sizes.collect())
    assert rows(folds) == rows(split.stratified_folds(df.repartition(5), "label", n_folds=4))
    assert rows(folds) != rows(split.stratified_folds(df, "label", n_folds=4, seed=1))
    parts = split.stratified_split(df, "label").groupBy("label").agg(
        F.count_if(F.col("split") == "test").alias("t"), F.count(F.lit(1)).alias("n"))
    assert all(abs(r["t"] - 0.3 * r["n"]) <= 0.5 for r in parts.collect())


@pytest.mark.parametrize("buckets", [1, 2, 64])
def test_running_totals(spark, buckets):
    rng = np.random.default_rng(0)
    data = sorted({("hot", float(x)) for x in rng.integers(0, 300, 200)} | {("b", 1.0)})
    df = spark.createDataFrame([(g, x, 1 + int(x) % 5) for g, x in data], "g string, x double, n long")
    for r in ordering.running_totals(df, ["g"], "x", {"n": "n"}, buckets).collect():
        assert r["cum_n"] == sum(1 + int(x) % 5 for g, x in data if g == r["g"] and x >= r["x"])
        assert r["all_n"] == sum(1 + int(x) % 5 for g, x in data if g == r["g"])


# naive Bayes

@pytest.mark.parametrize("alpha", [1.0, 0.05])
def test_scores_match_a_plain_computation(spark, alpha):
    data = labelled()
    train = {i: d for i, d in data.items() if i % 3}
    test = {i: t for i, (_, t) in data.items() if i % 3 == 0}
    test[1000], test[1001] = ["never", "seen"], []
    model = bayes.fit(frame(spark, train), alpha=alpha)
    docs = spark.createDataFrame(list(test.items()), "id long, terms array<string>")
    expected = helpers.bayes_scores(train, test, alpha)
    got = {(r["id"], r["class"]): r["score"] for r in bayes.joint_scores(docs, model).collect()}
    assert len(got) == 2 * len(test)
    assert all(got[i, c] == pytest.approx(s) for i, per in expected.items() for c, s in per.items())
    assert dict(rows(bayes.predict(docs, model))) == {i: max(sorted(per), key=per.get) for i, per in expected.items()}
    for r in bayes.predict_proba(docs, model).groupBy("id").agg(F.sum("proba").alias("s")).collect():
        assert r["s"] == pytest.approx(1)


def test_more_than_two_classes_and_saved_models(spark, tmp_path):
    data = {i: ("abc"[i % 3], ["abc"[i % 3] * 3, "word"]) for i in range(30)}
    df = frame(spark, data)
    bayes.fit(df, VocabularyRule(max_features=3)).save(str(tmp_path))
    model = bayes.NaiveBayesModel.load(spark, str(tmp_path))
    assert model.terms.count() == 3 and model.classes == ["a", "b", "c"]
    predicted = dict(rows(bayes.predict(df, bayes.fit(df))))
    assert all(predicted[i] == c for i, (c, _) in data.items())


@pytest.mark.parametrize("classes", ["ab", "abc"])
def test_log_odds_tell_saturated_posts_apart(spark, classes):
    words = {"x": [-1.0, -60.0, -61.0], "y": [-1.0, -80.0, -80.5], "z": [-2.0, -2.0, -3.0]}
    terms = spark.createDataFrame([(t, 1.0, p[:len(classes)]) for t, p in words.items()],
                                  "term string, idf double, logp array<double>")
    model = bayes.NaiveBayesModel(terms, list(classes), [0.0] * len(classes))
    docs = spark.createDataFrame([(i, [t]) for i, t in enumerate(words)], "id long, terms array<string>")
    got = {(r["id"], r["class"]): r for r in bayes.predict_proba(docs, model).collect()}
    for i, p in enumerate(words.values()):
        for k, c in enumerate(classes):
            others = [s for j, s in enumerate(p[:len(classes)]) if j != k]
            expected = p[k] - max(others) - math.log(sum(math.exp(s - max(others)) for s in others))
            assert got[i, c]["odds"] == pytest.approx(expected, abs=1e-8)
            assert got[i, c]["proba"] == pytest.approx(1 / (1 + math.exp(-expected)))
    assert got[0, "a"]["proba"] == got[1, "a"]["proba"] == 1.0 and got[0, "a"]["odds"] < got[1, "a"]["odds"]


def test_classes_have_no_limit(spark):
    assert len(bayes.class_sizes(spark.range(1001).selectExpr("cast(id as string) label"))) == 1001


# evaluation

def test_report_and_matrix(spark):
    predicted = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    classes = ["a", "b", "c"]
    assert rows(evaluate.accuracy(predicted)) == [(0.5,)]
    cells = {(r["label"], r["prediction"]): r["n"] for r in evaluate.confusion_matrix(predicted, classes).collect()}
    assert len(cells) == 9 and cells["a", "b"] == 1 and cells["c", "c"] == 0
    report = {r["name"]: (r["precision"], r["recall"], r["f1"], r["support"])
              for r in evaluate.classification_report(predicted, classes).collect()}
    assert report["a"] == (0.5, 0.5, 0.5, 2)
    assert report["b"] == pytest.approx((0.5, 1.0, 2 / 3, 1))
    assert report["c"] == (0.0, 0.0, 0.0, 1)
    assert report["macro avg"] == pytest.approx((1 / 3, 0.5, (0.5 + 2 / 3) / 3, 4))
    assert report["weighted avg"] == pytest.approx((0.375, 0.5, (1.0 + 2 / 3) / 4, 4))


def test_area_under_the_curve(spark):
    rng = np.random.default_rng(5)
    data = [(int(i), "a" if rng.random() < 0.4 else "b", round(float(rng.random()), 1)) for i in range(60)]
    labels = spark.createDataFrame([(i, c) for i, c, _ in data], "id long, label string")
    probabilities = spark.createDataFrame(
        [(i, k, p if k == "a" else round(1 - p, 1)) for i, _, p in data for k in "ab"], "id long, class string, proba double")
    counts = evaluate.score_counts(probabilities, labels)
    got = dict(rows(evaluate.roc_auc(counts)))
    expected = helpers.auc([p for _, c, p in data if c == "a"], [p for _, c, p in data if c == "b"])
    assert got == {"a": pytest.approx(expected), "b": pytest.approx(expected)}
    points = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_points(counts).where("class = 'a'").collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(points, points[1:]))
    assert area == pytest.approx(expected)


def test_one_class_has_no_area(spark):
    counts = spark.createDataFrame([("a", 0.3, 2, 0), ("a", 0.6, 1, 0)], "class string, proba double, pos long, neg long")
    assert rows(evaluate.roc_auc(counts)) == [("a", None)]


# cross-validation and search

def brute_folds(data, folds, choice):
    """{(part, metric): [value per fold]} by fitting every fold on its own."""
    out = {}
    for f in range(max(folds.values()) + 1):
        train = {i: d for i, d in data.items() if folds[i] != f}
        keep = None
        if choice.rule != VocabularyRule():
            df, cf = {}, {}
            for _, terms in train.values():
                for t in terms:
                    cf[t] = cf.get(t, 0) + 1
                for t in set(terms):
                    df[t] = df.get(t, 0) + 1
            low = choice.rule.min_df
            high = choice.rule.max_df * len(train) if isinstance(choice.rule.max_df, float) else choice.rule.max_df
            keep = sorted((t for t in df if low <= df[t] <= high), key=lambda t: (-cf[t], t))[:choice.rule.max_features]
        scores = helpers.bayes_scores(train, {i: t for i, (_, t) in data.items()}, choice.alpha, keep and set(keep))
        for part, members in (("train", train), ("valid", {i: d for i, d in data.items() if folds[i] == f})):
            hits = [max(sorted(scores[i]), key=scores[i].get) == c for i, (c, _) in members.items()]
            odds = {i: round(1 / (1 + math.exp(scores[i]["bio"] - scores[i]["env"])), 9) for i in members}
            out.setdefault((part, "accuracy"), []).append(sum(hits) / len(hits))
            out.setdefault((part, "roc_auc"), []).append(helpers.auc(
                [odds[i] for i, (c, _) in members.items() if c == "env"],
                [odds[i] for i, (c, _) in members.items() if c == "bio"]))
    return out


CHOICES = [Choice(), Choice(VocabularyRule(min_df=2)), Choice(VocabularyRule(max_df=0.3)),
           Choice(VocabularyRule(max_features=5), 0.5), Choice(VocabularyRule(max_df=3, max_features=2), 0.1)]


def test_cross_validation_matches_separate_fits(spark, monkeypatch):
    data = labelled()
    folds = {i: k % 3 for k, i in enumerate(data)}
    monkeypatch.setattr(tuning, "MAX_SUMS", 20)  # several passes
    summary = tuning.summarise(tuning.fold_measures(frame(spark, data, fold=folds), CHOICES)).collect()
    assert len(summary) == 2 * len(CHOICES)
    for r in summary:
        expected = brute_folds(data, folds, CHOICES[r["choice"]])
        for part in ("valid", "train"):
            values = expected[part, r["metric"]]
            assert r[f"{part}_avg"] == pytest.approx(np.mean(values)), (r["choice"], r["metric"], part)
            assert r[f"{part}_sd"] == pytest.approx(np.std(values), abs=1e-9)


@pytest.mark.parametrize("size", [1, 4, 30, 77, 150, 500])
def test_long_rankings_do_not_sort_the_vocabulary(spark, size):
    rng = np.random.default_rng(2)
    rows_ = [(f, t, int(rng.integers(1, 4)), int(rng.integers(1, 4))) for f in range(2)
             for t in sorted({"".join(rng.choice(list("abcé"), 5)) for _ in range(200)})]
    terms = spark.createDataFrame([(f, t, df, df + extra) for f, t, df, extra in rows_], "fold int, term string, df long, cf long")
    sizes = spark.createDataFrame([(0, 100), (1, 100)], "fold int, n_train long")
    rules = [VocabularyRule(max_features=size), VocabularyRule(min_df=2, max_features=size)]
    found = tuning._vocabularies(terms, sizes, rules)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "0")
    try:
        assert sorted(rows(tuning._vocabularies(terms, sizes, rules))) == sorted(rows(found))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_sweep_and_grid(spark):
    data = labelled()
    df = frame(spark, data, fold={i: k % 3 for k, i in enumerate(data)})
    swept = tuning.tune_one(df, max_features=[2, 6], min_df=[2])
    assert sorted((r["param"], r["metric"]) for r in swept.collect()) == [
        (2.0, "accuracy"), (2.0, "roc_auc"), (6.0, "accuracy"), (6.0, "roc_auc")]
    with pytest.raises(ValueError):
        tuning.tune_one(df)
    with pytest.raises(ValueError):
        tuning.cross_validate(df, measures=("speed",))
    twins = [Choice(VocabularyRule(max_features=6)), Choice(VocabularyRule(max_features=6, max_df=0.99)), Choice(VocabularyRule(max_features=1))]
    searched = tuning.grid_search(df, twins)
    assert tuning.best_choice(searched, twins) == twins[0]    # equal scores: the earlier one
    assert len(tuning.vocabulary_grid()) == 72


def test_no_fold_or_choice_is_lost(spark):
    docs = [(i, "ab"[i % 2], i // 2, ["x", "y"] if i < 4 else [f"t{i}"]) for i in range(6)]
    df = spark.createDataFrame(docs, "id long, label string, fold int, terms array<string>")
    choices = [tuning.Choice(VocabularyRule(min_df=n)) for n in (1, 2, 5)]
    measured = tuning.fold_measures(df, choices)
    assert measured.count() == 3 * 3 * 2 * 2
    summary = {(r["choice"], r["metric"]): r for r in tuning.summarise(measured).collect()}
    assert len(summary) == 6 and summary[0, "accuracy"]["valid_avg"] is not None
    assert summary[2, "accuracy"]["valid_avg"] is None and summary[2, "accuracy"]["train_sd"] is None
    searched = tuning.grid_search(df, choices)
    assert searched.count() == 3 and tuning.best_choice(searched, choices) != choices[2]


def test_searches_write_no_table_of_postings(spark, monkeypatch):
    """Terms are counted, models fitted and posts scored in blocks of posts, whatever their number."""
    written, stage = [], tuning.stage
    monkeypatch.setattr(tuning, "stage", lambda df: (written.append(set(df.columns)), stage(df))[1])
    monkeypatch.setattr(tfidf, "BLOCK_WORDS", 30)
    data = labelled()
    folds = {i: k % 3 for k, i in enumerate(data)}
    for r in tuning.summarise(tuning.fold_measures(frame(spark, data, fold=folds), CHOICES)).collect():
        expected = brute_folds(data, folds, CHOICES[r["choice"]])
        assert [r["valid_avg"], r["train_avg"]] == pytest.approx([np.mean(expected[p, r["metric"]]) for p in ("valid", "train")])
    assert written and not any({"id", "term"} <= columns for columns in written)


def test_rows_of_one_id_label_and_fold_are_one_post(spark):
    docs = [(1, "a", 0, ["x", "y", "x"]), (1, "a", 0, ["x"]), (1, "b", 0, ["x"]), (2, "b", 1, ["x", "y"]), (None, "a", 1, ["z"]),
            (None, "a", 1, ["z", "y"]), (3, None, 2, []), (4, "a", None, ["w"])]
    df = spark.createDataFrame(docs, "id long, label string, fold int, terms array<string>")
    got = {(r["fold"], r["term"]): (r["df"], r["cf"]) for r in tuning._training_terms(df, 3).collect()}
    both = {"x": (3, 5), "y": (3, 3), "z": (1, 2), "w": (1, 1)}
    own = {0: {"x": (2, 4), "y": (1, 1)}, 1: {"x": (1, 1), "y": (2, 2), "z": (1, 2)}, 2: {}}
    left = {(f, t): tuple(a - b for a, b in zip(n, own[f].get(t, (0, 0)))) for f in own for t, n in both.items()}
    assert got == {k: n for k, n in left.items() if n[0]}
