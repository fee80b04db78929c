import pytest
from pyspark.sql import functions as F

from forumlens.operators import relevance, tfidf
from forumlens.session import stage
from tests.helpers import dot, random_docs, unit
from tests.helpers import tfidf as plain_tfidf


def search(spark, docs, texts, k):
    df = stage(spark.createDataFrame(list(docs.items()), "id long, terms array<string>"))
    postings = tfidf.term_counts(df)
    vocabulary = stage(tfidf.fit_vocabulary(postings, tfidf.corpus_size(df)))
    weights = stage(tfidf.weights(postings, vocabulary))
    asked = spark.createDataFrame(list(texts.items()), "id string, terms array<string>")
    queries = stage(relevance.query_weights(asked, stage(relevance.bounded_vocabulary(weights, vocabulary))))
    return queries, weights, relevance.most_relevant(queries, weights, k)


def brute(docs, texts, k):
    weights, idf = plain_tfidf(docs)
    out = []
    for name, terms in texts.items():
        q = unit({t: terms.count(t) * idf[t] for t in set(terms) if t in idf})
        scored = sorted((-round(dot(q, w), 6), i) for i, w in weights.items() if set(q) & set(w))[:k]
        out += [(name, i, -s, n + 1) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("first, trials", [(200, 4), (1, 1)])
def test_equals_the_unbounded_ranking(spark, monkeypatch, first, trials):
    monkeypatch.setattr(relevance, "FIRST_POSTINGS", first)
    monkeypatch.setattr(relevance, "TRIALS", trials)
    docs = random_docs(3, 400, vocabulary=60, longest=15)
    texts = {f"q{i}": terms for i, terms in random_docs(4, 25, vocabulary=60, longest=12).items()}
    texts |= {"none": [], "unknown": ["zz"], "rare": ["wch"], "twice": docs[5] * 2, "tie": ["waa"]}
    _, _, found = search(spark, docs, texts, 7)
    got = sorted(map(tuple, found.collect()))
    want = brute(docs, texts, 7)
    assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def test_fewer_postings_are_read(spark):
    docs = random_docs(5, 3000, vocabulary=200, longest=25)
    docs |= {5000 + i: [f"t{i}{k}" for k in range(6)] + ["waa", "wab", "wac"] for i in range(20) for _ in range(3)}
    docs |= {6000 + i: [f"t{i % 20}{k}" for k in range(6)] + ["waa"] for i in range(300)}
    texts = {f"q{i}": [f"t{i}{k}" for k in range(6)] + ["waa", "wab", "wac", "wad", "wae"] for i in range(20)}
    queries, weights, found = search(spark, docs, texts, 10)
    least = stage(relevance.thresholds(queries, weights, 10))
    read = relevance.essential_terms(queries, least).join(weights, "term").count()
    every = queries.join(weights, "term").count()
    assert least.count() == 20 and read < every / 4
    assert found.where("rank = 1").count() == 20


def test_no_posts_or_no_texts(spark):
    _, _, found = search(spark, {1: ["a"]}, {}, 3)
    assert found.collect() == []
    _, _, found = search(spark, {}, {"q": ["a"]}, 3)
    assert found.collect() == [] and found.select(F.max("rank")).first()[0] is None
