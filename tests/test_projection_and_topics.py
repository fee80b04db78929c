import numpy as np
import pytest

from forumlens.operators import projection, tfidf, topics
from forumlens.plans import pipelines
from forumlens.session import stage
from forumlens.operators.tfidf import VocabularyRule
from tests import helpers


@pytest.fixture(scope="module")
def corpus(spark):
    docs = {i: [str(t) for t in terms] for i, terms in helpers.random_docs(8, 80).items()}
    df = spark.createDataFrame([(i, t, t, "x" if i % 2 else "y") for i, t in docs.items()],
                               "id long, terms array<string>, words array<string>, link_flair_text string")
    vectors, names = projection.tfidf_vectors(df, VocabularyRule(max_features=100))
    weights, _ = helpers.tfidf(docs)
    matrix = np.array([[weights[i].get(t, 0.0) for t in names] for i in sorted(docs)])
    return df, vectors, names, matrix


def signed(axes):
    return axes * np.sign(axes[abs(axes).argmax(axis=0), range(axes.shape[1])])


def test_vectors_are_the_weights(corpus):
    _, vectors, names, matrix = corpus
    got = np.array([r["features"].toArray() for r in vectors.orderBy("id").collect()])
    assert got == pytest.approx(matrix, abs=1e-12)


def weighted(df):
    rows = stage(df)
    return rows.select("id"), stage(tfidf.weights(*pipelines.tfidf_tables(rows)))


def test_principal_components(corpus):
    df, _, _, matrix = corpus
    got = np.array([(r["pc1"], r["pc2"]) for r in projection.pca_2d(*weighted(df)).orderBy("id").collect()])
    centred = matrix - matrix.mean(axis=0)
    axes = signed(np.linalg.svd(centred, full_matrices=False)[2][:2].T)
    assert got == pytest.approx(centred @ axes, abs=1e-6)
    assert got.mean(axis=0) == pytest.approx([0, 0], abs=1e-9) and got[:, 0].var() >= got[:, 1].var()


def test_singular_vectors(corpus):
    df, _, _, matrix = corpus
    got = np.array([(r["sv1"], r["sv2"]) for r in projection.svd_2d(*weighted(df)).orderBy("id").collect()])
    axes = signed(np.linalg.svd(matrix, full_matrices=False)[2][:2].T)
    assert got == pytest.approx(matrix @ axes, abs=1e-6)


def test_topics_need_a_vocabulary_size(corpus):
    with pytest.raises(ValueError):
        projection.tfidf_vectors(corpus[0], VocabularyRule())


def test_topics(corpus):
    df, vectors, names, _ = corpus
    model = topics.fit_topics(vectors)
    words = topics.top_words(model, names)
    got = words.collect()
    assert len(got) == 10 and {r["rank"] for r in got} == {1, 2, 3, 4, 5} and {r["term"] for r in got} <= set(names)
    again = topics.top_words(topics.fit_topics(vectors), names).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    shares = topics.topic_of_posts(model, vectors).collect()
    assert len(shares) == 80 and all(sum(r["topics"]) == pytest.approx(1) or sum(r["topics"]) == 0 for r in shares)
    named = {r["topic"]: r for r in topics.name_topics(words, df).collect()}
    assert set(named) == {0, 1}
    for r in named.values():
        assert r["tag"] == topics.tag_for_term(df, r["term"]).first()["link_flair_text"]


def test_topics_tell_two_vocabularies_apart(spark):
    docs = [(i, [f"{'ab'[i % 2]}{k}" for k in range(8)] * 3) for i in range(40)]
    df = spark.createDataFrame(docs, "id long, terms array<string>")
    vectors, _ = projection.tfidf_vectors(df, VocabularyRule(max_features=50))
    shares = {r["id"]: r["topics"] for r in topics.topic_of_posts(topics.fit_topics(vectors), vectors).collect()}
    side = {i: int(x[0] > x[1]) for i, x in shares.items()}
    assert all(side[i] == side[i % 2] for i in side) and side[0] != side[1]


def test_tag_for_term(spark):
    docs = spark.createDataFrame([(["cells", "x"], "Bio"), (["cell"], "Bio"), (["cell"], "Env"), (["sea"], "Env")],
                                 "words array<string>, link_flair_text string")
    assert topics.tag_for_term(docs, "cell").first()["link_flair_text"] == "Bio"
