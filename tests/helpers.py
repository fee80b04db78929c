"""Plain reimplementations on small data, to compare results with."""

import math
from collections import Counter

import numpy as np


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def tfidf(docs, keep=None):
    """{id: {term: weight}} of {id: [terms]}; ``keep`` limits the vocabulary."""
    df = Counter(t for terms in docs.values() for t in set(terms))
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items() if keep is None or t in keep}
    return {i: unit({t: c * idf[t] for t, c in Counter(terms).items() if t in idf}) for i, terms in docs.items()}, idf


def unit(weights):
    length = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / length for t, w in weights.items()} if length else {}


def dot(a, b):
    return sum(w * b.get(t, 0.0) for t, w in a.items())


def bayes_scores(train, test, alpha=1.0, keep=None):
    """{id: {label: score}} for (label, terms) training rows and {id: terms} test rows."""
    weights, idf = tfidf({i: terms for i, (_, terms) in train.items()}, keep)
    labels = sorted({label for label, _ in train.values()})
    sums = {c: Counter() for c in labels}
    for i, (label, _) in train.items():
        for t, w in weights[i].items():
            sums[label][t] += w
    out = {}
    for i, terms in test.items():
        w = unit({t: c * idf[t] for t, c in Counter(terms).items() if t in idf})
        out[i] = {}
        for c in labels:
            total = sum(sums[c].values()) + alpha * len(idf)
            prior = math.log(sum(1 for label, _ in train.values() if label == c) / len(train))
            out[i][c] = prior + sum(x * math.log((sums[c][t] + alpha) / total) for t, x in w.items())
    return out


def auc(positive_scores, negative_scores):
    wins = sum((p > n) + 0.5 * (p == n) for p in positive_scores for n in negative_scores)
    return wins / (len(positive_scores) * len(negative_scores))


def random_docs(seed, n, vocabulary=40, longest=12):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(vocabulary)]
    share = 1 / np.arange(1, vocabulary + 1)
    share /= share.sum()
    return {i: list(rng.choice(words, size=rng.integers(0, longest), p=share)) for i in range(n)}
