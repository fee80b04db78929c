"""Two-dimensional views of a TF-IDF corpus, and its vectors for the ML library."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.operators.blocks import Blocks, blocks
from forumlens.operators.tfidf import VocabularyRule, corpus_size, fit_vocabulary, term_counts
from forumlens.session import stage

# Directions that are iterated together: the two wanted ones and more, which make these converge sooner.
DIRECTIONS = 8
ROUNDS = 40
# Relative change of the two leading values at which the iteration ends.
TOLERANCE = 1e-12
#: Posts whose weights one task multiplies together.
BLOCK_POSTS = 16384


def tfidf_vectors(docs: DataFrame, rule: VocabularyRule) -> tuple[DataFrame, list[str]]:
    """Sparse unit vectors ``features`` over the vocabulary of a topic model, and its terms in column order.

    The vocabulary (``max_features`` at most) is all that reaches the driver. The vectors are
    staged, since fitting reads them many times.
    """
    if rule.max_features is None:
        raise ValueError("a topic model needs max_features")
    vocabulary = fit_vocabulary(term_counts(docs), corpus_size(docs), rule)
    rows = vocabulary.select("term", "idf").orderBy("term").collect()
    names = [r["term"] for r in rows]
    counted = CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="counts").transform(docs)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="counts",
                                outputCol="scaled").transform(counted)
    unit = Normalizer(p=2.0, inputCol="scaled", outputCol="features").transform(scaled)
    return stage(unit.drop("counts", "scaled")), names


def _columns(prefix: str) -> list[str]:
    return [f"{prefix}{j}" for j in range(DIRECTIONS)]


def _turned(rows: DataFrame, key: str, matrix: np.ndarray, prefix: str = "v") -> DataFrame:
    """Rows times a small matrix."""
    def column(j: int) -> Column:
        return sum((F.col(f"{prefix}{i}") * float(matrix[i, j]) for i in range(DIRECTIONS)), F.lit(0.0)).alias(f"v{j}")

    return rows.select(key, *(column(j) for j in range(matrix.shape[1])))


def _products(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """The small matrix of inner products between columns ``left`` and ``right``."""
    sums = [F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for a in _columns(left) for b in _columns(right)]
    return np.array(rows.agg(*(s.alias(f"p{i}") for i, s in enumerate(sums))).first()).reshape(DIRECTIONS, DIRECTIONS)


def _axes(n_docs: int, weights: DataFrame, matrix: Blocks, centred: bool) -> DataFrame:
    """The two leading directions (term, v0, v1) of all posts, by block power iteration on the whole vocabulary.

    A round multiplies the directions by the weights and by their transpose inside blocks of posts, and adds up what blocks have for a term;
    only inner products of the few directions reach the driver. Means are subtracted from the product, never from the
    sparse rows. The start depends on the terms alone, so the result is the same on any cluster. An axis is only
    defined up to its sign: the one that makes its largest entry positive is taken.
    """
    start = [((F.pmod(F.xxhash64("term", F.lit(j)), F.lit(1 << 20)) + 0.5) / float(1 << 20) - 0.5).alias(f"v{j}")
             for j in range(DIRECTIONS)]
    totals = stage(weights.groupBy("term").agg(F.sum("w").alias("total")))
    current = stage(totals.select("term", *start))
    current = stage(_turned(current, "term", _inverse_root(_products(current, "v", "v"))))
    before = None
    for _ in range(ROUNDS):
        back = matrix.times_and_back(current).toDF("term", *_columns("a"))
        both = back.join(current, "term").join(totals, "term")
        if centred:  # the sum of a direction's scores over all posts is its product with the totals of the terms
            means = current.join(totals, "term").agg(*(F.sum(F.col(v) * F.col("total")).alias(v) for v in _columns("v"))).first()
            both = both.withColumns({f"a{j}": F.col(f"a{j}") - F.col("total") * float((means[j] or 0.0) / n_docs)
                                     for j in range(DIRECTIONS)})
        both = stage(both.drop("total"))
        values, rotation = np.linalg.eigh(_symmetric(_products(both, "v", "a")))
        rotation, leading = rotation[:, ::-1], values[::-1][:2]
        if before is not None and np.all(abs(leading - before) <= TOLERANCE * max(abs(leading).max(), 1e-300)):
            break
        before = leading
        current = stage(_turned(both, "term", _inverse_root(_products(both, "a", "a")), "a"))
    axes = stage(_turned(both, "term", rotation[:, :2]))
    largest = axes.agg(*(F.max_by(v, F.struct(F.round(F.abs(v), 9), "term")).alias(v) for v in ("v0", "v1"))).first()
    signs = [-1.0 if (x or 0.0) < 0 else 1.0 for x in largest]
    return axes.select("term", *((F.col(v) * s).alias(v) for v, s in zip(("v0", "v1"), signs)))


def _symmetric(matrix: np.ndarray) -> np.ndarray:
    return (matrix + matrix.T) / 2


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    """What makes directions with these inner products orthonormal; directions that have vanished become 0."""
    values, vectors = np.linalg.eigh(_symmetric(gram))
    scale = np.where(values > 1e-13 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return vectors * scale


def _project(docs: DataFrame, weights: DataFrame, names: tuple[str, str], centred: bool) -> DataFrame:
    n_docs = max(docs.count(), 1)
    matrix = blocks(weights, "id", "term", "w", -(-n_docs // BLOCK_POSTS))
    xy = stage(matrix.times(_axes(n_docs, weights, matrix, centred)).toDF("id", "v0", "v1"))
    matrix.drop()
    columns = [F.coalesce(F.col(v), F.lit(0.0)).alias(n) for v, n in zip(("v0", "v1"), names)]
    return docs.join(xy, "id", "left").select(*docs.columns, *columns)


def pca_2d(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """First two principal components of posts, centred: the columns of ``docs`` (id, ...) and pc1, pc2.

    ``weights`` (id, term, w) is a staged table over the whole vocabulary; a post without terms is the zero vector.
    """
    xy = stage(_project(docs, weights, ("pc1", "pc2"), centred=True))
    centre = xy.agg(F.struct(F.avg("pc1").alias("a"), F.avg("pc2").alias("b"))).scalar()
    return xy.select(*docs.columns, (F.col("pc1") - centre["a"]).alias("pc1"), (F.col("pc2") - centre["b"]).alias("pc2"))


def svd_2d(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """Projection on the two leading right singular vectors, not centred: the columns of ``docs`` and sv1, sv2."""
    return _project(docs, weights, ("sv1", "sv2"), centred=False)
