"""Sentiment and issue for a table of reviews, and the text-to-vector stage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.terms import HashedTerms
from opinara.functions.vectors import DenseWeights, review_scorer
from opinara.operators.clustering import tag_issues
from opinara.operators.curation import id_difference


def score_reviews(
    reviews: DataFrame, weights: DenseWeights, centroids: DataFrame, features: str = "features"
) -> DataFrame:
    """Sentiment, margin, probabilities and, for negatives, the issue, for centroid tables of any size."""
    scorer = review_scorer(reviews.sparkSession, weights)
    scored = reviews.withColumn("_score", scorer(F.col(features)))
    complaint = F.when(F.col("_score.sentiment") == "negative", F.col(features))
    tagged = tag_issues(scored.withColumn("_complaint", complaint), centroids, "_complaint")
    issue = [F.col(name) for name in ("cluster_id", "issue_tag", "issue_distance", "cluster_source")]
    return tagged.select(*[F.col(c) for c in reviews.columns], "_score.*", *issue)


def hashed_terms(text: str, width: int) -> HashedTerms:
    return HashedTerms().setInputCol(text).setOutputCol("_tf").setNumFeatures(width)


def with_terms(docs: DataFrame, text: str = "text", width: int = 256) -> DataFrame:
    """Adds the term counts that ``text_vectoriser`` and ``vectorise`` take from a table where it has them."""
    filled = docs.withColumn("_filled", F.coalesce(F.col(text), F.lit("")))
    return hashed_terms("_filled", width).transform(filled).drop("_filled")


def text_vectoriser(docs: DataFrame, text: str = "text", width: int = 256, out: str = "vector") -> PipelineModel:
    """Hashed TF-IDF, L2-normalised: the stand-in where no encoder vectors are at hand."""
    stages = [
        hashed_terms(text, width),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol=out, p=2.0),
    ]
    return Pipeline(stages=stages).fit(docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))))


def vectorise(docs: DataFrame, model: PipelineModel, text: str = "text", out: str = "features") -> DataFrame:
    ready = docs.withColumn("_raw", F.col(text)).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    made = model.transform(ready)
    return made.select(
        *[F.col("_raw").alias(c) if c == text else F.col(c) for c in docs.columns],
        vector_to_array("vector", "float32").alias(out),
    )


def with_encoder(docs: DataFrame, encoder: Callable[[Column], Column], text: str = "text", out: str = "features") -> DataFrame:
    """Any column function text -> array<float>, such as an Arrow UDF around a sentence encoder."""
    return docs.withColumn(out, encoder(F.col(text)))


def with_vectors(docs: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join stored vectors by id; also returns the ids that have none."""
    return docs.join(vectors, "id"), id_difference(docs, vectors)


def fixed_weights(dim: int, hidden: tuple[int, ...] = (256, 128), classes: int = 3) -> DenseWeights:
    """Untrained weights by formula, for load tests and examples; default widths are the production ones."""
    layers = []
    sizes = [dim, *hidden, classes]
    for layer, (rows, columns) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        i, j = np.indices((rows, columns))
        weight = (((i + 1) * (7 + 2 * layer) + (j + 1) * 13) % 17 - 8) / 17.0
        layers.append((weight, (np.arange(columns) % 5 - 2) / 10.0))
    return DenseWeights(tuple(layers))
