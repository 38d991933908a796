"""Text features: TF-IDF and sentence vectors."""

from __future__ import annotations

import functools
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incident_signals import fixed_values as fixed

# Models that run inside tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A run of word characters is taken whole, so nothing needs to be said about its ends.
_WORDS = r"(?U)\w\w+"
FEATURES = "features"


def assert_no_truth(columns: list[str]) -> None:
    """Truth columns must never become features."""
    leaked = [c for c in columns if c in fixed.FORBIDDEN_FEATURE_COLUMNS]
    if leaked:
        raise ValueError(f"truth columns among the features: {leaked}")


def drop_truth(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in fixed.FORBIDDEN_FEATURE_COLUMNS if c in df.columns])


class TfidfFeatures:
    """Words and word pairs, smooth inverse document frequency plus one, unit length; fitted on training text only."""

    def __init__(self, text: str = "description_clean", model: PipelineModel | None = None):
        self.text = text
        self.model = model

    def fit(
        self, df: DataFrame, max_features: int = fixed.TFIDF_MAX_FEATURES, min_df: float = fixed.TFIDF_MIN_DF,
        max_df: float = fixed.TFIDF_MAX_DF,
    ) -> TfidfFeatures:
        # a share of 1.0 means no limit; CountVectorizer would read it as one report
        most = float(2**62) if isinstance(max_df, float) and max_df >= 1.0 else float(max_df)
        if most < 1.0:
            # for a share CountVectorizer would keep all terms in memory to count the reports; below one report it is still a share
            reports = df.count()
            most = most * reports if most * reports >= 1.0 else most
        terms = Pipeline(stages=[
            RegexTokenizer(inputCol=self.text, outputCol="_tokens", pattern=_WORDS, gaps=False, toLowercase=True),
            NGram(n=2, inputCol="_tokens", outputCol="_pairs"),
            SQLTransformer(statement="SELECT *, concat(_tokens, _pairs) AS _terms FROM __THIS__"),
            CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=max_features, minDF=min_df, maxDF=most),
        ]).fit(df)
        idf = IDF(inputCol="_counts", outputCol="_weighted").fit(terms.transform(df))
        weights = Vectors.dense(np.asarray(idf.idf.toArray()) + 1.0)
        rest = [
            ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol="_weighted"),
            Normalizer(p=2.0, inputCol="_weighted", outputCol=FEATURES),
            SQLTransformer(statement="SELECT * EXCEPT (_tokens, _pairs, _terms, _counts, _weighted) FROM __THIS__"),
        ]
        self.model = PipelineModel(stages=[*terms.stages, *rest])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("the features have not been fitted")
        return self.model.transform(df)

    @property
    def vocabulary(self) -> list[str]:
        return self.model.stages[3].vocabulary

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError("there are no fitted features to save")
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> TfidfFeatures:
        model = PipelineModel.load(path)
        return cls(model.stages[0].getInputCol(), model)


# An embedder has embed(df, text, output), which adds vectors of unit length for a text
# column, and factory, which makes a model with encode(list of str) for use inside tasks.


class HashedWords:
    """A model for use inside tasks: counts of words by hash."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in re.findall(r"\b\w\w+\b", text.lower()):
                row[zlib.crc32(word.encode()) % self.dimension] += 1
        return out


class HashingEmbedder:
    """Sentence vectors without a model: hashed word counts of unit length, all in the JVM."""

    def __init__(self, dimension: int = fixed.EMBEDDING_DIMENSION):
        self.dimension = dimension
        self.factory = functools.partial(HashedWords, dimension)

    def embed(self, df: DataFrame, text: str, output: str = "embedding") -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=_WORDS, gaps=False, toLowercase=True)
        hashed = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=self.dimension)
        unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit")
        done = unit.transform(hashed.transform(words.transform(df)))
        return done.withColumn(output, vector_to_array("_unit")).drop("_tokens", "_counts", "_unit")


class ModelEmbedder:
    """Sentence vectors of a caller's model, in Arrow batches.

    ``factory`` is called once per task and returns an object with
    ``encode(list of str)``; vectors are brought to unit length.  Blank texts are
    an error, or with ``blank_as_zero`` have a vector of zeros.
    """

    def __init__(self, factory: Callable, batch_size: int = fixed.EMBEDDING_BATCH, blank_as_zero: bool = False):
        self.factory = factory
        self.batch_size = batch_size
        self.blank_as_zero = blank_as_zero

    def embed(self, df: DataFrame, text: str, output: str = "embedding") -> DataFrame:
        factory, size, zero = self.factory, self.batch_size, self.blank_as_zero

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for texts in batches:
                blank = texts.isna() | (texts.str.strip() == "")
                if zero:
                    texts = texts.where(~blank, "-")
                elif blank.any():
                    raise ValueError("a text without words cannot be embedded")
                rows: list = []
                for start in range(0, len(texts), size):
                    vectors = np.asarray(model.encode(texts.iloc[start : start + size].tolist()), dtype="float32")
                    length = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors[blank.to_numpy()[start : start + size]] = 0
                    rows.extend((vectors / np.where(length > 0, length, 1)).tolist())
                yield pd.Series(rows)

        return df.withColumn(output, encode(F.col(text)))


class EmbeddingFeatures:
    """An embedder in the role of fitted features."""

    def __init__(self, embedder, text: str = "description_clean"):
        self.embedder, self.text = embedder, text

    def fit(self, df: DataFrame) -> EmbeddingFeatures:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        embedded = self.embedder.embed(df, self.text, "_embedding")
        vector = array_to_vector(F.col("_embedding").cast("array<double>"))
        return embedded.withColumn(FEATURES, vector).drop("_embedding")
