"""What all detectors share: fit on a DataFrame, then predict adds a score column."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import vectors as V

Model = Callable[[DataFrame], DataFrame]

#: Rows of a parameter table (a class mean's entry, a weight) that the driver takes; beyond it the fit raises.
PARAMETER_ROWS = 20_000_000
#: Classes whose labels the driver takes.
CLASSES = 1_000_000


class RequiresFittingException(Exception):
    """A detector was asked to predict before it was fitted."""

    def __init__(self, msg: str = "fit the detector first") -> None:
        super().__init__(msg)


class ModelNotSetException(ValueError):
    """A detector without a model was given raw inputs."""

    def __init__(self, msg: str = "this detector has no model; use the *_features methods") -> None:
        super().__init__(msg)


class Detector:
    """``model`` adds the columns that the detector reads (logits, features) to a DataFrame of raw inputs.

    ``fit`` and ``predict`` push rows through the model first; ``fit_features`` and ``predict_features`` expect its
    columns. Fits read known rows (label of 0 and above) only. Errors are raised when the plan is built.
    """

    needs_fit = False

    def __init__(self, model: Model | None = None, *, features: str = "features", logits: str = "logits", label: str = "label", score: str = "score") -> None:
        self.model, self.features, self.logits, self.label, self.score = model, features, logits, label, score
        self.fitted = not self.needs_fit

    def _modelled(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ModelNotSetException()
        return self.model(df)

    def _known(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.label) >= 0)

    def fit(self, df: DataFrame) -> Detector:
        return self.fit_features(self._modelled(df)) if self.needs_fit else self

    def fit_features(self, df: DataFrame) -> Detector:
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        return self.predict_features(self._modelled(df))

    __call__ = predict

    def _check_fitted(self) -> None:
        if not self.fitted:
            raise RequiresFittingException(f"fit {type(self).__name__} first")

    def score_column(self) -> Column:
        """The score as one expression over the model's columns, for detectors that have one."""
        raise NotImplementedError

    def predict_features(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        return df.withColumn(self.score, self.score_column())


def extracted_features(df: DataFrame, model: Model, *, features: str = "features", label: str = "label", average: bool = False) -> DataFrame:
    """(embedding, label) of the known rows: ``model``'s feature maps flattened, or their mean a channel with ``average``.

    ``features`` is an array of numbers, which stays as it is, or an array of channels.
    """
    d = model(df.where(F.col(label) >= 0))
    kind = d.schema[features].dataType
    nested = isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)
    if average and not nested:
        raise ValueError("means need an array of channels")
    shaped = V.channel_means(features) if average else V.flattened(features) if nested else F.col(features)
    return d.select(shaped.cast("array<double>").alias("embedding"), F.col(label).alias("label"))


def parameter_rows(df: DataFrame, limit: int = PARAMETER_ROWS) -> dict[str, np.ndarray]:
    """A small table of fitted parameters as numpy columns; raises beyond ``limit`` rows instead of filling the driver."""
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        raise ValueError(f"more than {limit} parameters")
    return {name: table[name].to_numpy() for name in table.column_names}


def known_classes(df: DataFrame, label: str, limit: int = CLASSES) -> list[int]:
    """The distinct labels of ``df``; raises beyond ``limit`` of them."""
    found = [r[0] for r in df.select(label).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} classes")
    return found
