"""The classifier as a pyspark.ml estimator and model."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from alignspark.operators import training
from alignspark.operators.scoring import Parameters, from_json, score, to_json
from alignspark.spec import FeatureSpec, StateMachine


class _Shared(Params):
    viterbi = Param(Params._dummy(), "viterbi", "score by the best alignment instead of all", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(viterbi=False)


class PairClassifier(_Shared, Estimator):
    """Fits labelled pairs (s1, s2, label).  Features, machine and optimiser are Python objects, set by keyword."""

    l2 = Param(Params._dummy(), "l2", "weight of the squared parameters", TypeConverters.toFloat)
    iterations = Param(Params._dummy(), "iterations", "iterations of the default optimiser at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, spec: FeatureSpec | None = None, l2: float = 0.0, viterbi: bool = False, iterations: int = 200, machine: StateMachine | None = None, optimizer=None, optimizer_kwargs: dict | None = None) -> None:
        super().__init__()
        self.spec, self.machine, self.optimizer, self.optimizer_kwargs = spec or FeatureSpec(match=True, numeric=True), machine, optimizer, optimizer_kwargs
        self._setDefault(l2=0.0, iterations=200)
        self._set(l2=l2, viterbi=viterbi, iterations=iterations)

    def set_params(self, **params) -> PairClassifier:
        """Set what is given; what isn't stays."""
        for name, value in params.items():
            if self.hasParam(name):
                self._set(**{name: value})
            elif name in ("spec", "machine", "optimizer", "optimizer_kwargs"):
                setattr(self, name, value)
            else:
                raise ValueError(f"no parameter {name}")
        return self

    def get_params(self) -> dict:
        out = {p.name: self.getOrDefault(p) for p in self.params}
        return out | {n: getattr(self, n) for n in ("spec", "machine", "optimizer", "optimizer_kwargs")}

    def _fit(self, dataset: DataFrame) -> PairClassifierModel:
        parameters, history = training.fit(dataset, self.spec, self.getOrDefault(self.l2), self.machine, self.optimizer, self.optimizer_kwargs, iterations=self.getOrDefault(self.iterations))
        return PairClassifierModel(parameters, self.getOrDefault(self.viterbi), history)


class PairClassifierModel(_Shared, Model, MLWritable, MLReadable):
    """Adds probability and prediction to pairs (pair_id, s1, s2); other columns stay."""

    def __init__(self, parameters: Parameters, viterbi: bool = False, history: list[float] | None = None) -> None:
        super().__init__()
        self.parameters, self.history = parameters, history or []
        self._set(viterbi=viterbi)

    @property
    def classes(self) -> list:
        return self.parameters.machine.classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """dataset's columns with probability and prediction, which replace columns of these names."""
        keep = [c for c in dataset.columns if c not in ("pair_id", "probability", "prediction")]
        return score(dataset, self.parameters, self.getOrDefault(self.viterbi), keep)

    def write(self) -> _Writer:
        """As other models, so a fitted Pipeline that holds this one can be saved."""
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader()


class _Writer(MLWriter):
    """theta as Parquet (row, k, value); features and machine in the metadata."""

    def __init__(self, model: PairClassifierModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"model": to_json(self.model.parameters)})
        self.model.parameters.table(self.sparkSession).coalesce(1).write.parquet(f"{path}/theta")


class _Reader(MLReader):
    def load(self, path: str) -> PairClassifierModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/theta").toPandas()
        theta = np.zeros((rows["row"].max() + 1, rows["k"].max() + 1))
        theta[rows["row"], rows["k"]] = rows["value"]
        model = PairClassifierModel(from_json(meta["model"], theta))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
