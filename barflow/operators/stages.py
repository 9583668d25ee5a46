"""A training run's own steps as Spark ML stages, so that a run is one ``PipelineModel``.

``SymbolScaler`` (estimator) learns the minimum and maximum of every column for each
symbol and gives a ``SymbolScalerModel``; ``LagWindow`` (transformer) builds the lag
samples. With the regressors behind them they are stored and loaded as one pipeline,
which takes raw feature rows and returns every model's prediction.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import dataset as ds
from barflow.sources.store import cut_lineage


class _Columns(Params):
    """The columns that a stage scales or windows."""

    columns = Param(Params._dummy(), "columns", "input columns, in the order of the sample vector", TypeConverters.toListString)

    def getColumns(self) -> list[str]:
        return self.getOrDefault(self.columns)


class SymbolScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Per-symbol min-max scaling; fits on the first ``TRAIN_SPLIT`` of a symbol's rows, or on all."""

    fitOn = Param(Params._dummy(), "fitOn", "'train' or 'all'", TypeConverters.toString)

    def __init__(self, columns: list[str] | None = None, fitOn: str = "train"):
        super().__init__()
        self._set(fitOn=fitOn)
        if columns is not None:
            self._set(columns=list(columns))

    def _fit(self, dataset: DataFrame) -> "SymbolScalerModel":
        rows = ds.renumber(dataset.select("symbol", "date", *self.getColumns()))
        stats = cut_lineage(ds.fit_minmax(rows, self.getColumns(), fit_on=self.getOrDefault(self.fitOn)), "scaler")
        return SymbolScalerModel(self.getColumns(), stats)


class SymbolScalerModel(Model, _Columns, MLReadable, MLWritable):
    """Adds ``<column>_s`` for every column; ``stats`` has one row a symbol."""

    def __init__(self, columns: list[str] | None = None, stats: DataFrame | None = None):
        super().__init__()
        if columns is not None:
            self._set(columns=list(columns))
        self.stats = stats

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return ds.apply_minmax(dataset, self.stats, self.getColumns())

    def write(self) -> MLWriter:
        return _ScalerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ScalerReader(cls)


class _ScalerWriter(MLWriter):
    def __init__(self, model: SymbolScalerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.stats.write.parquet(f"{path}/stats")


class _ScalerReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SymbolScalerModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(stats=spark.read.parquet(f"{path}/stats"))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class LagWindow(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Scaled rows -> lag samples ``symbol, date, idx, n_samples, split, features, label``.

    With ``labelled`` false the samples are every row that ends a full window, dated by
    that row, without label: what a stored run scores when new bars arrive. The windows
    are built as the samples are read; only the rows are written."""

    target = Param(Params._dummy(), "target", "column to predict", TypeConverters.toString)
    lookback = Param(Params._dummy(), "lookback", "rows of a window", TypeConverters.toInt)
    horizon = Param(Params._dummy(), "horizon", "rows from the window to the label", TypeConverters.toInt)
    labelled = Param(Params._dummy(), "labelled", "only samples whose label is known", TypeConverters.toBoolean)

    def __init__(self, columns: list[str] | None = None, target: str = "close", lookback: int = ds.LOOKBACK, horizon: int = ds.HORIZON,
                 labelled: bool = True):
        super().__init__()
        self._set(target=target, lookback=lookback, horizon=horizon, labelled=labelled)
        if columns is not None:
            self._set(columns=list(columns))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.getOrDefault
        scaled = [c + "_s" for c in self.getColumns()]
        target = p(self.target) + "_s"
        laid = ds.renumber(dataset.select("symbol", "date", *dict.fromkeys([*scaled, target])))
        if p(self.labelled):
            s = ds.split_samples(ds.sequences(laid, scaled, target, p(self.lookback), p(self.horizon)))
        else:
            s = ds.latest_windows(laid, scaled, p(self.lookback)).withColumn("split", F.lit("future"))
        return ds.flatten_window(s).select("symbol", "date", "idx", "n_samples", "split", "features", "label")
