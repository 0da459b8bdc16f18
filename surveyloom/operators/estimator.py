"""The text classifier as a stage of a ``pyspark.ml`` pipeline: an estimator with parameters, a model that scores row by row, and both written and read back.

Any other classifier follows the same protocol by being a ``pyspark.ml`` estimator itself: a pipeline fits, scores, saves and loads them alike.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.operators.classify import MAX_FEATURES, TextModel, predict_by_join, predict_rows, train_classifier


class _Columns(HasInputCol, HasPredictionCol, HasProbabilityCol):
    """Columns both stages know: the text, the predicted class, its confidence and all classes' probabilities."""

    confidenceCol = Param(Params._dummy(), "confidenceCol", "column of the predicted class's probability", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "unique key of a row; asked for only where weights are too large to broadcast", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(inputCol="text_processed", predictionCol="pred", confidenceCol="conf", probabilityCol="probabilities", keyCol="survey_id")


class TextClassifier(_Columns, HasLabelCol, HasMaxIter, HasTol, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Penalised multinomial logistic regression on TF-IDF of words or characters. Rows without a label are left out of the fit."""

    family = Param(Params._dummy(), "family", f"kind of terms, one of {sorted(MAX_FEATURES)}", TypeConverters.toString)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms kept, the most frequent; 0 for the family's own number", TypeConverters.toInt)
    inversePenalty = Param(Params._dummy(), "inversePenalty", "C: the larger, the weaker the penalty", TypeConverters.toFloat)
    balanced = Param(Params._dummy(), "balanced", "whether classes weigh alike", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol="text_processed",
        labelCol="label",
        predictionCol="pred",
        confidenceCol="conf",
        probabilityCol="probabilities",
        keyCol="survey_id",
        family="tfidf",
        maxFeatures=0,
        inversePenalty=1.0,
        balanced=True,
        maxIter=1000,
        tol=1e-3,
    ):
        super().__init__()
        self._defaults()
        self._setDefault(labelCol="label", family="tfidf", maxFeatures=0, inversePenalty=1.0, balanced=True, maxIter=1000, tol=1e-3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TextClassifierModel:
        of = self.getOrDefault
        label, text = of("labelCol"), of("inputCol")
        fitted = train_classifier(
            dataset.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string")),
            label,
            label,
            of("family"),
            of("keyCol"),
            text,
            max_features=of("maxFeatures") or None,
            C=of("inversePenalty"),
            max_iter=of("maxIter"),
            tol=of("tol"),
            balanced=of("balanced"),
        )
        return self._copyValues(TextClassifierModel(fitted))


class TextClassifierModel(_Columns, Model, MLReadable, MLWritable):
    """Scores texts with a :class:`TextModel`; without a shuffle, and on streaming frames too, while its weights may be broadcast."""

    def __init__(self, model: TextModel | None = None):
        super().__init__()
        self._defaults()
        self.text_model = model

    def setParams(self, **columns: str) -> TextClassifierModel:
        """Rename the columns it reads and writes."""
        return self._set(**columns)

    @property
    def classes(self) -> list[str]:
        return self.text_model.classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        of = self.getOrDefault
        names = {of("predictionCol"): "pred", of("confidenceCol"): "conf", of("probabilityCol"): "probabilities"}
        taken = set(names) & set(dataset.columns)
        if taken:
            raise ValueError(f"columns exist already: {sorted(taken)}")
        model, key = self.text_model, of("keyCol")
        text = "_text_of_row"
        local = TextModel(**{**model.__dict__, "text_column": text})
        if model.table() is not None:
            found = predict_rows(local, dataset.select(F.struct("*").alias("_all"), F.col(of("inputCol")).alias(text)))
            return found.select("_all.*", *[F.col(c).alias(n) for n, c in names.items()])
        found = predict_by_join(local, dataset.withColumn(text, F.col(of("inputCol"))), key)
        return dataset.join(found.select(key, *[F.col(c).alias(n) for n, c in names.items()]), key, "left")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: TextClassifierModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.text_model.save(f"{path}/model")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TextClassifierModel:
        spark: SparkSession = self.sparkSession
        about = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.kind(TextModel.load(spark, f"{path}/model"))
        stage._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(stage, about)
        return stage
