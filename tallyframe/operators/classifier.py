"""A trained text categoriser as one persistable ML pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StringIndexer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.filters import not_null
from tallyframe.functions.text import normalize_text
from tallyframe.operators.categorize import is_uncategorized, tfidf_vocabulary
from tallyframe.session import materialize

MIN_EXAMPLES = 10
MAX_FEATURES = 5000
_WORK = ["_words", "_pairs", "_terms", "_counts", "_scaled", "_features",
         "_rawPrediction", "_probability", "_label"]


def holdout(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds ``is_validation`` for a fifth of the rows, decided by a hash of the id, so that a lost
    and recomputed partition splits the same way."""
    return df.withColumn("is_validation", F.pmod(F.xxhash64(id_col), F.lit(5)) == 0)


def feature_stages(vocabulary: list) -> list:
    """Stages from a lower-case ``_text`` to ``_features``, the normalised weights of its terms.
    ``vocabulary`` has rows with ``term`` and ``idf``."""
    return [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(
            [r.term for r in vocabulary], inputCol="_terms", outputCol="_counts"
        ),
        ElementwiseProduct(
            inputCol="_counts", outputCol="_scaled",
            scalingVec=Vectors.dense([r.idf for r in vocabulary]),
        ),
        Normalizer(p=2.0, inputCol="_scaled", outputCol="_features"),
    ]


def train_categorizer(
    df: DataFrame, id_col: str = "id", split: str | None = None
) -> tuple[PipelineModel, float]:
    """Multinomial naive Bayes over word weights; returns the model and its validation accuracy.

    Examples with the same text and label are counted first and enter as one weighted row, so the
    passes of the fit run over distinct texts, written out once, instead of over all
    transactions. ``split`` names a boolean column that marks the rows held out for validation; without
    one, a hash of the id decides.
    """
    known = not_null(df, "description", "category")
    marked = holdout(known, id_col) if split is None else known.withColumn(
        "is_validation", F.coalesce(split, F.lit(False)))
    examples = (
        marked
        .withColumn("_text", normalize_text(F.col("description")))
        .groupBy("_text", "category", "is_validation")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    examples = materialize(examples)
    total = examples.agg(F.sum("weight")).first()[0] or 0
    if total < MIN_EXAMPLES:
        raise ValueError(f"Need at least {MIN_EXAMPLES} examples to train a model")
    train = examples.filter(~F.col("is_validation"))
    # At most MAX_FEATURES rows reach the driver: the model itself.
    vocabulary = tfidf_vocabulary(train, "_text", MAX_FEATURES, weight="weight").collect()
    if not vocabulary:
        raise ValueError("No usable words in the training descriptions")
    stages = feature_stages(vocabulary)
    labels = StringIndexer(
        inputCol="category", outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(examples)
    features = PipelineModel(stages)
    bayes = NaiveBayes(
        modelType="multinomial", smoothing=1.0, featuresCol="_features", labelCol="_label",
        weightCol="weight", predictionCol="_index", rawPredictionCol="_rawPrediction",
        probabilityCol="_probability",
    ).fit(features.transform(labels.transform(train)))
    back = IndexToString(inputCol="_index", outputCol="prediction", labels=labels.labels)
    model = PipelineModel([*stages, bayes, back])
    checked = model.transform(examples.filter("is_validation"))
    right = F.sum(F.when(F.col("prediction") == F.col("category"), F.col("weight")).otherwise(0.0))
    accuracy = checked.agg(F.try_divide(right, F.sum("weight"))).first()[0]
    return model, accuracy if accuracy is not None else 0.0


def predict_categories(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Adds ``prediction``; the text is normalised here as it was for training."""
    if model is None:
        raise RuntimeError("Model has not been trained yet")
    text = df.withColumn("_text", normalize_text(F.col("description")))
    return model.transform(text).drop("_text", "_index", *_WORK)


def categorize_table(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Overwrite the category of every row; a missing description counts as empty text."""
    filled = df.withColumn("description", F.coalesce("description", F.lit("")))
    return predict_categories(model, filled).withColumn("category", F.col("prediction")).drop(
        "prediction"
    )


def categorize_missing(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Predict only null and empty categories; ``was_predicted`` marks those rows, so their number
    is one ``sum`` away."""
    missing = F.coalesce(is_uncategorized(), F.lit(False))
    return (
        predict_categories(model, df)
        .withColumn("was_predicted", missing)
        .withColumn("category", F.when(missing, F.col("prediction")).otherwise(F.col("category")))
        .drop("prediction")
    )


def save_categorizer(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_categorizer(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
