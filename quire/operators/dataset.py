"""Training data for number recognition: labels, samples, weights, split, model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import ranks

CORNERS = ["top_left", "top_right", "bottom_left", "bottom_right"]


def label_tokens(labels: DataFrame) -> DataFrame:
    """Labels to character classes, one row per character. Needs sample_id, label."""
    chars = F.when(F.lower("label") == "blank", F.array(F.lit("blank"))).otherwise(
        F.filter(F.split("label", ""), lambda c: (c != "") & (c != " ")))
    rows = labels.select("sample_id", "label", F.posexplode(chars).alias("char_no", "_c"))
    c = F.col("_c")
    kind = (F.when(c == "blank", "blank").when(c.rlike("^[0-9]$"), F.concat(F.lit("digit_"), c))
            .when(c.rlike(r"^\p{L}$"), F.concat(F.lit("letter_"), F.lower(c)))
            .when(c == "-", "separator_dash").when(c == "_", "separator_underscore")
            .when(c == ".", "separator_period").otherwise(F.concat(F.lit("char_"), c)))
    return rows.select("sample_id", "label", "char_no", kind.alias("char_class"))


def class_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("class_label")).agg(F.count("*").alias("samples"))


def class_distribution(samples: DataFrame, keep: int = 20) -> DataFrame:
    return class_counts(samples, "class_label").orderBy(F.desc("samples"), "class_label").limit(keep)


def label_statistics(labels: DataFrame) -> DataFrame:
    """Processed, labelled and skipped samples and the number of different labels."""
    named = F.trim("label") != ""
    return labels.agg(F.count("*").alias("processed"), F.count_if(named).alias("labelled"),
                      F.count_if(~F.coalesce(named, F.lit(False))).alias("skipped"),
                      F.count_distinct(F.when(named, F.col("label"))).alias("unique_labels"))


def dataset_issues(samples: DataFrame, minimum: int = 10, total: int = 500) -> DataFrame:
    """What is wrong with a training set, one row per issue."""
    counts = class_counts(samples, "class_label")
    few = counts.where((F.col("samples") < minimum) & (F.col("class_label") != "none")).select(
        F.format_string(f"Class '%s' has only %d samples (need {minimum}+)", "class_label", "samples").alias("issue"))
    whole = counts.agg(F.max("samples").alias("hi"), F.min("samples").alias("lo"), F.sum("samples").alias("n"))
    other = whole.select(F.explode(F.array_compact(F.array(
        F.when(F.col("hi") > 10 * F.col("lo"), F.format_string("Class imbalance: max=%d, min=%d", "hi", "lo")),
        F.when(F.col("n") < total, F.format_string("Only %d images (recommend 1000+)", "n"))))).alias("issue"))
    return few.unionByName(other)


def class_weights(samples: DataFrame) -> DataFrame:
    """Balanced weight of each class: total / (classes * count)."""
    counts = class_counts(samples, "class_label")
    whole = counts.agg(F.sum("samples").alias("n"), F.count("*").alias("k"))
    n, k = whole.select("n").scalar(), whole.select("k").scalar()
    return counts.withColumn("weight", n / (k * F.col("samples")))


def training_samples(detections: DataFrame) -> DataFrame:
    """A row per corner of each page: the best corner with its label, the others as ``none``.

    ``detections``: page_id, corner, label, confidence; one row per corner.
    """
    best = detections.where(F.col("label").isNotNull()).groupBy("page_id").agg(
        F.min_by("corner", F.struct(-F.col("confidence"), "corner")).alias("_best"))
    rows = detections.join(best, "page_id", "left")
    positive = F.coalesce(F.col("corner") == F.col("_best"), F.lit(False))
    return rows.select("page_id", "corner", F.when(positive, F.lower("label")).otherwise("none").alias("class_label"),
                       F.when(positive, F.col("confidence")).otherwise(0.0).alias("confidence"))


def stratified_split(samples: DataFrame, key: str, label: str, seed: int = 42, wide: bool | None = None) -> DataFrame:
    """Adds ``part``: 80 % of each label to 'train' by hash order; the same rows on every run."""
    wide = ranks.settle_width(samples, [label], wide)
    rows = ranks.with_totals(samples, [label], {"_n": F.count(F.lit(1))}, key, wide)
    rows = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    rows = ranks.number_rows(rows, [label], ["_h", key], "_r", wide)
    train = (F.col("_r") <= F.ceil(F.col("_n") * 0.8)) | (F.col("_n") == 1)
    return rows.withColumn("part", F.when(train, "train").otherwise("test")).drop("_n", "_h", "_r")


def train_classifier(train: DataFrame, features: str = "features", label: str = "label") -> PipelineModel:
    """Weighted multinomial classifier on feature arrays. Iterations run over the training part in Spark."""
    weights = class_weights(train.withColumnRenamed(label, "class_label")).select(
        F.col("class_label").alias(label), "weight")
    rows = train.join(weights, label).withColumn("vector", array_to_vector(F.col(features)))
    steps = Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
        LogisticRegression(featuresCol="vector", labelCol="label_index", weightCol="weight", maxIter=20)])
    return steps.fit(rows)


def predict(model: PipelineModel, samples: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``probabilities`` (array in the order of the model's labels)."""
    rows = model.transform(samples.withColumn("vector", array_to_vector(F.col(features))))
    return rows.withColumn("probabilities", vector_to_array("probability")).drop(
        "vector", "rawPrediction", "probability", "label_index")


def model_facts(model: PipelineModel, test: DataFrame, features: str = "features") -> DataFrame:
    """Classes and accuracy of a model, as one row to keep beside it."""
    scored = model.transform(test.withColumn("vector", array_to_vector(F.col(features))))
    accuracy = MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy").evaluate(scored)
    classes = list(model.stages[0].labels)
    return test.sparkSession.createDataFrame([(classes, len(classes), accuracy)], "classes array<string>, num_classes int, accuracy double")


def predicted_label(classes: list[str]) -> Column:
    place = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), place)
