"""The linear baseline: multinomial logistic regression over standardised features, fold by fold."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators import folds as folding
from tidebook.sources import shared

RETURNS_ONLY = ("ret_1s_bp", "ret_5s_bp", "ret_30s_bp", "rv_30s_bp")


def fit_predict(rows: DataFrame, columns: list[str], label: str = "y", keep: list[str] | None = None, max_iter: int = 100) -> DataFrame:
    """fold, frame columns, y, p and the confidence of the test rows of every fold.

    rows: fold, role, label and features.  Features are standardised by the fold's training rows, classes are
    weighted by n / (3 * count); the fit runs to its optimum, so no early stopping can see the test block.
    """
    keep = keep or ["frame_id"]
    path = shared.new_folder(rows.sparkSession)
    rows.write.parquet(path)  # every fold reads its rows several times
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    ready = folding.standardised(rows, columns)
    weights = rows.where("role = 'train'").groupBy("fold", label).agg(F.count("*").alias("_n"))
    total = weights.groupBy("fold").agg(F.sum("_n").alias("_total"))
    weights = weights.join(total, "fold").select("fold", label, (F.col("_total") / (3 * F.col("_n"))).alias("_w"))
    ready = VectorAssembler(inputCols=columns, outputCol="x").transform(ready.join(F.broadcast(weights), ["fold", label], "left").na.fill(1.0, ["_w"]))
    out = None
    for fold in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):  # a handful of folds
        part = ready.where(F.col("fold") == fold)
        model = LogisticRegression(featuresCol="x", labelCol=label, weightCol="_w", family="multinomial", standardization=False, regParam=0.0, maxIter=max_iter).fit(part.where("role = 'train'"))
        scored = model.transform(part.where("role = 'test'")).withColumn("_c", vector_to_array("probability"))
        mine = scored.select("fold", *keep, F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"), F.array_max("_c").alias("confidence"))
        out = mine if out is None else out.unionByName(mine)
    return out
