"""Preparation, training and evaluation of classifiers on a feature table (author, y, features)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.records import numbered

THRESHOLDS = tuple(round(0.1 + 0.05 * i, 2) for i in range(17))


def clip(rows: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Infinities and NaN become null, values are drawn into each column's quantiles over all rows; nulls stay."""
    clean = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double")) for c in columns}
    rows = rows.select(*[c for c in rows.columns if c not in columns], *[clean[c].alias(c) for c in columns])
    q = rows.agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(c) for c in columns]).first()
    return rows.select(*[F.least(F.greatest(F.col(c), F.lit(q[c][0])), F.lit(q[c][1])).alias(c) if c in columns and q[c] else F.col(c) for c in rows.columns]) if q else rows


def _order(key: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]


def stratified_split(rows: DataFrame, key: str = "author", parts: tuple[float, float] = (0.7, 0.15), seed: int = 42) -> DataFrame:
    """rows with split: train, validation or test, in the given parts of each class (test the rest), by order of hash. Rows
    without a class are one of their own."""
    placed, sizes = _placed(rows, key, seed)
    at = lambda x: x.cast("double")
    many = F.lit(0)
    for y, n in sizes.items():
        many = F.when(F.col("y_") == y, n).otherwise(many)
    split = F.when(F.col("place") <= F.round(at(many) * parts[0]), "train").when(F.col("place") <= F.round(at(many) * (parts[0] + parts[1])), "validation").otherwise("test")
    return placed.withColumn("split", split).drop("place", "y_")


def _placed(rows: DataFrame, key: str, seed: int) -> tuple[DataFrame, dict]:
    """rows with place, from 1 in each class y_ (y as a text) in the order of hash, found by ranges of the hash; and the classes'
    sizes, of which there are as many as classes."""
    named = rows.withColumn("y_", F.coalesce(F.col("y").cast("string"), F.lit("")))
    sizes = {r["y_"]: r["n"] for r in named.groupBy("y_").agg(F.count(F.lit(1)).alias("n")).collect()}
    return numbered(named, _order(key, seed), within=("y_",)), sizes


def balanced_split(rows: DataFrame, per_class: int, test_share: float = 0.1, key: str = "author", seed: int = 42) -> DataFrame:
    """rows with split: of each class up to per_class to train (equal numbers); of the others a test with test_share of class 1 as
    far as numbers allow; the rest is unused."""
    placed, sizes = _placed(rows.withColumn("y", F.col("y").cast("int")), key, seed)
    counts = {int(y): n for y, n in sizes.items() if y}
    take = min([per_class, *[counts.get(y, 0) * 4 // 5 for y in (0, 1)]])
    left1, left0 = counts.get(1, 0) - take, counts.get(0, 0) - take
    test1 = min(left1, int(left0 * test_share / (1 - test_share)))
    test0 = min(left0, round(test1 * (1 - test_share) / test_share)) if test1 else left0
    upto = F.when(F.col("y") == 1, take + test1).when(F.col("y") == 0, take + test0).otherwise(0)
    return placed.withColumn("split", F.when(F.col("y").isin(0, 1) & (F.col("place") <= take), "train").when(F.col("place") <= upto, "test").otherwise("unused")).drop("place", "y_")


def impute(rows: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """Nulls become the column's exact median over the rows for which fit_on holds (0 if that has none)."""
    q = rows.where(fit_on).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    return rows.select(*[F.coalesce(c, F.lit(float(q[c] or 0.0))).alias(c) if c in columns else F.col(c) for c in rows.columns])


def standardize(rows: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """Mean 0 and population deviation 1 over the rows for which fit_on holds; a constant column becomes 0."""
    s = rows.where(fit_on).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return rows.select(*[((F.col(c) - F.lit(s[c]["m"])) / F.lit(s[c]["s"] or 1.0)).alias(c) if c in columns and s[c]["m"] is not None else F.col(c) for c in rows.columns])


def models(features: int, seed: int = 42, rounds: int = 500) -> dict:
    """The classifiers by name; the second boosting stands for another library's and differs in depth. Boosting stops once the
    validation part gains no more."""
    common = {"labelCol": "y", "featuresCol": "features", "seed": seed}
    early = {"validationIndicatorCol": "validation_", "validationTol": 0.001}
    return {
        "boosting": GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=5, **early, **common),
        "boosting_deep": GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=7, **early, **common),
        "forest": RandomForestClassifier(numTrees=rounds, **common),
        "perceptron": MultilayerPerceptronClassifier(layers=[features, 128, 64, 32, 2], **common),
    }


def train(rows: DataFrame, columns: list[str], model) -> tuple[object, DataFrame]:
    """The model fitted on the split train, and (key columns, y, split, score) for all rows."""
    put = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(rows.withColumn("y", F.col("y").cast("double")))
    if model.hasParam("validationIndicatorCol") and model.isSet("validationIndicatorCol"):
        fitted = model.fit(put.where("split IN ('train', 'validation')").withColumn(model.getOrDefault("validationIndicatorCol"), F.col("split") == "validation"))
    else:
        fitted = model.fit(put.where("split = 'train'"))
    scored = fitted.transform(put).withColumn("score", vector_to_array("probability")[1])
    return fitted, scored.select("author", F.col("y").cast("int").alias("y"), "split", "score")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def threshold_sweep(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) for each threshold, from one pass."""
    hit = lambda t: F.col("score") >= t
    each = [F.struct(F.lit(t).alias("threshold"), F.count_if(hit(t) & (F.col("y") == 1)).alias("tp"), F.count_if(hit(t) & (F.col("y") == 0)).alias("fp"), F.count_if(~hit(t) & (F.col("y") == 1)).alias("fn"), F.count_if(~hit(t) & (F.col("y") == 0)).alias("tn")) for t in thresholds]
    rows = scored.where("score IS NOT NULL AND y IS NOT NULL").agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(sweep: DataFrame, least_precision: float = 0.9, otherwise: float = 0.5) -> float:
    """The least threshold of the best F1 among those precise enough."""
    r = sweep.where(F.col("precision") >= least_precision).orderBy(F.desc("f1"), "threshold").first()
    return r["threshold"] if r else otherwise


def _levels(scored: DataFrame) -> DataFrame:
    """(score, pos, neg, tp, fp): per different score its numbers, and those at or above it."""
    by = scored.where("score IS NOT NULL AND y IS NOT NULL").groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    down = numbered(by, [F.desc("score")], "pos").withColumnRenamed("upto", "tp").drop("place")
    return numbered(down, [F.desc("score")], "neg").withColumnRenamed("upto", "fp").drop("place")


def curve_points(scored: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr, precision): the points of the ROC and precision-recall curves, one per different score."""
    levels = _levels(scored)
    total = levels.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = levels.crossJoin(F.broadcast(total))  # one row
    return rows.select(F.col("score").alias("threshold"), _ratio(F.col("tp"), F.col("p")).alias("tpr"), _ratio(F.col("fp"), F.col("n")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: roc_auc by ranks (ties count half), pr_auc as average precision, and at the threshold f1, precision, recall,
    kappa, false positive and false negative rate and the confusion counts."""
    area = _levels(scored).crossJoin(F.broadcast(_levels(scored).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))))  # one row
    area = area.agg(F.max("p").alias("p"), F.max("n").alias("n"), F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2.0)).alias("won"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    at = threshold_sweep(scored, (threshold,))
    both = at.crossJoin(F.broadcast(area))  # one row
    total = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("double")
    seen = (F.col("tp") + F.col("tn")) / total
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (total * total)
    return both.select("threshold", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("roc_auc"), _ratio(F.col("ap"), F.col("p")).alias("pr_auc"), "precision", "recall", "f1", F.when(chance < 1, (seen - chance) / (1 - chance)).otherwise(0.0).alias("kappa"), _ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), _ratio(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"), "tp", "fp", "fn", "tn")


def tree_importance(fitted, columns: list[str], spark, least: float = 0.01) -> DataFrame:
    """(feature, importance, droppable): a tree model's own importances; a feature below `least` of the greatest is droppable."""
    values = [float(v) for v in fitted.featureImportances.toArray()]
    top = max(values, default=0.0)
    return spark.createDataFrame([(c, v, v < least * top) for c, v in zip(columns, values)], "feature string, importance double, droppable boolean")


def permutation_importance(rows: DataFrame, columns: list[str], model, repeats: int = 3, seed: int = 42) -> DataFrame:
    """(feature, importance): the mean loss of ROC area when a column's values are exchanged between rows, for each column."""
    put = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")

    def area(df: DataFrame) -> float:
        scored = model.transform(put.transform(df.withColumn("y", F.col("y").cast("double")))).withColumn("score", vector_to_array("probability")[1])
        return metrics(scored.select(F.col("y").cast("int").alias("y"), "score"), 0.5).first()["roc_auc"] or 0.0

    base = area(rows)
    out = []
    for c in columns:
        lost = 0.0
        for r in range(repeats):
            place = numbered(rows, _order("author", seed)).withColumnRenamed("place", "i_")
            drawn = numbered(rows.select("author", F.col(c).alias("v_")), _order("author", seed + r + 1)).select(F.col("place").alias("i_"), "v_")
            lost += base - area(place.join(drawn, "i_").drop(c).withColumnRenamed("v_", c).drop("i_"))
        out.append((c, lost / repeats))
    return rows.sparkSession.createDataFrame(out, "feature string, importance double")


def pseudo_labels(scored: DataFrame, tested: DataFrame, sure: float = 0.95) -> DataFrame:
    """(author, y): confident predictions as labels, without authors of the test."""
    picked = scored.where((F.col("score") > sure) | (F.col("score") < 1 - sure)).select("author", (F.col("score") > sure).cast("int").alias("y"))
    return picked.join(tested.select("author").distinct(), "author", "left_anti")
