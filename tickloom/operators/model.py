"""Direction model: two boosted-tree classifiers, one for up and one for down."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import clean
from tickloom.functions.symbols import strip_contract
from tickloom.operators.features import DIRECTION_FEATURES, bar_features, direction_labels, flow_features

THRESHOLDS = (0.55, 0.60, 0.65)
SYMBOL_BUCKETS = 32


def training_table(bars: DataFrame, horizon: int = 30, threshold: float = 0.0005, cross_day: bool = False) -> DataFrame:
    """Features (missing ones 0) and label of every bar that has a label."""
    d = flow_features(bar_features(bars, cross_day=cross_day), cross_day=cross_day)
    d = direction_labels(d, horizon, threshold, cross_day)
    return d.select("symbol", "date", "ts_sec", F.col("label").cast("int").alias("label"),
                    *[clean(c, 0.0).alias(c) for c in DIRECTION_FEATURES])


def enough_moves(table: DataFrame, min_rows: int = 200) -> DataFrame:
    """Rows of symbols with at least ``min_rows`` non-flat labels."""
    n = table.groupBy("symbol").agg(F.sum((F.col("label") != 0).cast("int")).alias("_n")).where(F.col("_n") >= min_rows)
    return table.join(n.select("symbol"), "symbol", "left_semi")


def with_bucket(table: DataFrame) -> DataFrame:
    """The symbol as one of a fixed number of buckets: nothing that grows with the symbols reaches the driver."""
    return table.withColumn("symbol_bucket", F.pmod(F.xxhash64("symbol"), F.lit(SYMBOL_BUCKETS)).cast("double"))


def train(table: DataFrame, max_iter: int = 20, max_depth: int = 5, seed: int = 42) -> tuple[PipelineModel, PipelineModel]:
    """Models for up and down moves, fitted on the non-flat rows of all symbols together."""
    moves = table.where("label <> 0").withColumns({
        "is_up": (F.col("label") == 1).cast("double"), "is_down": (F.col("label") == -1).cast("double")})
    moves = with_bucket(moves)
    wide = VectorAssembler(inputCols=[*DIRECTION_FEATURES, "symbol_bucket"], outputCol="features")

    def fit(target):
        gbt = GBTClassifier(labelCol=target, featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                            maxBins=SYMBOL_BUCKETS, stepSize=0.1, subsamplingRate=0.8, seed=seed)
        return Pipeline(stages=[wide, gbt]).fit(moves)

    return fit("is_up"), fit("is_down")


def predict(table: DataFrame, up: PipelineModel, down: PipelineModel) -> DataFrame:
    drop = ("features", "rawPrediction", "probability", "prediction")
    d = up.transform(with_bucket(table)).withColumn("p_up", vector_to_array("probability")[1]).drop(*drop)
    return down.transform(d).withColumn("p_down", vector_to_array("probability")[1]).drop(*drop, "symbol_bucket")


def evaluate(scored: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Accuracy and number of confident calls per symbol and threshold."""
    d = scored.select("symbol", "label", "p_up", "p_down", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    call = F.when(F.col("p_down") > F.col("threshold"), -1).when(F.col("p_up") > F.col("threshold"), 1).otherwise(0)
    d = d.withColumn("call", call)
    sure = (F.col("label") != 0) & (F.col("call") != 0)
    return d.groupBy("symbol", "threshold").agg(
        F.coalesce(F.avg(F.when(sure, (F.col("call") == F.col("label")).cast("int"))), F.lit(0.5)).alias("accuracy"),
        F.count(F.when(sure, 1)).alias("n_signals"), F.avg((F.col("call") != 0).cast("int")).alias("signal_rate"),
        F.count(F.lit(1)).alias("n_rows"))


def verdicts(evaluation: DataFrame, min_signals: int = 500) -> DataFrame:
    """Best threshold per symbol: the lowest one unless a higher one is more accurate on enough signals."""
    low = evaluation.groupBy("symbol").agg(F.min_by("accuracy", "threshold").alias("_a0"), F.min("threshold").alias("_t0"))
    d = evaluation.join(low, "symbol")
    ok = (F.col("threshold") == F.col("_t0")) | ((F.col("accuracy") > F.col("_a0")) & (F.col("n_signals") >= min_signals))
    w = Window.partitionBy("symbol").orderBy(F.desc("accuracy"), "threshold")
    d = d.where(ok).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    a = F.col("accuracy")
    return d.select("symbol", F.col("threshold").alias("best_threshold"), a.alias("best_accuracy"), "n_signals", "n_rows",
                    F.when(a > 0.57, "STRONG").when(a > 0.53, "USEFUL").otherwise("WEAK").alias("verdict"))


def thresholds_for(symbols: DataFrame, verdicts: DataFrame, default: float = 0.60) -> DataFrame:
    """(symbol, threshold, model_symbol) of every symbol: its own verdict, else the one of a contract with its base.

    Of several contracts with the base, the one with the most rows counts, then the first by name; symbols without
    any get ``default``. ``verdicts`` is the stored result of ``verdicts``.
    """
    v = verdicts.select(F.col("symbol").alias("model_symbol"), F.col("best_threshold").alias("threshold"), "n_rows",
                        strip_contract("symbol").alias("_base"))
    best = v.groupBy("_base").agg(F.min_by(F.struct("model_symbol", "threshold"), F.struct(-F.col("n_rows"), "model_symbol")).alias("_b"))
    own = v.select(F.col("model_symbol").alias("symbol"), F.col("threshold").alias("_t"))
    d = symbols.select("symbol").distinct().withColumn("_base", strip_contract("symbol")).join(own, "symbol", "left").join(best, "_base", "left")
    return d.select("symbol", F.coalesce("_t", "_b.threshold", F.lit(default)).alias("threshold"),
                    F.when(F.col("_t").isNotNull(), F.col("symbol")).otherwise(F.col("_b.model_symbol")).alias("model_symbol"))


def top_features(up: PipelineModel, down: PipelineModel, n: int = 5) -> list[tuple[str, float]]:
    """Features by mean importance over both models."""
    a, b = (m.stages[-1].featureImportances.toArray() for m in (up, down))
    names = [*DIRECTION_FEATURES, "symbol"]
    return sorted(zip(names, ((a + b) / 2).tolist()), key=lambda x: -x[1])[:n]

