"""Model registries, training run logs and checkpoint inventories as tables.

Epoch logs are long: ``run_id, epoch, metric, value`` (and ``ts`` where time matters).
Versions: ``model, version, created_at`` with metrics in a ``map<string,double>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION_FIELDS = (
    "map<string,map<string,struct<created_at:string,performance:map<string,double>,"
    "description:string,tags:array<string>>>>"
)


def read_registry(spark, path: str) -> DataFrame:
    """Registry JSON (model to version to record) as one row per version; each file holds any number of models."""
    text = spark.read.text(path, wholetext=True)
    models = text.select(F.explode(F.from_json("value", VERSION_FIELDS)).alias("model", "versions"))
    return models.select("model", F.explode("versions").alias("version", "_r")).select(
        "model", "version", F.to_timestamp("_r.created_at").cast("timestamp_ntz").alias("created_at"),
        "_r.performance", "_r.description", "_r.tags",
    )


def read_run_logs(spark, path: str) -> DataFrame:
    """Run JSON files as long epoch logs. A file holds one run (``run_id, status, history[...]``) or an array of runs."""
    text = spark.read.text(path, wholetext=True)
    # An array type also takes a single object.
    runs = F.from_json(
        "value", "array<struct<run_id:string,start_time:string,end_time:string,status:string,history:array<map<string,string>>>>"
    )
    epochs = text.select(F.explode(runs).alias("r")).select("r.run_id", "r.status", F.explode("r.history").alias("h"))
    entries = F.map_filter("h", lambda k, v: ~k.isin("epoch", "timestamp"))
    return epochs.select(
        "run_id",
        "status",
        F.element_at("h", "epoch").cast("int").alias("epoch"),
        F.to_timestamp(F.try_element_at("h", F.lit("timestamp"))).cast("timestamp_ntz").alias("ts"),
        F.explode(entries).alias("metric", "_v"),
    ).select("run_id", "status", "epoch", "ts", "metric", F.expr("try_cast(_v as double)").alias("value")).filter(
        F.col("value").isNotNull()
    )


def run_statistics(logs: DataFrame) -> DataFrame:
    """Final, best, mean and population deviation per run and metric; lower is best for losses only."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return (
        logs.withColumn("_v", v)
        .filter(F.col("_v").isNotNull())
        .groupBy("run_id", "metric")
        .agg(
            F.max_by("_v", "epoch").alias("final"),
            F.when(F.col("metric").contains("loss"), F.min("_v")).otherwise(F.max("_v")).alias("best"),
            F.avg("_v").alias("mean"),
            F.stddev_pop("_v").alias("std"),
        )
    )


def run_durations(logs: DataFrame) -> DataFrame:
    """Duration, epochs and mean epoch time of runs with more than one epoch (needs ``ts``)."""
    per_epoch = logs.groupBy("run_id", "epoch").agg(F.min("ts").alias("ts"))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        per_epoch.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("epochs_completed"),
            ((F.max_by(t, "epoch") - F.min_by(t, "epoch")) / 1e6).alias("duration_seconds"),
        )
        .filter(F.col("epochs_completed") > 1)
        .withColumn("avg_epoch_time", F.col("duration_seconds") / F.col("epochs_completed"))
    )


def last_epochs(logs: DataFrame, n: int, per: list[str]) -> DataFrame:
    """The newest ``n`` rows per group with their position ``age`` (1 is the newest)."""
    w = Window.partitionBy(*per).orderBy(F.desc("epoch"))
    return logs.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def training_summary(logs: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Best epoch, final and best losses, slope of the last ten losses, whether it has settled."""
    loss = F.when(F.col("metric") == "loss", F.col("value"))
    val = F.when(F.col("metric") == "val_loss", F.col("value"))
    totals = logs.groupBy("run_id").agg(
        F.count(loss).alias("total_epochs"),
        F.max_by("value", F.when(loss.isNotNull(), F.col("epoch"))).alias("final_train_loss"),
        F.max_by("value", F.when(val.isNotNull(), F.col("epoch"))).alias("final_val_loss"),
        F.min(val).alias("best_val_loss"),
        F.min_by("epoch", F.when(val.isNotNull(), F.struct("value", "epoch"))).alias("best_epoch"),
    )
    recent = last_epochs(logs.filter("metric = 'loss'"), 10, ["run_id"])
    slope = recent.groupBy(F.col("run_id").alias("_k")).agg(F.regr_slope("value", -F.col("age")).alias("_slope"))
    long_enough = F.col("total_epochs") > 10
    return (
        totals.join(slope, F.col("run_id").eqNullSafe(F.col("_k")), "left")
        .withColumn("loss_trend", F.when(long_enough, F.col("_slope")))
        .withColumn("converged", F.when(long_enough, F.abs("_slope") < tolerance))
        .drop("_k", "_slope")
    )


def training_progress(epochs: DataFrame, total_epochs: int, samples: int) -> DataFrame:
    """Progress, mean time of the last ten epochs, time left and samples per second.

    Input: ``run_id, epoch, seconds``.
    """
    totals = epochs.groupBy("run_id").agg(
        F.max("epoch").alias("current_epoch"),
        F.sum("seconds").alias("total_seconds"),
        F.avg("seconds").alias("_mean"),
    )
    recent = last_epochs(epochs, 10, ["run_id"]).groupBy(F.col("run_id").alias("_k")).agg(
        F.avg("seconds").alias("avg_epoch_time")
    )
    left = F.lit(total_epochs) - F.col("current_epoch")
    return (
        totals.join(recent, F.col("run_id").eqNullSafe(F.col("_k")))
        .withColumns(
            {
                "progress_pct": F.col("current_epoch") * 100.0 / total_epochs,
                "eta_seconds": F.col("avg_epoch_time") * left,
                "samples_per_second": F.try_divide(F.lit(float(samples)), F.col("_mean")),
                "status": F.when(left <= 0, "completed").otherwise("running"),
            }
        )
        .drop("_k", "_mean")
    )


def early_stop_epoch(
    epochs: DataFrame, patience: int = 10, min_delta: float = 0.0, mode: str = "min"
) -> DataFrame:
    """Where each run would stop: ``run_id, stopped_epoch, best_epoch, best_value``.

    Input: ``run_id, epoch, value``. The rule is sequential within a run, so the epochs of a run (one
    number each) are folded in order. A run that never stops has a NULL ``stopped_epoch``.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode must be min or max")
    sign = 1.0 if mode == "min" else -1.0
    value = F.col("value").cast("double") * sign
    steps = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("bigint").alias("epoch"), value.alias("value"))))
    none = F.lit(None).cast("bigint")
    begin = F.struct(F.lit(None).cast("double").alias("best"), none.alias("epoch"), F.lit(0).cast("bigint").alias("wait"), none.alias("stop"))

    def step(state, x):
        better = state["best"].isNull() | (x["value"] < state["best"] - min_delta)
        wait = F.when(better, 0).otherwise(state["wait"] + 1)
        moved = F.struct(
            F.when(better, x["value"]).otherwise(state["best"]).alias("best"),
            F.when(better, x["epoch"]).otherwise(state["epoch"]).alias("epoch"),
            wait.cast("bigint").alias("wait"),
            F.when(~better & (wait >= patience), x["epoch"]).alias("stop"),
        )
        return F.when(state["stop"].isNull(), moved).otherwise(state)

    runs = epochs.filter(F.col("value").isNotNull()).groupBy("run_id").agg(F.aggregate(steps, begin, step).alias("_s"))
    return runs.select(
        "run_id", F.col("_s.stop").alias("stopped_epoch"), F.col("_s.epoch").alias("best_epoch"), (F.col("_s.best") * sign).alias("best_value")
    )


def best_checkpoint(epochs: DataFrame, mode: str = "min") -> DataFrame:
    """Best value and the first epoch that reached it, per run."""
    pick = F.min_by if mode == "min" else F.max_by
    place = F.struct("value", F.col("epoch") if mode == "min" else -F.col("epoch"))
    best = F.min("value") if mode == "min" else F.max("value")
    return epochs.groupBy("run_id").agg(pick("epoch", place).alias("best_epoch"), best.alias("best_value"))


def retain_latest(epochs: DataFrame, keep: int = 5) -> DataFrame:
    """The newest ``keep`` epochs of every run."""
    return last_epochs(epochs, keep, ["run_id"]).drop("age")


def checkpoint_inventory(files: DataFrame) -> DataFrame:
    """Type, run and epoch parsed from checkpoint file names (column ``path``)."""
    name = F.element_at(F.split("path", "/"), -1)
    periodic, best, resume = (
        r"^model_(.+)_epoch_(\d+)\.keras$",
        r"^best_model_(.+)\.keras$",
        r"^resume_(.+)\.keras$",
    )
    kind = F.when(name.rlike(best), "best").when(name.rlike(resume), "resume").when(name.rlike(periodic), "periodic")
    run = (
        F.when(kind == "best", F.regexp_extract(name, best, 1))
        .when(kind == "resume", F.regexp_extract(name, resume, 1))
        .when(kind == "periodic", F.regexp_extract(name, periodic, 1))
    )
    epoch = F.when(kind == "periodic", F.regexp_extract(name, periodic, 2).cast("int"))
    return (
        files.withColumns({"type": kind, "run_id": run, "epoch": epoch}).filter(F.col("type").isNotNull())
    )


def registry_versions(versions: DataFrame) -> DataFrame:
    """Position of each version from the newest, and whether it is the latest."""
    w = Window.partitionBy("model").orderBy(F.desc("created_at"), F.desc("version"))
    return versions.withColumn("age", F.row_number().over(w)).withColumn("is_latest", F.col("age") == 1)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of every model."""
    newest = F.max_by(F.struct(*[c for c in versions.columns if c != "model"]), F.struct("created_at", "version"))
    return versions.groupBy("model").agg(newest.alias("_v")).select("model", "_v.*")


def surplus_versions(versions: DataFrame, max_versions: int = 10) -> DataFrame:
    """Versions beyond the newest ``max_versions`` of their model."""
    return registry_versions(versions).filter(F.col("age") > max_versions)


def version_key(version: Column) -> Column:
    """``1.12.3`` as an array of numbers that sorts naturally."""
    return F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))


def next_version(
    versions: DataFrame, candidates: DataFrame, threshold: float = 0.01, loss: str = "loss"
) -> DataFrame:
    """Semantic version for candidates ``model, loss``.

    Minor bump when the loss improves by more than ``threshold`` on the latest
    version (or cannot be compared), else patch bump; a new model starts at 1.0.0.
    """
    latest = versions.groupBy(F.col("model").alias("_m")).agg(
        F.max_by(F.struct("version", F.try_element_at("performance", F.lit(loss)).alias("loss")), version_key(F.col("version"))).alias("_v")
    )
    joined = candidates.join(latest, F.col("model") == F.col("_m"), "left")
    parts = version_key(F.col("_v.version"))
    gain = F.try_divide(F.col("_v.loss") - F.col("loss"), F.col("_v.loss"))
    better = F.coalesce(gain > threshold, F.lit(True))
    dotted = F.when(better, F.concat_ws(".", parts[0].cast("string"), (parts[1] + 1).cast("string"), F.lit("0"))).otherwise(
        F.concat_ws(".", parts[0].cast("string"), parts[1].cast("string"), (parts[2] + 1).cast("string"))
    )
    return joined.select(
        "model", F.col("_v.version").alias("latest_version"), F.when(F.col("_m").isNull(), "1.0.0").otherwise(dotted).alias("next_version")
    )


def timestamp_version(at: Column, loss: Column | None = None) -> Column:
    """``yyyyMMdd_HHmmss``, led by the loss for performance naming."""
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    return stamp if loss is None else F.concat_ws("_", F.format_string("%.4f", loss), stamp)


def compare_models(metrics: DataFrame, first, second) -> DataFrame:
    """Metric by metric comparison of two versions; input ``version, metric, value``."""
    a = metrics.filter(F.col("version") == F.lit(first)).select("metric", F.col("value").alias("model1"))
    b = metrics.filter(F.col("version") == F.lit(second)).select("metric", F.col("value").alias("model2"))
    change = (F.col("model2") - F.col("model1")) * 100.0
    return a.join(b, "metric", "full_outer").withColumn(
        "improvement_percent",
        F.when(F.col("model1") == 0, F.when(F.col("model2").isNotNull(), 0.0)).otherwise(F.try_divide(change, F.col("model1"))),
    )


def compare_model_info(models: DataFrame, first, second) -> DataFrame:
    """Size and training of two versions: ``section, item, model1, model2``; what is unknown counts as 0.

    Input: ``version, total_parameters, trainable_parameters, epochs_trained, training_duration_seconds``.
    """
    items = (
        ("architecture", "total_parameters"),
        ("architecture", "trainable_parameters"),
        ("training", "epochs_trained"),
        ("training", "training_duration_seconds"),
    )

    def of(version, item: str):
        return F.coalesce(F.max(F.when(F.col("version") == F.lit(version), F.col(item))).cast("double"), F.lit(0.0))

    row = models.agg(*[of(v, item).alias(f"{item}_{k}") for _, item in items for k, v in ((1, first), (2, second))])
    pairs = [
        F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), F.col(f"{item}_1").alias("model1"), F.col(f"{item}_2").alias("model2"))
        for section, item in items
    ]
    return row.select(F.inline(F.array(*pairs)))
