"""Species-level predictions, regression metrics, taxonomy baselines, and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .order import matched, medians, medians_of, ranked_by
from .selection import small


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null for constant or single values."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def species_predictions(rows: DataFrame, species: str, label: str, pred: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per species the label, mean and sample sd of the predictions and their number; ``keep`` columns by minimum."""
    return rows.groupBy(species).agg(
        *(F.min(c).alias(c) for c in keep),
        F.min(label).alias(label),
        F.avg(pred).alias("pred"),
        F.stddev_samp(pred).alias("pred_sd"),
        F.count("*").alias("n_inputs"),
    )


def finite(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows``; raises if a column has a null or a value that is not finite."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]
    found = rows.agg(*bad).first().asDict()
    if any(found.values()):
        raise ValueError(f"values that are not finite: {found}")
    return rows


def species_metrics(species: DataFrame, label: str, pred: str = "pred", group: Sequence[str] = ()) -> DataFrame:
    """Species MAE in logarithms and in years, Pearson in years, Spearman; null where undefined.

    Ranks come from a distributed order of the different values; null labels or predictions have none. The rows of
    species, read for the order and again for the ranks, are written once.
    """
    keys = list(group)
    work = Workspace(species.sparkSession, "metrics")
    ranked = ranked_by(work.cut(species.select(*keys, label, pred)), keys, {label: "_x", pred: "_y"}, work)
    years, guess = F.pow(F.lit(10.0), F.col(label)), F.pow(F.lit(10.0), F.col(pred))
    out = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_species"),
        F.avg(F.abs(F.col(pred) - F.col(label))).alias("mae_log10"),
        F.avg(F.abs(guess - years)).alias("mae_years"),
        correlation(F.col(label), F.col(pred)).alias("pearson"),
        correlation(years, guess).alias("pearson_years"),
        correlation(F.col("_x"), F.col("_y")).alias("spearman"),
        F.stddev_samp(label).alias("label_sd"),
        F.stddev_samp(pred).alias("pred_sd"),
    )
    return out


def class_breakdown(species: DataFrame, class_: str, label: str, pred: str, bases: Sequence[str]) -> DataFrame:
    """``species_metrics`` of each class, and the mean absolute error of every baseline column as ``<column>_mae``.

    Spearman is null for classes of at most two species.
    """
    out = species_metrics(species, label, pred, [class_])
    out = out.withColumn("spearman", F.when(F.col("n_species") > 2, F.col("spearman")))
    errors = [F.avg(F.abs(F.col(b) - F.col(label))).alias(f"{b}_mae") for b in bases]
    by = species.groupBy(F.col(class_).alias("_c")).agg(*errors)
    return out.join(small(by), out[class_].eqNullSafe(by["_c"]), "left").drop("_c")


def retrieval_metrics(hits: DataFrame, own: DataFrame, *, query: str = "query", key: str = "key") -> DataFrame:
    """One row: share of queries that find themselves first, or at all, and whose first hit is of their species or genus.

    ``hits(query, key, rank, species, genus)`` with the hit's names, ``own(query, species, genus)`` with the query's.
    Over a gallery that pools several splits the last two are the pooled scores.
    """
    names = own.select(query, F.col("species").alias("_s"), F.col("genus").alias("_g"))
    each = hits.join(names, query).groupBy(query).agg(
        *(
            F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n)
            for n, c in {
                "specimen_top1": (F.col("rank") == 1) & (F.col(key) == F.col(query)),
                "specimen_topk": F.col(key) == F.col(query),
                "species_top1": (F.col("rank") == 1) & (F.col("species") == F.col("_s")),
                "genus_top1": (F.col("rank") == 1) & (F.col("genus") == F.col("_g")),
            }.items()
        )
    )
    scores = ("specimen_top1", "specimen_topk", "species_top1", "genus_top1")
    return each.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in scores))


def pair_metrics(rows: DataFrame, label: str, pred: str, mean: float, sd: float) -> DataFrame:
    """Mean squared error of normalised labels and mean absolute error over all rows."""
    return rows.agg(
        F.count("*").alias("n_pairs"),
        F.avg(F.pow((F.col(pred) - F.col(label)) / sd, 2)).alias("pair_mse_z"),
        F.avg(F.abs(F.col(pred) - F.col(label))).alias("pair_mae_log10"),
    )


def target_normalisation(rows: DataFrame, species: str, label: str) -> DataFrame:
    """Mean and sample sd over one label per species; sd 1 for a single species or a constant label."""
    one = rows.groupBy(species).agg(F.min(label).alias("_y"))
    sd = F.stddev_samp("_y")
    return one.agg(F.avg("_y").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"), F.count("*").alias("n_species"))


def baselines(train: DataFrame, test: DataFrame, label: str, ranks: Sequence[str]) -> DataFrame:
    """``test`` species with ``base``: the training mean of the finest rank that has one, else of all; ``base_rank`` names it."""
    out = test
    for r in ranks:
        means = train.where(F.col(r).isNotNull()).groupBy(r).agg(F.avg(label).alias(f"_{r}"))
        out = out.join(small(means), r, "left")
    overall = train.agg(F.avg(label).alias("_all"))
    out = out.crossJoin(F.broadcast(overall))  # one row
    found = F.coalesce(*(F.col(f"_{r}") for r in ranks), "_all")
    named = F.coalesce(*(F.when(F.col(f"_{r}").isNotNull(), r) for r in ranks), F.lit("all"))
    return out.select(*(test[c] for c in test.columns), found.alias("base"), named.alias("base_rank"))


def baseline_metrics(species: DataFrame, label: str) -> DataFrame:
    return species.groupBy("base_rank").agg(F.count("*").alias("n_species"), F.avg(F.abs(F.col("base") - F.col(label))).alias("mae_log10"))


def split_report(rows: DataFrame, split: str, species: str, family: str, class_: str) -> DataFrame:
    """Per split: species, pairs, families, species per class as a map, and the sorted species."""
    one = rows.groupBy(split, species).agg(F.min(family).alias("_f"), F.min(class_).alias("_c"), F.count("*").alias("_n"))
    classes = one.groupBy(split, F.coalesce("_c", F.lit("null")).alias("_c")).agg(F.count("*").alias("_k"))
    maps = classes.groupBy(split).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_c", "_k")))).alias("classes"))
    out = one.groupBy(split).agg(
        F.count("*").alias("n_species"),
        F.sum("_n").alias("n_pairs"),
        F.count_distinct("_f").alias("n_families"),
        F.sort_array(F.collect_list(species)).alias("species"),
    )
    return out.join(maps, split)


def gene_report(rows: DataFrame, species: str, values: Sequence[str]) -> DataFrame:
    """Genes per species and exact medians, picked by rank out of distributed counts of values."""
    out = rows.groupBy(species).agg(F.count("*").alias("n_genes"))
    return matched(out, medians_of(rows, [species], {v: f"median_{v}" for v in values}), [species], "left") if values else out


# ---------------------------------------------------------------- logs


def best_record(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Per run the record with the least value (the first of equals), and the last record."""
    known = log.where(F.col(value).isNotNull())
    return known.groupBy(run).agg(
        F.min_by(F.struct(step, value), F.struct(value, step)).alias("_best"),
        F.max_by(F.struct(step, value), F.col(step)).alias("_last"),
        F.count("*").alias("n_records"),
    ).select(
        run,
        F.col(f"_best.{step}").alias("best_step"),
        F.col(f"_best.{value}").alias("best_value"),
        F.col(f"_last.{step}").alias("last_step"),
        F.col(f"_last.{value}").alias("last_value"),
        "n_records",
    )


def run_summary(log: DataFrame, run: str, step: str, loss: str, speed: str) -> DataFrame:
    """First, last and least loss, the exact median speed and the number of records of each run."""
    out = log.groupBy(run).agg(
        F.min_by(loss, step).alias("first_loss"),
        F.max_by(loss, step).alias("last_loss"),
        F.min(loss).alias("min_loss"),
        F.count("*").alias("n_records"),
    )
    return matched(out, medians(log, [run], speed, "median_speed"), [run], "left")


def loss_at(log: DataFrame, run: str, step: str, loss: str, marks: DataFrame, elapsed: str | None = None) -> DataFrame:
    """Per run of ``marks(run, at)`` the loss of the record whose step is nearest to ``at`` (the earlier of two) and,
    if there is such a column, the time elapsed at the last record."""
    joined = log.join(small(marks.select(run, F.col("at").alias("_at"))), run)
    near = F.min_by(F.struct(F.col(step).alias("step"), F.col(loss).alias("loss")), F.struct(F.abs(F.col(step) - F.col("_at")), F.col(step)))
    more = [F.max_by(elapsed, step).alias("elapsed")] if elapsed else []
    out = joined.groupBy(run).agg(near.alias("_n"), *more)
    return out.select(run, F.col("_n.step").alias("nearest_step"), F.col("_n.loss").alias("loss_at"), *(["elapsed"] if elapsed else []))


def differing_runs(settings: DataFrame, run: str, pairs: DataFrame) -> DataFrame:
    """Settings in which two runs that are compared differ: ``pairs(left, right)``, ``settings(run, path, value)``."""
    a = settings.select(F.col(run).alias("left"), "path", F.col("value").alias("a"))
    b = settings.select(F.col(run).alias("right"), "path", F.col("value").alias("b"))
    left = pairs.select("left", "right").join(a, "left")
    right = pairs.select("left", "right").join(b, "right")
    both = left.join(right, ["left", "right", "path"], "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("left", "right", "path", "a", "b")


def incomplete_runs(log: DataFrame, run: str, planned: DataFrame) -> DataFrame:
    """Runs of ``planned(run, step)`` without exactly one ``done`` record at the planned step."""
    done = log.where("kind = 'done'").groupBy(run).agg(F.count("*").alias("n_done"), F.max("step").alias("done_step"))
    both = planned.withColumnRenamed("step", "planned_step").join(done, run, "left").fillna({"n_done": 0})
    return both.where((F.col("n_done") != 1) | ~F.col("done_step").eqNullSafe(F.col("planned_step")))


def rolling_mean(log: DataFrame, run: str, order: Sequence[str], value: str, width: int) -> DataFrame:
    """Centred mean over ``width`` records (fewer at the ends) as ``rolling``."""
    half = width // 2
    return log.withColumn("rolling", F.avg(value).over(Window.partitionBy(run).orderBy(*order).rowsBetween(-half, half)))


def new_minima(log: DataFrame, run: str, order: Sequence[str], value: str) -> DataFrame:
    """Records below all before them."""
    before = F.min(value).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(value) < F.col("_before"))).drop("_before")


def sparkline(log: DataFrame, run: str, order: Sequence[str], value: str, width: int, levels: int = 8) -> DataFrame:
    """``run, bucket, mean, level``: at most ``width`` buckets of equal size, means scaled to 0..levels."""
    w = Window.partitionBy(run)
    at = log.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    size = F.ceil(F.col("_n") / width)
    means = at.groupBy(run, F.floor(F.col("_i") / size).alias("bucket")).agg(F.avg(value).alias("mean"))
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    level = F.coalesce(F.round(F.try_divide(F.col("mean") - low, high - low) * levels), F.lit(0.0)).cast("int")
    return means.withColumn("level", level)


def evaluation_rows(documents: DataFrame, run: str, column: str) -> DataFrame:
    """``run, method, group, rank, top1`` of nested evaluation documents ``{method: {group: {rank: value}}}``."""
    nested = F.from_json(column, "map<string, map<string, map<string, double>>>")
    a = documents.select(run, F.explode(nested).alias("method", "_g"))
    b = a.select(run, "method", F.explode("_g").alias("group", "_r"))
    return b.select(run, "method", "group", F.explode("_r").alias("rank", "top1"))


def evaluation_matrix(rows: DataFrame, run: str, ranks: Sequence[str]) -> DataFrame:
    """``run, method, group`` with one column of top-1 scores for each rank (null where there is none)."""
    return rows.groupBy(run, "method", "group").pivot("rank", list(ranks)).agg(F.first("top1"))
