"""Run history: filters, facets, pages, reports and updates over a table of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import placed

# Application states, their default, and the states that count as success.
STATUSES = ("pendiente", "aplicado", "entrevista", "oferta", "rechazado")
DEFAULT_STATUS = "pendiente"
SUCCESS = ("entrevista", "oferta")
UNTITLED = "Oferta sin título"
EDITABLE = ("offer_title", "offer_link", "pdf_path", "status", "applied_at", "notes")


def status_of(status: Column, default: str = DEFAULT_STATUS) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.lit(default))


def matching(runs: DataFrame, q: str | None, columns: tuple[str, ...] = ("offer_title", "offer_link")) -> DataFrame:
    """Runs whose columns, joined by blanks, contain q in any case."""
    if not q or not q.strip():
        return runs
    return runs.where(F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])), F.lit(q.strip().lower())))


def facets(runs: DataFrame, status: Column) -> DataFrame:
    """(status, n), counted after the text filter and before the others."""
    return runs.groupBy(status_of(status).alias("status")).agg(F.count("*").alias("n"))


def filtered(runs: DataFrame, score: Column, status: Column, least: int | None = None, most: int | None = None, only: str | None = None) -> DataFrame:
    value = F.coalesce(score.cast("int"), F.lit(0))
    if least is not None:
        runs = runs.where(value >= least)
    if most is not None:
        runs = runs.where(value <= most)
    return runs.where(status_of(status) == only) if only else runs


def page(runs: DataFrame, order: list[Column], limit: int = 25, offset: int = 0) -> DataFrame:
    """A page under a total order; limit within 1 to 100, offset not negative."""
    return runs.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def missing_keywords(runs: DataFrame) -> DataFrame:
    """Per keyword that runs lacked: runs, first and last sight, titles in run order, total frequency, whether ever critical.

    runs: pos (order of the runs), created_at, offer_title, not_in_master,
    not_in_master_frequencies, critical_missing.
    """
    each = runs.select(
        "pos", F.posexplode("not_in_master").alias("at", "keyword"), F.nullif(F.coalesce("created_at", F.lit("")), F.lit("")).alias("seen"), F.coalesce(F.nullif("offer_title", F.lit("")), F.lit(UNTITLED)).alias("title"), "not_in_master_frequencies", "critical_missing"
    )
    each = each.withColumns({"freq": F.coalesce(F.try_element_at("not_in_master_frequencies", "keyword"), F.lit(1)), "critical": F.coalesce(F.array_contains("critical_missing", F.col("keyword")), F.lit(False))})
    titles = F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "title"))), lambda t: t["title"])
    return each.groupBy("keyword").agg(
        F.count("*").alias("count"), F.coalesce(F.min("seen"), F.lit("")).alias("first_seen"), F.coalesce(F.max("seen"), F.lit("")).alias("last_seen"), titles.alias("offer_titles"), F.sum("freq").alias("total_frequency"), F.bool_or("critical").alias("ever_critical")
    )


def ordered_missing(report: DataFrame) -> DataFrame:
    """place: more runs first, then the greater frequency, then by keyword. The report has a row a keyword, not a run."""
    return placed(report, [F.col("count").desc(), F.col("total_frequency").desc(), F.col("keyword")])


def ordered_variants(stats: DataFrame) -> DataFrame:
    """place: more runs first, then more successful ones, then by text."""
    return placed(stats, [F.col("runs").desc(), F.col("successful_runs").desc(), F.col("text")])


def page_with_total(runs: DataFrame, order: list[Column], limit: int = 25, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(total), one row, of all runs, and the page."""
    return runs.agg(F.count("*").alias("total")), page(runs, order, limit, offset)


def run_of(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id").eqNullSafe(F.lit(run_id)))


def listing(runs: DataFrame) -> DataFrame:
    """Runs as lists show them: without the offer's text."""
    return runs.drop("job_description")


def applied_usage(runs: DataFrame, variants: DataFrame, key: str = "variant_id", count: str = "used_count", flag: str = "variant_usage_applied") -> tuple[DataFrame, DataFrame]:
    """variants with the usage of runs not applied yet, and runs with all flags set, so a second call changes nothing."""
    return apply_usage(variants, pending_usage(runs, flag), key, count), runs.withColumn(flag, F.lit(True))


def variant_stats(runs: DataFrame) -> DataFrame:
    """Per (ach_id, variant_id): runs, successful ones, last use, first angle and text; a run counts once, one without id each time."""
    each = runs.select("run_id", "pos", "created_at", F.coalesce(F.col("status").isin(*SUCCESS), F.lit(False)).alias("success"), F.posexplode("bullet_variants").alias("at", "v"))
    each = each.select("*", "v.ach_id", "v.variant_id", F.coalesce("v.angle", F.lit("")).alias("angle"), F.coalesce("v.text", F.lit("")).alias("text")).where("variant_id <> ''")
    named = F.coalesce(F.nullif(F.col("run_id"), F.lit("")), F.concat_ws("-", F.lit("\0"), "pos", "at"))
    first = Window.partitionBy("ach_id", "variant_id", "_run").orderBy("pos", "at")
    once = each.withColumn("_run", named).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.groupBy("ach_id", "variant_id").agg(
        F.count("*").alias("runs"), F.count_if("success").alias("successful_runs"), F.coalesce(F.max("created_at"), F.lit("")).alias("last_used"), F.min_by("angle", F.struct("pos", "at")).alias("angle"), F.min_by("text", F.struct("pos", "at")).alias("text")
    )


def pending_usage(runs: DataFrame, applied: str = "variant_usage_applied") -> DataFrame:
    """(variant_id, times) over runs whose usage was not applied yet; negative counts are none."""
    todo = runs.where(~F.coalesce(F.col(applied), F.lit(False)))
    return todo.select(F.explode("variant_usage").alias("variant_id", "times")).groupBy("variant_id").agg(F.sum(F.greatest(F.coalesce("times", F.lit(0)), F.lit(0))).alias("times"))


def apply_usage(variants: DataFrame, usage: DataFrame, key: str = "variant_id", count: str = "used_count") -> DataFrame:
    """Adds usage to the variants that exist; none is inserted."""
    return variants.join(usage.select(F.col("variant_id").alias("_v"), "times"), F.col(key) == F.col("_v"), "left").withColumn(count, F.coalesce(count, F.lit(0)) + F.coalesce("times", F.lit(0))).drop("_v", "times")


def compare(a: Column, b: Column) -> list[Column]:
    """Sorted common keywords, and those of one side only."""
    return [F.array_sort(F.array_intersect(a, b)).alias("common"), F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b")]


def run_hash(text: Column) -> Column:
    return F.left(F.sha1(F.encode(text, "UTF-8")), F.lit(8))


def updated(runs: DataFrame, run_id: str, fields: dict[str, str]) -> DataFrame:
    """runs with one run's editable fields replaced; unknown fields and states raise."""
    if unknown := set(fields) - set(EDITABLE):
        raise ValueError(f"not editable: {', '.join(sorted(unknown))}")
    if fields.get("status", DEFAULT_STATUS) not in STATUSES:
        raise ValueError(f"no such status: {fields['status']}")
    hit = F.col("run_id") == run_id
    plain = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items() if k in runs.columns}
    nested = {k: v for k, v in fields.items() if k not in runs.columns}
    if nested and "application" in runs.columns:
        changed = F.col("application")
        for k, v in nested.items():
            changed = changed.withField(k, F.lit(v))
        plain["application"] = F.when(hit, changed).otherwise(F.col("application"))
    return runs.withColumns(plain)


def without(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(~F.col("run_id").eqNullSafe(F.lit(run_id)))
