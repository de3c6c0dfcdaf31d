"""The whole analysis of one table: inspect, profile, clean, validate, explore, test, measure, forecast."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from datalumen.functions.columns import is_text
from datalumen.operators import (
    charts, cleaning, exploration, forecast, hypothesis, inspection, kpi, modeling, profiling, validation,
)
from datalumen.operators.alerts import alerts
from datalumen.operators.inspection import TableMeta
from datalumen.sources.readers import load


@dataclass(frozen=True)
class AnalysisOptions:
    cleaning: cleaning.CleaningOptions = cleaning.CleaningOptions()
    columns: int | None = None
    test_levels: int | None = None
    periods: int = 6
    target: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    kpi_on_clipped: bool = False
    approx: bool = False


@dataclass(frozen=True)
class Analysis:
    meta: TableMeta
    cleaned: DataFrame
    plan: cleaning.CleaningPlan
    tables: dict[str, DataFrame]
    kept: DataFrame | None = None

    def release(self) -> None:
        """Give back the table that cleaning kept; the result tables can still be read, at the price of cleaning again."""
        if self.kept is not None:
            self.kept.unpersist()


def analyze(spark: SparkSession, source: str | DataFrame, options: AnalysisOptions = AnalysisOptions()) -> Analysis:
    """All result tables of one dataset, by name.

    Fitting the roles and the cleaning plan runs jobs; the result tables themselves are run when read.
    Business figures are taken before outliers are clipped, so that totals are the true ones, unless
    ``kpi_on_clipped`` asks for the clipped table.
    """
    raw = load(spark, source)
    inspected = inspection.inspect_columns(raw, options.approx)
    meta = inspection.meta_from_rows(inspected.collect(), raw.columns)
    result = cleaning.clean(raw, meta, options.cleaning)
    clean, roles = result.cleaned, result.meta
    unclipped = cleaning.CleaningPlan(**{**vars(result.plan), "fences": {}}).finish_cells(result.kept)
    base = clean if options.kpi_on_clipped else unclipped

    numbers = [c for c in roles.numerical_columns if c in clean.columns]
    categories = list(roles.categorical_columns)
    dates = [c for c in roles.datetime_columns if not is_text(clean.schema[c])]
    most = options.test_levels
    few = [c for c in categories if most is None or roles.unique_counts.get(c, 0) <= most]
    out: dict[str, DataFrame] = {
        "columns": inspected, "quality": profiling.quality_score(raw), "log": result.log,
        "validation": validation.before_after(raw, clean),
        "summary": validation.cleaning_summary(raw, clean, result.log),
        "charts": charts.recommend_charts(clean, roles),
    }
    if numbers:
        out["numeric"] = profiling.profile_numeric(clean, numbers, options.approx)
        out["anomalies"] = exploration.anomaly_iqr(clean, numbers)
        out["mad"] = exploration.anomaly_mad(clean, numbers)
        out["confidence"] = hypothesis.mean_ci(clean, numbers)
    if categories:
        out["categorical"] = profiling.profile_categorical(clean, categories)
    if dates:
        out["dates"] = profiling.profile_datetime(clean, dates)
    if len(numbers) >= 2:
        out["pearson"] = exploration.corr_pearson(clean, numbers)
        out["spearman"] = exploration.corr_spearman(clean, numbers)
        out["pairs"] = exploration.corr_top_pairs(clean, numbers)
    if categories and numbers:
        out["segments"] = exploration.segment_breakdown(clean, categories, numbers, options.columns)
        out["segment_ends"] = exploration.segment_top_bottom(clean, categories, numbers, options.columns)
        out["welch"] = hypothesis.welch_t(clean, categories, numbers)
        out["anova"] = hypothesis.anova_f(clean, categories, numbers)
    if len(few) >= 2:
        out["chi_square"] = hypothesis.chi_square(clean, few)
    if dates and numbers:
        grain = exploration.pick_grain(clean, dates[0])
        out["trend"] = exploration.period_totals(clean, dates[0], numbers[: options.columns], grain)
        out["growth"] = exploration.trend_growth(clean, dates[0], numbers[: options.columns], grain)
        out["forecast"] = forecast.forecast(base, dates[0], numbers[0], options.periods, grain)
        out["forecast_summary"] = forecast.forecast_summary(base, dates[0], numbers[0], grain)
    out |= _figures(base, numbers, options)
    out["alerts"] = alerts(
        out["quality"], out.get("segment_ends"), [out[t] for t in ("welch", "chi_square", "anova") if t in out],
        out.get("growth"), out.get("anomalies"), out.get("kpi_returns"), out.get("kpi_customers"))
    target = options.target or next(iter(roles.target_candidates), None)
    if target:
        try:
            model = modeling.train_baseline(clean, target)
            out |= {"model_metrics": model.metrics, "model_importance": model.importance}
        except modeling.NotTrainable:
            pass
    return Analysis(roles, clean, result.plan, out, result.kept)


def _figures(df: DataFrame, numbers: list[str], options: AnalysisOptions) -> dict[str, DataFrame]:
    roles = kpi.resolve_roles(df.columns, numbers, options.roles)
    out = {}
    if "revenue" in roles:
        out["kpi_sales"] = kpi.kpi_sales(df, roles["revenue"], roles.get("units"))
    if "customer" in roles:
        out["kpi_customers"] = kpi.kpi_customers(df, roles["customer"])
    if "returned" in roles:
        out["kpi_returns"] = kpi.kpi_returns(df, roles["returned"])
    return out
