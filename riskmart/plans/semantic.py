"""The metric layer: measures, metrics and dimensions, compiled to one aggregation for each query.

Ratios are ratios of sums, made after grouping. Time is grouped by any grain of the model's time dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions.columns import ratio


@dataclass(frozen=True)
class Measure:
    model: str
    expr: str
    distinct: bool = False

    def column(self, where: str | None) -> Column:
        e = F.expr(self.expr if where is None else f"case when {where} then {self.expr} end")
        return F.count_distinct(e) if self.distinct else F.sum(e)


@dataclass(frozen=True)
class SemanticModel:
    time: str
    dimensions: tuple[str, ...]


@dataclass(frozen=True)
class Metric:
    """kind: simple (a measure), ratio (of two measures) or derived (an expression over measures)."""

    kind: str
    measures: tuple[str, ...]
    where: str | None = None
    expr: str | None = None


SEMANTIC_MODELS = {
    "payment_attempts": SemanticModel("cohort_date", ("payment_method", "is_chargeback_eligible", "decline_source", "decision_source", "rule_triggered", "is_duplicate_candidate", "merchant_id", "country", "card_network", "issuer_decline_type")),
    "fct_chargebacks": SemanticModel("chargeback_date", ("reason_category", "is_fraud_reason", "payment_method", "merchant_id", "card_network")),
}


def _if_approved(what: str, otherwise: str = " else 0", more: str = "") -> str:
    return f"case when is_approved{more} then {what}{otherwise} end"


MEASURES: dict[str, Measure] = {
    "attempts": Measure("payment_attempts", "1"),
    "approved_transactions": Measure("payment_attempts", _if_approved("1")),
    "approved_amount": Measure("payment_attempts", _if_approved("amount")),
    "chargeback_transactions": Measure("payment_attempts", _if_approved("1", more=" and has_chargeback")),
    "chargeback_amount": Measure("payment_attempts", _if_approved("chargeback_amount")),
    "fraud_chargeback_amount": Measure("payment_attempts", _if_approved("fraud_chargeback_amount")),
    "risk_rejected_transactions": Measure("payment_attempts", "case when decline_source = 'risk_engine' then 1 else 0 end"),
    "fraud_labeled_amount": Measure("payment_attempts", _if_approved("amount", more=" and is_fraud_labeled")),
    "orders": Measure("payment_attempts", "order_id", distinct=True),
    "approved_orders": Measure("payment_attempts", _if_approved("order_id", ""), distinct=True),
    "gross_chargeback_amount": Measure("fct_chargebacks", "cb_amount"),
    "gross_fraud_loss_amount": Measure("fct_chargebacks", "case when is_fraud_reason then cb_amount else 0 end"),
}
METRICS: dict[str, Metric] = {
    **{m: Metric("simple", (m,)) for m in ("attempts", "approved_transactions", "approved_amount", "chargeback_transactions", "chargeback_amount", "risk_rejected_transactions", "fraud_labeled_amount", "orders", "approved_orders")},
    "approval_rate": Metric("ratio", ("approved_transactions", "attempts")),
    "risk_reject_rate": Metric("ratio", ("risk_rejected_transactions", "attempts")),
    "chargeback_rate_amount": Metric("ratio", ("chargeback_amount", "approved_amount")),
    "chargeback_rate_qty": Metric("ratio", ("chargeback_transactions", "approved_transactions")),
    "card_chargeback_rate_amount": Metric("ratio", ("chargeback_amount", "approved_amount"), "is_chargeback_eligible"),
    "approval_rate_by_order": Metric("ratio", ("approved_orders", "orders")),
    "gross_fraud_loss": Metric("simple", ("gross_fraud_loss_amount",)),
    "gross_chargeback_loss": Metric("simple", ("gross_chargeback_amount",)),
    "fraud_bps": Metric("derived", ("fraud_labeled_amount", "approved_amount"), expr="cast({0} as double) * 10000 / nullif(cast({1} as double), 0)"),
}
#: Grains of time, with the step from one period to the next.
GRAINS = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "12 MONTH"}


def query(models, metrics: list[str], by: list[str] | None = None, grain: str | None = None, where: str | None = None) -> DataFrame:
    """Metrics (of one semantic model) by dimensions and, with a grain, by time. models gives a model by name."""
    of = {MEASURES[m].model for k in metrics for m in METRICS[k].measures}
    if len(of) != 1:
        raise ValueError(f"metrics of several models: {sorted(of)}")
    model = of.pop()
    known, df = SEMANTIC_MODELS[model], models(model)
    if unknown := [d for d in by or [] if d not in known.dimensions]:
        raise ValueError(f"no such dimensions: {unknown}")
    if grain and grain not in GRAINS:
        raise ValueError(f"no such grain: {grain}")
    if where:
        df = df.where(where)
    keys = [F.col(d) for d in by or []]
    if grain:
        keys.append((F.col(known.time) if grain == "day" else F.trunc(known.time, grain)).alias(known.time))
    out = df.groupBy(*keys).agg(*[c.alias(k) for k, c in _sums(metrics).items()])
    return out.select(*[c for c in out.columns if not c.startswith("_")], *[_made(k).alias(k) for k in metrics])


def _sums(metrics: list[str], model: str | None = None) -> dict[str, Column]:
    """Aggregates that the metrics are made of, those of one model if it is given."""
    return {f"_{k}_{i}": MEASURES[m].column(METRICS[k].where) for k in metrics for i, m in enumerate(METRICS[k].measures) if model in (None, MEASURES[m].model)}


def _made(k: str) -> Column:
    m, names = METRICS[k], [f"_{k}_{i}" for i in range(len(METRICS[k].measures))]
    return F.col(names[0]) if m.kind == "simple" else ratio(*names) if m.kind == "ratio" else F.expr(m.expr.format(*names))


def timeline(models, metrics: list[str], grain: str, by: list[str] | None = None) -> DataFrame:
    """Metrics of any models by period, and by dimensions that all of these models have. Between the first and last period of a group (of all, without dimensions) every period of
    the time spine has a row: sums are zero there, and ratios null. Rows without a time are in no period.

    One aggregation a model; these are put together by a union and one more aggregation over their few rows, so models are never joined, whatever keys one has and another lacks.
    """
    by, of = by or [], sorted({MEASURES[m].model for k in metrics for m in METRICS[k].measures})
    if unknown := [(d, m) for d in by for m in of if d not in SEMANTIC_MODELS[m].dimensions]:
        raise ValueError(f"no such dimensions: {unknown}")
    if grain not in GRAINS:
        raise ValueError(f"no such grain: {grain}")

    def period(c: str) -> Column:
        return (F.col(c) if grain == "day" else F.trunc(c, grain)).alias("period")

    parts = None
    for m in of:
        time = SEMANTIC_MODELS[m].time
        part = models(m).where(F.col(time).isNotNull()).groupBy(*by, period(time)).agg(*[c.alias(k) for k, c in _sums(metrics, m).items()])
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    names = list(_sums(metrics))
    met = parts.groupBy(*by, "period").agg(*[F.max(c).alias(c) for c in names])  # each is of one model, which has one row here
    spans = met.groupBy(*by).agg(F.min("period").alias("_first"), F.max("period").alias("_last")).where("_first is not null")
    every = spans.select(*by, F.explode(F.sequence("_first", "_last", F.expr(f"INTERVAL {GRAINS[grain]}"))).alias("period"))
    spine = models("time_spine").select(period("date_day")).distinct()
    every = every.join(F.broadcast(spine), "period", "left_semi")  # days of a calendar at most
    same = F.col("e.period") == F.col("m.period")
    for d in by:
        same = same & F.col(f"e.{d}").eqNullSafe(F.col(f"m.{d}"))
    filled = every.alias("e").join(met.alias("m"), same, "left").select(*[F.col(f"e.{d}").alias(d) for d in by], F.col("e.period").alias("period"), *[F.coalesce(F.col(f"m.{c}"), F.lit(0)).cast(met.schema[c].dataType).alias(c) for c in names])
    return filled.select(*by, "period", *[_made(k).alias(k) for k in metrics])


#: Size of sketches of distinct values (2^SKETCH registers), and the relative error that an estimate from them keeps to with three standard deviations.
SKETCH = 14
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH / 2)


def sketches(df: DataFrame, measure: str, by: list[str]) -> DataFrame:
    """by, and a sketch of the distinct values of a measure (some kilobytes, whatever their number) that can be merged over any of them: what exact distinct counts can't."""
    m = MEASURES[measure]
    if not m.distinct:
        raise ValueError(f"{measure} is a sum: add it up")
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.expr(m.expr).cast("string"), F.lit(SKETCH)).alias("sketch"))


def distinct_of(sketched: DataFrame, by: list[Column]) -> DataFrame:
    """by, and the estimated number of distinct values over the sketches of each group."""
    return sketched.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
