"""All models by name, each with the models it reads. A Warehouse makes them from raw feeds, lazily and once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart import schemas
from riskmart.config import Config
from riskmart.operators import aggregates, dimensions, facts, features, intermediate, monitoring, reports, staging
from riskmart.sources import files, lookups
from riskmart.sources.files import write_table


@dataclass(frozen=True)
class Model:
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]  # of the models read, then what it takes by name
    takes: tuple[str, ...] = ()  # config, spark
    layer: str = "marts"
    partition_by: str | None = None
    view: bool = False  # never written: it depends on the day


def _model(make: Callable[..., DataFrame], *reads: str, takes: str = "", layer: str = "marts", **more) -> Model:
    return Model(reads, make, tuple(takes.split()), layer, **more)


_STAGED = {"stg_evaluations": ("raw_risk_evaluations", staging.evaluations), "stg_enrichment": ("raw_payment_enrichment", staging.enrichment), "stg_merchants": ("raw_merchants", staging.merchants), "stg_issuer_reports": ("raw_issuer_fraud_reports", staging.issuer_reports), "stg_refunds": ("raw_refunds", staging.refunds), "stg_alerts": ("raw_dispute_alerts", staging.alerts), "stg_med_claims": ("raw_pix_med_claims", staging.med_claims), "stg_outcomes": ("raw_chargeback_outcomes", staging.outcomes), "stg_rule_hits": ("raw_risk_rule_hits", staging.rule_hits)}

#: Which model each watermark of the attempts fact is of.
WATERMARK_SOURCES = dict(zip(schemas.WATERMARKS, ["stg_transactions", "stg_evaluations", "stg_chargebacks", "stg_enrichment", "fraud_labels", "stg_refunds"], strict=True))


def _marked(attempts: DataFrame, *sources: DataFrame) -> DataFrame:
    """The attempts as they are kept: each row with the watermarks of the run that made it. Models that read attempts read them without, so no plan takes six maxima for nothing."""
    return facts.with_watermarks(attempts, facts.watermarks(dict(zip(schemas.WATERMARKS, sources, strict=True))))


MODELS: dict[str, Model] = {
    "ref_reason_codes": _model(lookups.reason_codes, takes="spark", layer="reference"),
    "ref_response_codes": _model(lookups.response_codes, takes="spark", layer="reference"),
    "stg_transactions": _model(staging.transactions, "raw_transactions", takes="config", layer="staging"),
    "stg_chargebacks": _model(staging.chargebacks, "raw_chargebacks", "ref_reason_codes", layer="staging"),
    **{k: _model(f, raw, layer="staging") for k, (raw, f) in _STAGED.items()},
    "risk_decision": _model(intermediate.risk_decision, "stg_evaluations", "stg_transactions", takes="config", layer="intermediate"),
    "chargebacks_per_tx": _model(intermediate.chargebacks_per_transaction, "stg_chargebacks", layer="intermediate"),
    "fraud_labels": _model(facts.fraud_labels, "stg_issuer_reports", "stg_chargebacks", "stg_refunds", "stg_alerts", "stg_med_claims"),
    "fraud_labels_per_tx": _model(intermediate.fraud_labels_per_transaction, "fraud_labels", layer="intermediate"),
    "duplicate_suspects": _model(intermediate.duplicate_suspects, "stg_transactions", takes="config", layer="intermediate"),
    "payment_attempts": _model(facts.payment_attempts, "stg_transactions", "risk_decision", "chargebacks_per_tx", "duplicate_suspects", "stg_enrichment", "ref_response_codes", "fraud_labels_per_tx", "stg_refunds", partition_by="cohort_date"),
    "fct_payment_attempts": _model(_marked, "payment_attempts", *WATERMARK_SOURCES.values(), partition_by="cohort_date"),
    "fct_chargebacks": _model(facts.chargebacks, "stg_chargebacks", "stg_transactions", "stg_enrichment", "stg_outcomes", takes="config"),
    "time_spine": _model(dimensions.time_spine, takes="spark config"),
    "dim_date": _model(dimensions.dates, "time_spine"),
    "dim_merchant": _model(dimensions.merchants, "stg_merchants"),
    "dim_risk_rule": _model(dimensions.risk_rules, "stg_rule_hits"),
    "approval_daily": _model(aggregates.approval_daily, "payment_attempts"),
    "cohort_daily": _model(aggregates.cohort_daily, "payment_attempts", partition_by="cohort_date"),
    "rule_performance": _model(aggregates.rule_performance, "payment_attempts", takes="config"),
    "rule_backtest": _model(aggregates.rule_backtest, "stg_rule_hits", "stg_evaluations", "payment_attempts"),
    "network_monitoring": _model(aggregates.network_monitoring, "payment_attempts", "stg_issuer_reports", "fct_chargebacks", takes="config"),
    "merchant_loss": _model(aggregates.merchant_loss, "fct_chargebacks", "stg_med_claims", "stg_enrichment", "stg_merchants"),
    "cohort_maturity": _model(reports.cohort_maturity, "cohort_daily", takes="config", view=True),
    "open_exposure": _model(reports.open_exposure, "payment_attempts", takes="config", view=True),
    "metric_sensitivity": _model(reports.metric_sensitivity, "payment_attempts"),
    "daily_risk_health": _model(monitoring.daily_risk_health, "payment_attempts", takes="config", layer="monitoring"),
    "score_psi": _model(monitoring.score_psi, "payment_attempts", takes="config", layer="monitoring"),
    "rule_trigger_health": _model(monitoring.rule_trigger_health, "stg_rule_hits", "stg_evaluations", "payment_attempts", takes="config", layer="monitoring"),
    "maturation_curve": _model(monitoring.maturation_curve, "fct_chargebacks", takes="config", layer="monitoring"),
    "velocity": _model(features.velocity, "stg_transactions", takes="config", layer="features"),
}


def order(names: Iterable[str] | None = None, with_parents: bool = True) -> list[str]:
    """Names in an order that makes each after what it reads; all models by default."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in MODELS and name not in out:
            for r in MODELS[name].reads:
                if with_parents or r in chosen:
                    visit(r)
            out.append(name)

    chosen = list(names or MODELS)
    for name in chosen:
        visit(name)
    return out


def select(spec: str) -> list[str]:
    """`name`, `+name` (with all it reads), `name+` (with all that reads it), `layer:name`, joined by spaces."""
    out: list[str] = []
    for part in spec.split():
        name = part.strip("+")
        if name.startswith("layer:"):
            out += [k for k, m in MODELS.items() if m.layer == name[6:]]
            continue
        if name not in MODELS:
            raise KeyError(name)
        out += order([name]) if part.startswith("+") else [name]
        if part.endswith("+"):
            below = {name}
            for k in order():
                if below & set(MODELS[k].reads):
                    below.add(k)
            out += [k for k in below if k != name]
    return order(dict.fromkeys(out), with_parents=False)


@dataclass
class Warehouse:
    spark: SparkSession
    raw: dict[str, DataFrame]
    config: Config = field(default_factory=Config)
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in MODELS:
                m = MODELS[name]
                self.made[name] = m.make(*[self(r) for r in m.reads], **{k: getattr(self, k) for k in m.takes})
            else:
                self.made[name] = self.raw[name] if name in self.raw else files.empty(self.spark, name)
        return self.made[name]

    def build(self, path: str, names: Iterable[str] | None = None) -> list[str]:
        """Write the models (views aside) below path/<layer>, in order, each read again by those after it."""
        done = []
        for name in order(names):
            m, df = MODELS[name], self(name)
            if m.view:
                continue
            to = f"{path}/{m.layer}/{name}"
            write_table(df, to, m.partition_by)
            self.made[name] = self.spark.read.schema(df.schema).parquet(to).select(*df.columns)
            done.append(name)
        return done

    def refresh(self, path: str) -> list:
        """Bring the tables below path up to the feeds, replacing the partitions that changed rows are or were in alone; see stored.Stored. Returns the days of sales."""
        from riskmart.plans.stored import Stored

        return Stored(self, path).refresh()
