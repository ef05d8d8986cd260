"""Scoring and ranking of recovery strategies.

Strategies are rows of ``incident_key``, ``strategy_key``, three ordinal levels and
``scope_size``.  Functions that need other key names take them as parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import collections as C
from lakewarden.functions import columns as X
from lakewarden.operators import scan
from lakewarden.session import dealt, stored

LOSER_COLUMNS = ["risk_score", "risk_classification", "data_loss_risk", "scope_size"]


def templates(spark: SparkSession) -> DataFrame:
    """The known recovery strategies, one row each."""
    return spark.createDataFrame(
        fixed.STRATEGY_TEMPLATES,
        "strategy_id string, name string, scope array<string>, risk_level string, "
        "runtime_class string, data_loss_risk string")


def candidates(incidents: DataFrame) -> DataFrame:
    """Every known strategy for every incident, without a join.

    A few bytes become several wide rows, so the incidents are dealt out before that.
    """
    options = F.array(*[
        F.struct(F.lit(i).alias("strategy_id"), F.lit(n).alias("name"),
                 F.array(*map(F.lit, scope)).alias("scope"), F.lit(risk).alias("risk_level"),
                 F.lit(runtime).alias("runtime_class"), F.lit(loss).alias("data_loss_risk"))
        for i, n, scope, risk, runtime, loss in fixed.STRATEGY_TEMPLATES])
    rows = dealt(incidents).select("*", F.inline(options))
    return rows.withColumn("scope_size", C.length(F.col("scope")).cast("bigint"))


def score(strategies: DataFrame, weights: Mapping[str, int] = fixed.RISK_WEIGHTS,
          bounds: Sequence[tuple[str, int]] = fixed.RISK_BOUNDS) -> DataFrame:
    """Weighted points per factor, their sum and its class."""
    out = strategies.withColumns({
        "execution_points": X.level_points(F.col("risk_level")) * weights["execution"],
        "runtime_points": X.level_points(F.col("runtime_class")) * weights["runtime"],
        "data_loss_points": X.level_points(F.col("data_loss_risk")) * weights["data_loss"],
        "impact_points": F.col("scope_size") * weights["impact_scope"],
    })
    total = (F.col("execution_points") + F.col("runtime_points") + F.col("data_loss_points")
             + F.col("impact_points"))
    return out.withColumn("risk_score", total).withColumn(
        "risk_classification", X.bucket(F.col("risk_score"), bounds, fixed.RISK_FLOOR_CLASS))


def with_risk(strategies: DataFrame, risks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strategies with their risk row; a strategy that was not evaluated keeps NULLs."""
    return strategies.join(risks, list(keys), "left")


def critical_scope(strategies: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Which business-critical assets a strategy touches, sorted."""
    known = F.array(*[F.lit(a) for a in assets])
    return strategies.withColumn(
        "business_critical_assets_in_scope",
        F.array_sort(F.array_intersect(F.coalesce("scope", F.array().cast("array<string>")),
                                       known)))


def _preference(strategy: str) -> list[Column]:
    """Least risk, then least scope, then strategy; unevaluated ones come last."""
    return [F.asc_nulls_last("risk_score"), F.asc("scope_size"), F.asc(strategy)]


def rank(scored: DataFrame, incident: str = "incident_key",
         strategy: str = "strategy_key") -> DataFrame:
    """Position of every strategy of an incident; 1 is the best.

    Ids may be numbers or texts.  An incident with very many strategies is not one
    task's work (see ``scan``).
    """
    return scan.row_numbers(scored, [incident], _preference(strategy), "strategy_rank")


def decide(scored: DataFrame, incident: str = "incident_key", strategy: str = "strategy_key",
           keep: Sequence[str] = ()) -> DataFrame:
    """Per incident the recommended strategy, the margin to the next and the confidence.

    Only the two best rows per incident are looked at, and Spark drops the others
    before the shuffle.  Without an evaluated strategy nothing is recommended.
    """
    fields = [strategy, *LOSER_COLUMNS, *keep]
    place = F.row_number().over(Window.partitionBy(incident).orderBy(*_preference(strategy)))
    best_two = scored.select(incident, *fields).withColumn("_place", place).filter("_place <= 2")
    first = F.max(F.when(F.col("_place") == 1, F.struct(*fields)))
    second = F.max(F.when(F.col("_place") == 2, F.col("risk_score")))
    out = best_two.groupBy(incident).agg(first.alias("_best"), second.alias("_next"))
    known = F.col("_best.risk_score").isNotNull()
    margin = F.coalesce(F.col("_next") - F.col("_best.risk_score"), F.lit(0).cast("bigint"))
    return out.select(
        incident,
        F.when(known, F.col(f"_best.{strategy}")).alias(f"recommended_{strategy}"),
        *[F.col(f"_best.{c}") for c in [*LOSER_COLUMNS, *keep]],
        F.when(known, margin).alias("margin"),
        F.when(known, X.bucket(margin, fixed.CONFIDENCE_BOUNDS, fixed.CONFIDENCE_FLOOR))
        .alias("confidence"))


def outcome(scored: DataFrame, more: Mapping[str, Column], incident: str = "incident_key",
            strategy: str = "strategy_key") -> DataFrame:
    """Per incident the best rated strategy, ``best_<strategy>``, and other aggregates, in one pass."""
    order = F.struct(F.col("risk_score"), F.col("scope_size"), F.col(strategy))
    best = F.min(F.when(F.col("risk_score").isNotNull(), order))
    return scored.groupBy(incident).agg(
        best[strategy].alias(f"best_{strategy}"), *[c.alias(n) for n, c in more.items()])


def rejected(scored: DataFrame, incident: str = "incident_key",
             strategy: str = "strategy_key") -> DataFrame:
    """The strategies that were not recommended, and in what they fall behind the winner.

    ``reasons`` are codes: UNRATED, HIGHER_RISK, EQUAL_RISK (scope and id decided),
    OTHER_DATA_LOSS, WIDER_SCOPE.  The compared values of both stand beside them.
    """
    won = decide(scored, incident, strategy).select(
        incident, F.col(f"recommended_{strategy}"),
        *[F.col(c).alias(f"best_{c}") for c in LOSER_COLUMNS])
    both = scored.select(incident, strategy, *LOSER_COLUMNS).join(
        stored(won, "recommended"), incident).filter(F.col(strategy) != F.col(f"recommended_{strategy}"))

    def behind(column: str) -> tuple[Column, Column]:
        return F.col(column), F.col(f"best_{column}")

    (risk, least), (loss, other), (scope, smallest) = map(
        behind, ("risk_score", "data_loss_risk", "scope_size"))
    cases = {"UNRATED": risk.isNull(), "HIGHER_RISK": risk > least, "EQUAL_RISK": risk == least,
             "OTHER_DATA_LOSS": loss != other, "WIDER_SCOPE": scope > smallest}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in cases.items()]))
    return both.withColumn("reasons", reasons)


def factors(scored: DataFrame, incident: str = "incident_key",
            strategy: str = "strategy_key") -> DataFrame:
    """What spoke for the recommended strategy of each incident, as values.

    Beside the winner's own, ``evaluated`` is the number of rated strategies.  Rows that
    went through ``critical_scope`` add the critical assets in scope.
    """
    critical = "business_critical_assets_in_scope"
    keep = [critical] if critical in scored.columns else []
    evaluated = scored.groupBy(incident).agg(F.count("risk_score").alias("evaluated"))
    best = f"recommended_{strategy}"
    return (decide(scored, incident, strategy, keep).filter(F.col(best).isNotNull())
            .join(evaluated, incident).select(incident, best, "evaluated", *LOSER_COLUMNS, *keep))


def tradeoffs(decided: DataFrame, upstream: Sequence[str] = fixed.UPSTREAM_ASSETS) -> DataFrame:
    """Upstream assets that the recommended strategy does not rebuild; needs ``scope``."""
    wanted = F.array(*[F.lit(a) for a in upstream])
    return decided.withColumn("not_rebuilt", F.array_except(wanted, F.col("scope")))


def audit_decisions(decisions: DataFrame, strategies: DataFrame, risks: DataFrame,
                    incident: str = "incident_key", strategy: str = "strategy_key") -> DataFrame:
    """Check each decision against the strategies and their risk rows.

    ``decisions`` has the incident, ``recommended_<strategy>`` and ``risk_score``.
    ``reason`` is NO_DECISION, UNKNOWN_STRATEGY or SCORE_DIFFERS where the status is BLOCKED.
    """
    known = strategies.select(incident, F.col(strategy).alias("_strategy"),
                              F.lit(True).alias("_known"))
    scores = risks.select(incident, F.col(strategy).alias("_strategy"),
                          F.col("risk_score").alias("evaluated_score"), F.lit(True).alias("_rated"))
    asked = decisions.withColumn("_strategy", F.col(f"recommended_{strategy}"))
    both = (asked.join(known, [incident, "_strategy"], "left")
            .join(scores, [incident, "_strategy"], "left"))
    reason = (F.when(F.col("_strategy").isNull(), "NO_DECISION")
              .when(F.col("_known").isNull() | F.col("_rated").isNull(), "UNKNOWN_STRATEGY")
              .when(~F.col("risk_score").eqNullSafe(F.col("evaluated_score")), "SCORE_DIFFERS"))
    return both.select(
        incident, f"recommended_{strategy}", "risk_score", "evaluated_score",
        F.when(reason.isNull(), "COMPLETED").otherwise("BLOCKED").alias("status"),
        reason.alias("reason"))
