"""Should-cost review of supplier quotes: validity, component impacts, gap and verdict."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import apart, carried_rate, finite, fixed, let, signed, strict_number, trimmed

COMPONENTS = ("mat", "fx", "proc", "energy", "other")
#: Components whose shares add up to the product; currency exposure cuts across them.
BASE = ("mat", "proc", "energy", "other")
RATIOS = tuple(f"{c}_ratio" for c in COMPONENTS)
RATES = tuple(f"{c}_rate" for c in COMPONENTS)
NUMBERS = ("price", *RATIOS, *RATES, "supplier_ask")


#: Fixed value: the one role that the second source may have.
SECOND_SOURCE_ROLE = "CORROBORATION_ONLY"


@dataclass(frozen=True)
class CostRules:
    """Fixed values; the thresholds are in percentage points."""

    match: float = 0.5
    evidence: float = 1.5
    challenge: float = 3.0
    version: int = 1
    decision_support_only: bool = True
    automatic_acceptance: bool = False
    automatic_rejection: bool = False
    material_equals_product: bool = False
    second_source_role: str = SECOND_SOURCE_ROLE

    def problems(self) -> list[str]:
        """What rule_problem() finds in a table of rules, for these."""
        values = (self.match, self.evidence, self.challenge)
        out = []
        if self.version != 1 or self.decision_support_only is not True:
            out.append("version or purpose")
        if not all(v == v and abs(v) != float("inf") for v in values) or not 0 <= self.match < self.evidence < self.challenge:
            out.append("thresholds")
        if any(x is not False for x in (self.automatic_acceptance, self.automatic_rejection, self.material_equals_product)) or self.second_source_role != SECOND_SOURCE_ROLE:
            out.append("policy")
        return out


def rule_problem() -> Column:
    """The first thing wrong with a row of rules that has the fields of CostRules as columns; null if none is."""
    yes = lambda c, value: F.coalesce(F.col(c) == F.lit(value), F.lit(False))
    m, e, h = F.col("match"), F.col("evidence"), F.col("challenge")
    ordered = finite(m) & finite(e) & finite(h) & (m >= 0) & (m < e) & (e < h)
    policy = reduce(lambda a, b: a & b, [yes(c, False) for c in ("automatic_acceptance", "automatic_rejection", "material_equals_product")])
    return (
        F.when(~(yes("version", 1) & yes("decision_support_only", True)), "version or purpose")
        .when(~F.coalesce(ordered, F.lit(False)), "thresholds")
        .when(~(policy & yes("second_source_role", SECOND_SOURCE_ROLE)), "policy")
    )


#: Verdicts with one tone; the other depends on the gap.
TONES = {"REQUEST_REDUCTION": "high", "CHALLENGE_INCREASE": "high", "HIGH_CHALLENGE": "high", "REQUEST_EVIDENCE": "medium", "CLARIFY_SMALL_GAP": "medium", "CONDITIONAL_REVIEW": "balanced", "SUPPLIER_BELOW_MODEL": "favorable"}


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def estimates(quotes: DataFrame) -> DataFrame:
    """Impacts in points, estimate, other_inputs, gap, base_ratio_sum, new_price, requested_price, unexplained."""
    q = quotes.select("*", *[(F.col(f"{c}_ratio") * F.col(f"{c}_rate") / 100).alias(f"{c}_impact") for c in COMPONENTS], _sum(F.col(f"{c}_ratio") for c in BASE).alias("base_ratio_sum"))
    q = q.select("*", _sum(F.col(f"{c}_impact") for c in COMPONENTS).alias("estimate"))
    price = F.col("price")
    q = q.select("*", (F.col("estimate") - F.col("mat_impact")).alias("other_inputs"), (F.col("supplier_ask") - F.col("estimate")).alias("gap"))
    return q.select("*", (price * (1 + F.col("estimate") / 100)).alias("new_price"), (price * (1 + F.col("supplier_ask") / 100)).alias("requested_price"), (price * F.col("gap") / 100).alias("unexplained"))


def invalid_reason(of=F.col) -> Column:
    """The first reason that holds, over the columns of estimates(); null for a valid quote. of: gives a column by name."""
    any_of = lambda conditions: reduce(lambda a, b: a | b, conditions)
    results = ("estimate", "gap", "new_price", "requested_price", "unexplained")
    return (
        F.when(any_of(~finite(of(c)) for c in NUMBERS), "not_numeric")
        .when(of("price") < 0, "negative_price")
        .when(any_of((of(c) < 0) | (of(c) > 100) for c in RATIOS), "ratio_out_of_range")
        .when(any_of(of(c) < -100 for c in (*RATES, "supplier_ask")), "rate_below_minus_100")
        .when(of("base_ratio_sum") > 100, "base_ratios_over_100")
        .when(any_of(~finite(of(c)) for c in results), "result_not_finite")
        .when((of("new_price") < 0) | (of("requested_price") < 0), "negative_result_price")
    )


def invalid_fields() -> Column:
    """Every field that fails by itself."""
    bad = [F.when(~finite(F.col(c)), F.lit(c)) for c in NUMBERS]
    bad += [F.when(F.col("price") < 0, F.lit("price"))] + [F.when((F.col(c) < 0) | (F.col(c) > 100), F.lit(c)) for c in RATIOS] + [F.when(F.col(c) < -100, F.lit(c)) for c in (*RATES, "supplier_ask")]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def valid_target(x: Column) -> Column:
    """A target rate may be missing; if given it is finite and at least -100."""
    return x.isNull() | (finite(x) & (x >= -100))


def valid_target_field(x: Column) -> Column:
    """The same of a form field: blank is missing."""
    text = trimmed(x)
    number = strict_number(text)
    return (text == "") | (finite(number) & F.coalesce(number >= -100, F.lit(False)))


def verdict(rules: CostRules = CostRules(), of=F.col) -> Column:
    est, ask, gap, mat = (of(c) for c in ("estimate", "supplier_ask", "gap", "mat_impact"))
    m, e, h = rules.match, rules.evidence, rules.challenge
    return (
        F.when((est < -m) & (ask >= 0), "REQUEST_REDUCTION")
        .when((est < -m) & (ask < 0) & (gap > m), "REQUEST_DEEPER_REDUCTION")
        .when((mat < -m) & (ask > 0) & (gap > m), "CHALLENGE_INCREASE")
        .when(gap >= h, "HIGH_CHALLENGE")
        .when(gap >= e, "REQUEST_EVIDENCE")
        .when(gap > m, "CLARIFY_SMALL_GAP")
        .when(F.abs(gap) <= m, "CONDITIONAL_REVIEW")
        .otherwise("SUPPLIER_BELOW_MODEL")
    )


def tone(code: Column, gap: Column, rules: CostRules = CostRules()) -> Column:
    """The tone of a verdict other than INVALID."""
    by_gap = F.when(gap >= rules.challenge, "high").otherwise("medium")
    out = by_gap
    for name in sorted(set(TONES.values())):
        out = F.when(code.isin(*[k for k, v in TONES.items() if v == name]), name).otherwise(out)
    return out


def gap_text() -> Column:
    gap = F.col("gap")
    side = F.when(gap > 0, "above").otherwise("below")
    return F.when(F.abs(gap) < 0.005, "0.00 points (supplier equals the model)").otherwise(F.concat(signed(apart(gap), 2), F.lit(" points (supplier "), side, F.lit(" the model)")))


def formula_text() -> Column:
    """The estimate, the new price and the sum of the base ratios as sums with their figures put in."""
    two = (*[f"{c}_{x}" for c in COMPONENTS for x in ("ratio", "rate")], "estimate", "price", "new_price")

    def text(t: Column) -> Column:
        of = lambda c: F.get(t, two.index(c))
        term = lambda c: F.concat(F.lit("("), of(f"{c}_ratio"), F.lit("% x "), of(f"{c}_rate"), F.lit("%)"))
        base = F.concat_ws(" + ", *[F.concat(of(f"{c}_ratio"), F.lit("%")) for c in BASE])
        return F.concat(
            *[F.lit("estimate = "), F.concat_ws(" + ", *map(term, COMPONENTS)), F.lit(" = "), of("estimate"), F.lit("%; new price = "), of("price"), F.lit(" x (1 + "), F.get(t, len(two))],
            *[F.lit(") = "), of("new_price"), F.lit("; base ratios = "), base, F.lit(" = "), F.get(t, len(two) + 1), F.lit("%")],
        )

    numbers = F.transform(F.array(*[F.col(c).cast("double") for c in two]), lambda x: fixed(x, 2))
    more = [let(F.col("estimate") / 100, lambda x: fixed(x, 4)), let(F.col("base_ratio_sum"), lambda x: fixed(x, 1))]
    return let(F.concat(numbers, F.array(*more)), text)


def verdict_evidence() -> Column:
    """Three lines of figures for any verdict."""
    x = lambda c: signed(F.col(c).cast("double"), 2)
    model = F.concat(F.lit("model "), x("estimate"), F.lit("%, supplier "), x("supplier_ask"), F.lit("%"))
    parts = F.concat(F.lit("material explains "), x("mat_impact"), F.lit(" points, other inputs "), x("other_inputs"))
    return F.array(model, F.concat(F.lit("gap "), signed(apart(F.col("gap").cast("double")), 2), F.lit(" points")), parts)


def reviewed(quotes: DataFrame, rules: CostRules = CostRules()) -> DataFrame:
    """Quotes with estimates, invalid_reason, verdict (INVALID where a reason holds) and tone. No shuffle.

    The judgement comes as the one row of an inline(): a filter on what it gives stays above it, while one on a
    column would be worked out once more below the projection, judgement and all. It is made in projections below, as
    an expression within the inline() would be evaluated node by node."""
    if rules.problems():
        raise ValueError("; ".join(rules.problems()))
    reason = invalid_reason(lambda c: apart(F.col(c)) if c == "price" else F.col(c))
    coded = estimates(quotes).select(reason.alias("_reason"), verdict(rules).alias("_code"), "*")
    valid = F.col("_reason").isNull()
    judged = F.struct(F.col("_reason").alias("invalid_reason"), F.when(valid, F.col("_code")).otherwise("INVALID").alias("verdict"), F.when(valid, tone(F.col("_code"), F.col("gap"), rules)).alias("tone"))
    return coded.select("*", judged.alias("_judged")).select("*", F.inline(F.array("_judged"))).drop("_reason", "_code", "_judged")


def with_carried_rate(quotes: DataFrame, signals: DataFrame, window: str = "c6", edited: Column | None = None) -> DataFrame:
    """Put the material's market change of `window` in the place of mat_rate, and say where it is from.

    edited: the rate as the user left it; a difference of over 1e-6 from the carried one marks an override.
    Quotes of materials without a signal keep their rate. The signals are one row a series, which Spark's
    adaptive execution broadcasts when their size at run time allows, and joins by sorting when it does not.
    """
    market = signals.select("material_id", carried_rate(F.col(window)).alias("carried"), F.col("period").alias("carried_period"))
    rows = quotes.join(market, "material_id", "left")
    rate = edited if edited is not None else F.coalesce("carried", "mat_rate")
    rows = rows.withColumn("mat_rate", rate)
    override = F.col("carried").isNotNull() & (~finite(F.col("mat_rate")) | (F.abs(F.col("mat_rate") - F.col("carried")) > 1e-6))
    rows = rows.withColumn("overridden", override)
    where = F.concat_ws(" | ", "material_id", F.lit(window), F.concat(fixed(F.col("carried"), 2), F.lit("%")), "carried_period")
    context = F.when(F.col("carried").isNull(), "rate entered by hand, not linked to a signal").when(F.col("overridden"), F.concat(F.lit("market record: "), where, F.lit("; rate edited since"))).otherwise(F.concat(F.lit("market data: "), where))
    return rows.withColumn("market_context", context)


def verdict_rollup(reviews: DataFrame, *by: str) -> DataFrame:
    """Counts, unexplained amounts and mean gap over the cube of `by`, invalid quotes apart.

    The quotes are added up by all of `by` once; the cube is then taken over those sums.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)"))
    valid = F.col("invalid_reason").isNull()  # within the sums: as a filter it would be worked out once more, before them
    cells = reviews.select(*by, valid.alias("_valid"), *[F.when(valid, F.col(c)).alias(c) for c in ("unexplained", "gap")])
    cells = cells.groupBy(*by).agg(F.count_if("_valid").alias("_n"), exact("unexplained").alias("_money"), exact("gap").alias("_gap")).where("_n > 0")
    gap = F.sum("_gap").cast("double") / F.sum("_n")
    return cells.cube(*by).agg(F.sum("_n").alias("n"), F.round(F.sum("_money").cast("double"), 2).alias("unexplained"), gap.alias("mean_gap"))
