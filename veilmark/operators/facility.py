"""Facility location: weights of patients, distances, and p-median sites with a proven bound."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.geo import haversine_km
from veilmark.functions.ranges import half_open_midpoint
from veilmark.operators import knn
from veilmark.operators.stages import release, staged

#: Share of each smoking status in the weight, generalised ones included (fixed values); any other counts 0.
SMOKING = {"smokes": 1.0, "formerly smoked": 0.5, "ever smoked": 0.75, "never smoked": 0.5, "*": 0.5}
#: Stands for a missing body-mass index, and for a suppressed age (fixed values).
MISSING_BMI, SUPPRESSED_AGE = 29.0, 42
SITES = 10
#: Gap at which the search for a proof stops, rounds at most, and rounds without a better bound that halve the step.
GAP, ROUNDS, STALE = 0.01, 300, 6


def patient_weight(male: Column, age: Column, hypertension: Column, glucose: Column, bmi: Column, smoking: Column, income: Column) -> Column:
    """Weight of a patient, from 0 to 100; coefficients and ranges are fixed values."""
    return 100 * (
        0.05 * male
        + 0.15 * (age - 1) / 81
        + 0.2 * hypertension
        + 0.15 * (glucose - 55) / 226.59
        + 0.15 * (bmi - 10.3) / 87.3
        + 0.1 * smoking
        + 0.2 * income / 242857
    )


def weigh_patients(df: DataFrame) -> DataFrame:
    """``df`` with ``weight``, from original or generalised columns as text.

    Ages may be intervals or stars; a missing body-mass index and unknown
    smoking statuses have fixed stand-ins; any other null gives a null weight.
    """
    smoking = F.lit(0.0)
    for status, share in SMOKING.items():
        smoking = F.when(F.col("smoking_status") == status, share).otherwise(smoking)
    number = lambda c: F.col(c).cast("string").try_cast("double")
    male = F.when(F.col("gender") == "Male", 1.0).otherwise(0.0)
    age = half_open_midpoint(F.col("age"), SUPPRESSED_AGE)
    bmi = F.coalesce(number("bmi"), F.lit(MISSING_BMI))
    return df.withColumn("weight", patient_weight(male, age, number("hypertension"), number("avg_glucose_level"), bmi, smoking, number("Income")))


def places(sites: DataFrame, p: int = SITES) -> DataFrame:
    """One site, that of the least id, for each place of ``(site, lat, lon)``.

    A second site at a place never lowers a cost, but its copies take each
    other's part in a bound. With fewer than ``p`` places, ``p`` sites each stay.
    """
    by = Window.partitionBy("lat", "lon").orderBy("site")
    few = staged(sites.withColumn("__nth", F.row_number().over(by)).where(F.col("__nth") <= p), "places")
    one = few.where("__nth = 1")
    return (one if one.limit(p).count() == p else few).drop("__nth")


def distance_table(zones: DataFrame, sites: DataFrame) -> DataFrame:
    """``(zone, site, km)`` of ``(zone, lat, lon)`` and ``(site, lat, lon)``.

    All combinations are the result asked for; both sides are joined in blocks.
    """
    each = knn.pairs(zones.select("zone", "lat", "lon"), sites.select("site", "lat", "lon"))
    return each.select(F.col("q_zone").alias("zone"), F.col("c_site").alias("site"), haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("c_lat"), F.col("c_lon")).alias("km"))


def demand(patients: DataFrame, zone: str, weight: str) -> DataFrame:
    """A patient's cost depends on the zone alone, so weights are added up by zone."""
    return patients.groupBy(F.col(zone).alias("zone")).agg(F.sum(weight).alias("weight"))


def assignment_cost(need: DataFrame, table: DataFrame, chosen: DataFrame) -> DataFrame:
    """Sum over zones of weight times the distance to the nearest chosen site."""
    nearest = table.join(chosen.select("site"), "site", "left_semi").groupBy("zone").agg(F.min("km").alias("km"))
    return need.join(nearest, "zone").agg(F.sum(F.col("weight") * F.col("km")).alias("cost"))


def _zone_site_costs(need: DataFrame, table: DataFrame) -> DataFrame:
    """``(zone, site, cost)``, written once: every round of a search reads it again."""
    return staged(need.join(table, "zone").select("zone", "site", (F.col("weight") * F.col("km")).alias("cost")), "costs")


def _digits(cost: Column) -> Column:
    """Costs that agree in eleven digits are ties, so the order of additions has no say."""
    return F.format_string("%.10e", cost).cast("double")


def _addition(costs: DataFrame, chosen: list) -> tuple:
    """The site whose addition leaves the least cost, and that cost."""
    rest = costs
    if chosen:
        near = costs.where(F.col("site").isin(chosen)).groupBy("zone").agg(F.min("cost").alias("near"))
        rest = costs.where(~F.col("site").isin(chosen)).join(near, "zone").withColumn("cost", F.least("cost", "near"))
    best = rest.groupBy("site").agg(F.sum("cost").alias("cost")).orderBy(_digits(F.col("cost")), "site").first()
    return best["site"], best["cost"]


def _open(costs: DataFrame, chosen: list) -> DataFrame:
    """``(zone, own, near, next)``: each zone's nearest chosen site, its cost, and the cost of the second nearest (null with one site)."""
    two = F.slice(F.sort_array(F.collect_list(F.struct("cost", "site"))), 1, 2)  # as many as are chosen
    return costs.where(F.col("site").isin(chosen)).groupBy("zone").agg(two.alias("t")).select("zone", F.col("t")[0]["site"].alias("own"), F.col("t")[0]["cost"].alias("near"), F.get("t", F.lit(1))["cost"].alias("next"))


def _swap(costs: DataFrame, chosen: list) -> tuple | None:
    """``(out, in, cost)`` of the best exchange of a chosen site: all of them are priced in one aggregate.

    A zone changes its site if the new one is nearer, or if its own goes: then
    it takes the nearer of the new and the second nearest.
    """
    rest = costs.where(~F.col("site").isin(chosen)).join(_open(costs, chosen), "zone")
    stay, move = F.least("cost", "near"), F.least(F.col("cost"), F.coalesce("next", F.col("cost")))
    by = rest.groupBy("site", "own").agg(F.sum(stay).alias("stay"), F.sum(move).alias("move"))
    by = by.groupBy("site").agg(F.sum("stay").alias("all"), F.collect_list(F.struct("own", "stay", "move")).alias("own"))
    # a chosen site that serves no zone may go at no cost
    outs = F.array(*[F.lit(s) for s in sorted(chosen)])
    idle = F.transform(F.array_except(outs, F.transform("own", lambda o: o["own"])), lambda o: F.struct(o.alias("out"), F.col("all").alias("cost")))
    busy = F.transform("own", lambda o: F.struct(o["own"].alias("out"), (F.col("all") - o["stay"] + o["move"]).alias("cost")))
    each = by.select("site", F.explode(F.concat(idle, busy)).alias("e")).select("e.out", "site", "e.cost")
    best = each.orderBy(_digits(F.col("cost")), "out", "site").first()
    return best and (best["out"], best["site"], best["cost"])


def _improve(costs: DataFrame, chosen: list, cost: float) -> tuple[list, float]:
    """Exchanges (Teitz and Bart) until none gains."""
    while (best := _swap(costs, chosen)) and best[2] < cost * (1 - 1e-9):
        chosen, cost = sorted([*(s for s in chosen if s != best[0]), best[1]]), best[2]
    return chosen, cost


def _choose(costs: DataFrame, p: int) -> tuple[list, float]:
    chosen, cost = [], 0.0
    for _ in range(min(p, costs.select("site").distinct().count())):
        site, cost = _addition(costs, chosen)
        chosen.append(site)
    return _improve(costs, sorted(chosen), cost)


def choose_sites(need: DataFrame, table: DataFrame, p: int = SITES) -> tuple[list, float]:
    """``p`` sites and their cost: greedy additions, then the best exchange as long as one gains.

    Each round prices all candidates in one aggregate; only the best of a
    round reaches the driver. :func:`p_median` tells how far from the optimum
    the result may be.
    """
    costs = _zone_site_costs(need, table)
    out = _choose(costs, p)
    release(costs)
    return out


class Median(NamedTuple):
    sites: list
    cost: float
    #: no choice of ``p`` sites costs less
    lower: float
    rounds: int

    @property
    def gap(self) -> float:
        return max(0.0, (self.cost - self.lower) / self.cost) if self.cost else 0.0


def p_median(need: DataFrame, table: DataFrame, p: int = SITES, gap: float = GAP, rounds: int = ROUNDS) -> Median:
    """``p`` sites with a proven bound, by Lagrangian relaxation.

    The rule that a zone is served once is priced by a multiplier a zone.
    Without the rule each site has the value ``sum(min(0, cost - multiplier))``
    over the zones, and the ``p`` least values and the multipliers add up to a
    lower bound of any choice. A round takes these in one aggregate; its sites
    are a choice, too, and are improved by exchanges if they cost less than
    the best so far. Multipliers move along ``1 - times served`` by a step
    towards the best cost (Polyak); ``STALE`` rounds without a better bound
    halve it.

    It stops when the gap is at most ``gap``, when every zone is served once
    (then the bound is the optimum), or after ``rounds`` rounds: the result
    then says which gap is left.
    """
    costs = _zone_site_costs(need, table)
    sites, cost = _choose(costs, p)
    if not sites:
        return Median([], 0.0, 0.0, 0)
    start = _open(costs, sites).select("zone", ((F.col("near") + F.coalesce("next", F.col("near"))) / 2).alias("price"))
    state = staged(start, "prices")
    total = state.agg(F.sum("price")).first()[0] or 0.0
    lower, pace, stale, n = 0.0, 1.5, 0, 0
    while n < rounds and cost - lower > gap * cost:
        n += 1
        value = F.sum(F.least(F.lit(0.0), F.col("cost") - F.col("price")))
        taken = costs.join(state, "zone").groupBy("site").agg(value.alias("value")).orderBy("value", "site").limit(p).collect()
        bound = total + sum(r["value"] for r in taken)
        if bound > lower * (1 + 1e-9):
            lower, stale = bound, 0
        elif (stale := stale + 1) == STALE:
            pace, stale = pace / 2, 0
        own = costs.where(F.col("site").isin([r["site"] for r in taken])).join(state, "zone").groupBy("zone")
        moved = own.agg(F.first("price").alias("price"), (1 - F.count_if(F.col("cost") < F.col("price"))).alias("step"), F.min("cost").alias("near"))
        served = staged(moved, "prices")
        row = served.agg(F.sum(F.col("step") * F.col("step")).alias("norm"), F.sum("step").alias("sum"), F.sum("near").alias("cost")).first()
        if row["cost"] < cost * (1 - 1e-9):
            sites, cost = _improve(costs, sorted(r["site"] for r in taken), row["cost"])
        if not row["norm"]:
            break
        size = pace * max(cost - bound, 0.0) / row["norm"]
        release(state)
        state, total = served.select("zone", (F.col("price") + F.lit(size) * F.col("step")).alias("price")), total + size * row["sum"]
    return Median(sites, cost, min(lower, cost), n)
