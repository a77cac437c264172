"""The intraday corrector: all rules of the rest of a day, one after the other, with a trace.

What a day has shown so far is one row for each series and day, joined to its hours. With three observed hours or more
an hour's adjustment starts from the mean of the last residuals and goes through the rules in their order; a rule is an
expression of the adjustment so far, to a tenth of a MW. Before that, priors and what is carried over shift the forecast.
Rules that look at the corrected hour before (evening decline, shape guard) are a fold over the day's hours, at most 24
steps. Support between the last observed hour and a later one is a difference of two running sums, unknown if that of
any hour between is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from . import intraday_rules as R
from .guards import BANDS

LOOKBACK, LEAST_OBSERVED, FALLBACK = 3, 3, "forecast_fallback"
SHRINK, MOST, DECAY = 0.6, 1200.0, 0.92
#: Features that rules read; those that rows lack are unknown.
FEATURES = ("is_non_business_day", "lag_24h", "lag_24h_hourly_delta", "recent_same_business_type_mean", "recent_same_business_type_delta_mean", "lag_24h_business_type_mismatch", "temp_c", "temp_delta_1h", "temp_delta_24h", "cooling_degree", "cooling_delta_1h", "cooling_delta_24h", "apparent_cooling_delta_24h", "heating_degree", "temp_anomaly_7d", "humidity", "discomfort_index", "apparent_temp_c")

#: Names of the rules, in their order.
BIASES = ("day_level", "early_carryover", "day_boundary", "transition", "transition_prior", "prior_stack_cap")
STEPS = (
    "observed_residual", "positive_mitigation", "slope_damping", "morning_damping", "afternoon_damping", "evening_damping", "morning_ramp",
    "evening_negative_damping", "continuity_floor", "near_floor", "observed_ramp", "daytime_lift", "post_lunch", "morning_warm", "morning_anchor", "afternoon_anchor",
)
LAST = ("evening_decline", "shape_guard", "ramp_guard")
RULES = BIASES + STEPS + LAST

c = F.col


def tenth(x: Column) -> Column:
    """To one decimal, halves to even, by the binary value: engines agree on it."""
    return F.rint(x * 10) / 10


def day_state(rows: DataFrame, deweight: bool = False, hours: tuple[int, ...] = (12,), weight: float = 0.25, least: float = 600.0) -> DataFrame:
    """One row for each series and day with an observed hour: n_observed, last_hour, last_mw and the forecast of it; of
    the last three residuals (r_first, r_before, r_last) mean, weighted mean and largest; a1, a2, a3, the last three
    actuals if their hours follow each other; slope, the last change if known; falling, whether one of the last two
    changes is a fall of 500 or more.

    Hours filled from a forecast do not count. With ``deweight`` a large residual at midday of a working day weighs
    less."""
    odd = deweight & F.hour("ts").isin(*hours) & F.coalesce(c("is_non_business_day") == 0, F.lit(True)) & (F.abs(c("actual_mw") - c("forecast_mw")) >= least) if deweight else F.lit(False)
    point = F.struct(F.hour("ts").alias("h"), c("actual_mw").alias("a"), (c("actual_mw") - c("forecast_mw")).alias("r"), F.when(odd, weight).otherwise(1.0).alias("w"))
    seen = rows.where("actual_mw is not null and forecast_mw is not null")
    if "actual_source" in rows.columns:
        seen = seen.where(~c("actual_source").eqNullSafe(FALLBACK))
    x = seen.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(point)).alias("x"))
    last = lambda k: F.get(c("x"), F.size("x") - k)
    recent = F.slice("x", F.greatest(F.size("x") - LOOKBACK + 1, F.lit(1)), LOOKBACK)
    total = lambda of: F.aggregate(recent, F.lit(0.0), lambda acc, p: acc + of(p))
    weights = total(lambda p: p["w"])
    steady = (last(1)["h"] - last(2)["h"] == 1) & (last(2)["h"] - last(3)["h"] == 1)
    falls = F.exists(F.zip_with(F.slice("x", 2, 24), F.slice("x", 1, F.greatest(F.size("x") - 1, F.lit(0))), lambda b, a: (b["h"] - a["h"] == 1) & (b["h"] >= last(1)["h"] - 1) & (a["a"] - b["a"] >= 500.0)), lambda y: y)
    out = {
        "n_observed": F.size("x"), "last_hour": last(1)["h"], "last_mw": last(1)["a"], "r_last": last(1)["r"], "r_before": last(2)["r"], "r_first": last(3)["r"],
        "r_mean": total(lambda p: p["r"]) / F.size(recent), "r_weighted": F.when(weights > 0, total(lambda p: p["r"] * p["w"]) / weights).otherwise(total(lambda p: p["r"]) / F.size(recent)), "r_most": F.array_max(F.transform(recent, lambda p: p["r"])),
        "slope": F.when(last(1)["h"] - last(2)["h"] == 1, last(1)["a"] - last(2)["a"]), "falling": F.coalesce(falls, F.lit(False)),
    }
    out |= {f"a{3 - k}": F.when(steady, last(k + 1)["a"]) for k in range(3)}
    return x.select("series_id", "day", *[v.alias(k) for k, v in out.items()])


def carried_residuals(rows: DataFrame) -> DataFrame:
    """(series_id, day, carried_mw, carried_hour): the last observed residual of the day before."""
    s = day_state(rows)
    return s.select("series_id", F.date_add("day", 1).alias("day"), c("r_last").alias("carried_mw"), c("last_hour").alias("carried_hour"))


def _prepared(rows: DataFrame, state: DataFrame) -> DataFrame:
    r = rows.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts"), "served_mw": c("forecast_mw")})
    r = r.withColumns({f: F.lit(None).cast("double") for f in FEATURES if f not in rows.columns} | {x: F.lit(None).cast("double") for x in ("carried_mw", "carried_hour") if x not in rows.columns})
    at = r.select("series_id", "day", c("hour").alias("last_hour"), *[c(f).alias(n) for f, n in (("is_non_business_day", "off_then"), ("lag_24h_business_type_mismatch", "mismatch_then"), ("recent_same_business_type_mean", "usual_then"), ("lag_24h", "lag_then"))])
    r = r.join(state.join(at, ["series_id", "day", "last_hour"], "left"), ["series_id", "day"], "left")
    r = r.withColumns({"n_observed": F.coalesce("n_observed", F.lit(0)), "lead": c("hour") - F.coalesce("last_hour", F.lit(-1)), "support": F.greatest("lag_24h_hourly_delta", "recent_same_business_type_delta_mean"), "off": F.coalesce(c("is_non_business_day") == 1, F.lit(False)), "mean_residual": c("r_mean"), **{f"r{k}": c(n) for k, n in ((1, "r_first"), (2, "r_before"), (3, "r_last"))}})
    # Running sums of support, as differences from the last observed hour.
    upto = W.partitionBy("series_id", "day").orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("series_id", "day")
    sums = {"s_all": F.sum(F.coalesce("support", F.lit(0.0))), "s_up": F.sum(F.greatest(F.coalesce("support", F.lit(0.0)), F.lit(0.0))), "s_known": F.count("support")}
    r = r.withColumns({k: v.over(upto) for k, v in sums.items()})
    r = r.withColumns({f"{k}_then": F.max(F.when(c("hour") == c("last_hour"), c(k))).over(whole) for k in sums})
    whole_way = c("s_known") - c("s_known_then") == c("lead")
    return r.withColumns({"support_sum": F.when(whole_way, c("s_all") - c("s_all_then")), "support_up": F.when(whole_way, c("s_up") - c("s_up_then"))})


def _shifted(rows: DataFrame, name: str, by: Column) -> DataFrame:
    """The working forecast moved by ``by`` to a tenth, in hours ahead."""
    r = rows.withColumn(f"d_{name}", F.when(c("lead") > 0, F.coalesce(tenth(by), F.lit(0.0))).otherwise(0.0))
    return r.withColumn("forecast_mw", F.when(c(f"d_{name}") != 0, tenth(c("forecast_mw") + c(f"d_{name}"))).otherwise(c("forecast_mw")))


def _biased(rows: DataFrame) -> DataFrame:
    few = c("n_observed") < LEAST_OBSERVED
    early = F.when(few & (c("n_observed") == 2) & (c("r_last") * c("r_before") >= 0) & (F.abs(c("r_mean")) >= 500.0), tenth(S.clip(c("r_mean") * 0.5, -700.0, 700.0)))
    age = 24 - c("carried_hour")
    carried = F.when(few & early.isNull() & age.between(0, 8), S.clip(c("carried_mw") * 0.5 * F.pow(F.lit(0.75), age), -500.0, 500.0))
    r = _shifted(rows, "day_level", F.when(few, R.day_level_scale()))
    r = _shifted(_shifted(r, "early_carryover", early), "day_boundary", carried)
    r = _shifted(r, "transition", F.when(~few, tenth(R.transition_bias())))
    r = _shifted(r, "transition_prior", tenth(R.transition_prior()))
    primed = F.max(F.when((c("d_day_level") != 0) | (c("d_transition_prior") != 0), 1)).over(W.partitionBy("series_id", "day")) == 1
    low = c("served_mw") - 900.0
    return _shifted(r, "prior_stack_cap", F.when(few & primed & (c("n_observed") <= 1) & (c("forecast_mw") < low), low - c("forecast_mw")))


def _kept(factor: float, least: float) -> Column:
    """The change that leaves ``factor`` of the adjustment, if it is large enough."""
    change = tenth(c("adj") * factor) - c("adj")
    return F.when(F.abs(change) >= least, change)


def _positive_damping(off: bool, seen: tuple[int, int], hours: tuple[int, int], leads: tuple[int, int], base: float, weak: float, factor: float, least: float) -> Column:
    on = c("positive") & (c("adj") > 0) & (c("off") == F.lit(off)) & (c("base") >= base) & c("last_hour").between(*seen) & c("hour").between(*hours) & c("lead").between(*leads) & (c("support") <= weak)
    return F.when(on, _kept(factor, least))


def slope_damping(leads: int = 3, allowed: float = 300.0) -> Column:
    level = F.greatest("last_mw", "usual_then")
    factor = R.slope_factor(c("base"))
    over = c("forecast_mw") + c("adj") > tenth(level) + allowed
    change = tenth(c("adj") * factor) - c("adj")
    return F.when(c("positive") & (factor < 1) & (c("lead") <= leads) & over & (change < 0), change)


def morning_damping(ramp: float = 1000.0) -> Column:
    return F.when(F.greatest(c("a2") - c("a1"), c("a3") - c("a2")) >= ramp, _positive_damping(False, (7, 10), (10, 13), (2, 4), 300.0, 1800.0, 0.4, 100.0))


def _mean_slope() -> Column:
    return (c("a3") - c("a1")) / 2


def morning_ramp(from_hour: int = 7, hours: tuple[int, int] = (6, 11), leads: int = 2, slope: float = 1000.0, share: float = 0.25, most_delta: float = 900.0, most: float = 700.0, least: float = 100.0) -> Column:
    """Working mornings whose demand climbs: a negative adjustment may not take the next hours under a slower climb from
    the last actual, and is restored up to the forecast."""
    steady = F.least(c("a2") - c("a1"), c("a3") - c("a2"))
    floor = tenth(c("last_mw")) + tenth(F.least(_mean_slope() * share, F.lit(most_delta))) * c("lead")
    back = tenth(F.least(floor, c("forecast_mw")) - c("forecast_mw")) - c("adj")
    restore = tenth(F.least(F.greatest(back, F.lit(0.0)), F.lit(most), -c("adj")))
    on = ~c("positive") & (c("base") < 0) & ~c("off") & (c("last_hour") >= from_hour) & c("hour").between(*hours) & c("lead").between(1, leads) & (steady >= slope) & (_mean_slope() >= slope)
    return F.when(on & (c("forecast_mw") + c("adj") < floor) & (restore >= least), restore)


def evening_negative_damping(base: float = 500.0, latest: float = 600.0, mean: float = 300.0, factor: float = 0.45, least: float = 120.0) -> Column:
    on = c("negative") & c("off") & (c("base") <= -base) & (c("last_hour") >= 16) & c("hour").between(18, 20) & c("lead").between(1, 3) & (c("a3") - c("a2") >= latest) & (_mean_slope() >= mean) & (c("support") >= 0)
    return F.when(on, _kept(factor, least))


def continuity_floor(from_hour: int = 10, hours: tuple[int, int] = (10, 17), leads: int = 2, slope: float = -300.0, slack: float = 500.0, share: float = 0.25, most_slope: float = 300.0, most: float = 900.0, least: float = 100.0) -> Column:
    """Off days whose demand does not fall: near hours stay near the last actual or above it."""
    floor = tenth(c("last_mw")) - slack + F.least(F.greatest(tenth(_mean_slope()), F.lit(0.0)) * share, F.lit(most_slope))
    restore = tenth(F.least(floor - (c("forecast_mw") + c("adj")), F.lit(most)))
    on = c("negative") & c("off") & (c("last_hour") >= from_hour) & c("hour").between(*hours) & c("lead").between(1, leads) & (c("a3") - c("a2") >= slope) & (_mean_slope() >= slope)
    return F.when(on & (restore >= least), restore)


def near_floor(from_hour: int = 10, hours: tuple[int, int] = (10, 20), leads: int = 2, adjusted: float = 500.0, slack: float = 150.0, usual_slack: float = 1200.0, share: float = 0.25, most_drop: float = 400.0, most: float = 700.0, least: float = 100.0, decline: float = -500.0, factor: float = 0.25) -> Column:
    """A large negative adjustment may not take near hours far under the last actual or the usual level; of that floor
    little is kept where demand and its support fall."""
    slope = tenth(F.coalesce("slope", F.lit(0.0)))
    drop = F.least(F.greatest(-slope, F.lit(0.0)) * share, F.lit(most_drop))
    floor = F.greatest(tenth(c("last_mw")) - slack - drop, c("recent_same_business_type_mean") - usual_slack)
    short = floor - (c("forecast_mw") + c("adj"))
    falling = F.coalesce((slope <= decline) & (c("support") <= decline), F.lit(False))
    restore = tenth(F.least(short, F.lit(most), -c("adj")) * F.when(falling, factor).otherwise(1.0))
    on = c("negative") & (c("adj") <= -adjusted) & (c("last_hour") >= from_hour) & c("hour").between(*hours) & c("lead").between(1, leads)
    return F.when(on & (short > 0) & (restore >= least), restore)


def observed_ramp(seen: tuple[int, int] = (7, 10), hours: tuple[int, int] = (8, 11), leads: int = 2, over: float = 500.0, slope: float = 1200.0, off_latest: float = 2000.0, share: float = 0.85, off_share: float = 1.0, most_delta: float = 2200.0, most: float = 1200.0, off_most: float = 700.0, least: float = 100.0, support: float = 700.0, support_share: float = 0.5) -> Column:
    """Mornings that have begun to climb, unless the last hour was forecast too high: near hours are lifted to that
    climb, as far as yesterday or the recent mean supports it. Off days count by their last change."""
    latest, mean = c("a3") - c("a2"), _mean_slope()
    climbs = F.when(c("off"), (latest >= off_latest) & (mean >= slope)).otherwise((F.least(c("a2") - c("a1"), latest) >= slope) & (mean >= slope))
    delta = tenth(F.least(F.when(c("off"), latest * off_share).otherwise(mean * share), F.lit(most_delta)))
    floor = tenth(c("last_mw")) + F.least(delta, F.greatest(c("support") * support_share, F.lit(0.0))) * c("lead")
    lift = tenth(F.least(floor - (c("forecast_mw") + c("adj")), F.when(c("off"), off_most).otherwise(most)))
    on = c("last_hour").between(*seen) & c("hour").between(*hours) & c("lead").between(1, leads) & (c("r_last") > -over) & climbs & (c("support") >= support)
    return F.when(on & (lift >= least), lift)


def daytime_lift() -> Column:
    """Hot hours after residuals that stay positive: lifted by part of what the adjustment leaves of them, or to a floor
    by the last actual. Off days have lower limits, and their last two residuals may do. A single large last residual
    does on working days."""
    off, first, before, last = c("off"), c("r_first"), c("r_before"), c("r_last")
    by = lambda a, b: F.when(off, b).otherwise(a)  # noqa: E731  working days, off days
    positive = sum(((r > 0).cast("int") for r in (first, before, last)), F.lit(0))
    gate = (positive >= 2) & (last >= by(600.0, 350.0)) & (c("r_mean") >= by(600.0, 450.0)) & (c("r_most") >= by(1000.0, 700.0))
    tail_mean, tail_most = (before + last) / 2, F.greatest(before, last)
    tail = off & (before > 0) & (last >= 350.0) & (tail_mean >= 450.0) & (tail_most >= 600.0)
    strong = ~off & (last >= 900.0) & (c("r_most") >= 900.0) & (c("base") >= 0)
    on = ((c("base") >= F.when(tail, 0.0).otherwise(by(600.0, 250.0))) & (gate | tail)) | strong
    slope = F.coalesce("slope", F.lit(0.0))
    zero = lambda f: F.coalesce(f, F.lit(0.0))
    hot = (zero("temp_delta_24h") >= 3.0) | (zero("cooling_delta_24h") >= 1.0) | (zero("apparent_cooling_delta_24h") >= 1.0)
    hot = hot | F.when(off, (zero("discomfort_index") >= 70.0) | (zero("humidity") >= 85.0)).otherwise((zero("discomfort_index") >= 76.5) | (zero("apparent_temp_c") >= 30.0))
    shape = off | ~c("hour").isin(12, 13) | F.coalesce((c("lag_24h_hourly_delta") >= 600.0) & (c("recent_same_business_type_delta_mean") >= 600.0), F.lit(False))
    floor = tenth(c("last_mw")) + F.least(F.greatest(tenth(slope), F.lit(0.0)) * 0.25, F.lit(900.0)) * c("lead") - 300.0
    by_floor = F.greatest(floor - (c("forecast_mw") + c("adj")), F.lit(0.0)) * 0.5
    pressure = F.greatest(tenth(last), tenth(F.when(tail, tail_mean).otherwise(c("r_mean"))), tenth(F.when(tail, tail_most).otherwise(c("r_most"))) * 0.75)
    by_residual = F.greatest(pressure - F.greatest(c("adj"), F.lit(0.0)) - by(200.0, 0.0), F.lit(0.0)) * by(0.55, 0.8)
    lift = tenth(F.least(F.greatest(by_floor, by_residual), by(900.0, 800.0)))
    active = c("last_hour").between(8, 15) & c("lead").between(1, 3) & c("hour").between(by(10, 12), by(17, 15)) & on & (slope >= -800.0) & hot & shape
    return F.when(active & (lift >= 100.0), lift)


def _reduced(over: Column, share: Column | float, most: Column | float, least: Column | float, on: Column) -> Column:
    cut = tenth(F.least(over * share, most if isinstance(most, Column) else F.lit(most)))
    return F.when(on & (over > 0) & (cut >= least), -cut)


def post_lunch(slope: float = -700.0, support: float = 900.0, share: float = 0.35, buffer: float = 500.0, most: float = 900.0, least: float = 100.0) -> Column:
    """Hours 13 and 14 of working days after a clear fall at midday: no more than the last actual, part of the support
    and a buffer."""
    cap = tenth(c("last_mw")) + F.greatest(c("support"), F.lit(0.0)) * share + buffer
    on = ~c("off") & c("last_hour").between(12, 13) & c("hour").between(13, 14) & c("lead").between(1, 2) & (c("slope") <= slope) & (c("support") <= support)
    return _reduced(c("forecast_mw") + c("adj") - cap, 1.0, most, least, on)


def morning_warm(base: float = 500.0, temp: float = 2.0, cooling: float = 0.8, slack: float = 300.0, slopes: tuple[float, float] = (400.0, 1800.0), share: float = 0.75, most: float = 800.0, least: float = 100.0) -> Column:
    """Working mornings warmer than yesterday whose residuals are clearly negative: what stands over a climb from the
    last actual comes off in part."""
    climb = tenth(S.clip(F.coalesce("slope", F.lit(0.0)) + slack, *slopes))
    warm = (F.coalesce("temp_delta_24h", F.lit(0.0)) >= temp) | (F.coalesce("cooling_delta_24h", F.lit(0.0)) >= cooling)
    on = ~c("off") & (c("base") <= -base) & c("last_hour").between(6, 10) & c("hour").between(8, 11) & c("lead").between(1, 2) & warm
    return _reduced(c("forecast_mw") + c("adj") - (tenth(c("last_mw")) + climb * c("lead")), share, most, least, on)


def morning_anchor(over: float = 400.0, under: float = 300.0, leads: int = 4) -> Column:
    """Mornings forecast too high: what stands over the last actual and the support since comes off, unless demand
    climbs as steeply as is forecast. On working days that are much warmer than yesterday also without such a residual:
    then only what stands far over it, by half."""
    off, r, latest, mean = c("off"), c("r_last"), c("a3") - c("a2"), _mean_slope()
    high = r <= -over
    by_support = ~off & ~high & (r <= under)
    warm = (F.coalesce("temp_delta_24h", F.lit(0.0)) >= 3.0) | (F.coalesce("cooling_delta_24h", F.lit(0.0)) >= 2.0)
    climbs = F.when(off, (latest >= 4000.0) & (mean >= 2500.0) & (c("support_sum") >= 2500.0)).otherwise((latest >= 3000.0) & (mean >= 3000.0) & (c("support_sum") >= 2500.0) & (-r <= 650.0))
    above = c("forecast_mw") + c("adj") - (tenth(c("last_mw")) + c("support_sum") + F.when(by_support, 1200.0).otherwise(0.0))
    on = (c("last_hour") >= 8) & (c("last_hour") <= F.when(off, 9).otherwise(12)) & c("hour").between(9, 13) & c("lead").between(1, leads)
    on = on & ((high & ~F.coalesce(climbs, F.lit(False))) | (by_support & warm & (above >= 1200.0)))
    return _reduced(above, F.when(by_support, 0.5).when(off, 0.75).otherwise(1.0), 1000.0, F.when(by_support, 150.0).otherwise(100.0), on)


def afternoon_anchor(leads: int = 3) -> Column:
    """Afternoons forecast too high for some hours, and not climbing: what stands over the last actual and part of the
    support since comes off; more of it after a severe miss."""
    severe = (c("r_last") <= -1200.0) & (c("r_mean") <= -700.0)
    missed = ((c("r_last") <= -500.0) & (c("r_mean") <= -500.0)) | severe
    calm = c("slope").isNull() | (c("slope") <= F.when(severe, 1500.0).otherwise(900.0))
    above = c("forecast_mw") + c("adj") - (tenth(c("last_mw")) + c("support_up") * F.when(severe, 0.35).otherwise(0.6) + F.when(severe, 0.0).otherwise(350.0))
    on = c("last_hour").between(12, 15) & c("hour").between(14, 17) & c("lead").between(1, leads) & missed & calm
    return _reduced(above, F.when(severe, 1.0).otherwise(0.75), F.when(severe, 1500.0).otherwise(1200.0), F.when(severe, 150.0).otherwise(100.0), on)


def _stepped(rows: DataFrame, damp_negative: bool) -> DataFrame:
    base = c("r_weighted") * SHRINK
    if damp_negative:
        base = base * F.when((base < 0) & (c("last_hour") >= 12), 0.5).otherwise(1.0)
    many = c("n_observed") >= LEAST_OBSERVED
    r = rows.withColumn("base", F.when(many, S.clip(base, -MOST, MOST)))
    start = tenth(F.when(c("base") < 0, c("base") * R.recovery_factor()).otherwise(c("base")) * F.pow(F.lit(DECAY), c("lead") - 1))
    r = r.withColumn("d_observed_residual", F.when(many & (c("lead") > 0), start).otherwise(0.0))
    r = r.withColumns({"adj": c("d_observed_residual"), "positive": c("d_observed_residual") > 0})
    mitigated = tenth(c("adj") * R.positive_multiplier()) - c("adj")
    rules: dict[str, Callable[[], Column]] = {
        "positive_mitigation": lambda: F.when(c("positive") & (mitigated < 0), mitigated), "slope_damping": slope_damping, "morning_damping": morning_damping,
        "afternoon_damping": lambda: _positive_damping(False, (11, 20), (13, 23), (1, 6), 250.0, 900.0, 0.4, 100.0), "evening_damping": lambda: _positive_damping(True, (12, 23), (17, 20), (2, 6), 350.0, 600.0, 0.45, 120.0),
        "morning_ramp": morning_ramp, "evening_negative_damping": evening_negative_damping, "continuity_floor": continuity_floor, "near_floor": near_floor, "observed_ramp": observed_ramp,
        "daytime_lift": daytime_lift, "post_lunch": post_lunch, "morning_warm": morning_warm, "morning_anchor": morning_anchor, "afternoon_anchor": afternoon_anchor,
    }
    for name in STEPS[1:]:
        if name == "evening_negative_damping":
            r = r.withColumn("negative", c("adj") < 0)
        r = r.withColumn(f"d_{name}", F.when(many & (c("lead") > 0), F.coalesce(rules[name](), F.lit(0.0))).otherwise(0.0))
        r = r.withColumn("adj", tenth(c("adj") + c(f"d_{name}")))
    return r


def _evening_cut(x: Column, before: Column) -> Column:
    """What an evening hour loses against the corrected hour before: a rebound while demand and its support fall, or a
    level far over the last actual and the usual one."""
    now = x["forecast_mw"] + x["adj"]
    warm = F.greatest(F.coalesce(x["temp_delta_1h"], F.lit(0.0)), F.coalesce(x["cooling_delta_1h"], F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce(x["temp_c"], F.lit(0.0)) - 30.0, F.lit(0.0))
    allowed, floor, usual = F.least(warm * 120.0, F.lit(400.0)), tenth(x["last_mw"]) - 300.0, x["usual"]
    rebound = now - before > 800.0
    strong = F.coalesce(usual.isNotNull() & (x["lag_delta"] <= -800.0) & (x["recent_delta"] <= -800.0), F.lit(False))
    over = now - allowed - F.when(rebound, F.greatest(before, floor) + 600.0).when(strong, usual + 300.0).otherwise(F.greatest(floor, usual) + 600.0)
    cut = tenth(F.least(over * F.when(rebound, 1.0).otherwise(0.75), F.lit(900.0)))
    on = x["evening"] & before.isNotNull() & (x["lag_delta"] <= 200.0) & (x["recent_delta"] <= 200.0) & (over > 0) & (rebound | (over >= F.when(strong, 250.0).otherwise(500.0)))
    return F.when(F.coalesce(on & (cut >= 100.0), F.lit(False)), cut).otherwise(0.0)


def _folded(rows: DataFrame, shape_guard: bool) -> DataFrame:
    """Evening decline, then the shape guard: each hour looks at the corrected one before."""
    evening = (c("n_observed") >= LEAST_OBSERVED) & (c("last_hour") >= 15) & c("hour").between(16, 21) & c("lead").between(1, 2) & (c("a3") - c("a2") <= -500.0) & (_mean_slope() <= -300.0)
    guarded = (c("last_hour") >= 12) & ~c("falling") & c("hour").between(15, 19) if shape_guard else F.lit(False)
    of = {"hour": c("hour"), "forecast_mw": c("forecast_mw"), "adj": c("adj"), "lead": c("lead"), "last_mw": c("last_mw"), "usual": c("recent_same_business_type_mean"), "lag_delta": c("lag_24h_hourly_delta"), "recent_delta": c("recent_same_business_type_delta_mean"), "temp_c": c("temp_c"), "temp_delta_1h": c("temp_delta_1h"), "cooling_delta_1h": c("cooling_delta_1h"), "evening": F.coalesce(evening, F.lit(False)), "guarded": F.coalesce(guarded, F.lit(False)), "moved": (c("lead") > 0) & (c("n_observed") >= LEAST_OBSERVED)}
    days = rows.groupBy("series_id", "day").agg(F.sort_array(F.collect_list(F.struct(*[v.alias(k) for k, v in of.items()]))).alias("x"))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("before"), none.alias("shaped"), F.lit(None).cast("int").alias("hour"), F.array().cast("array<struct<hour:int,cut:double,lift:double,final:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cut = _evening_cut(x, acc["before"])
        plain = F.when(x["moved"], tenth(x["forecast_mw"] + tenth(x["adj"] - cut))).otherwise(x["forecast_mw"])
        low = acc["shaped"] - 1000.0
        lift = F.when(F.coalesce(x["guarded"] & (x["hour"] == acc["hour"] + 1) & (plain < low), F.lit(False)), tenth(low) - plain).otherwise(0.0)
        shaped = F.when(lift != 0, tenth(plain + lift)).otherwise(plain)
        one = F.struct(x["hour"].alias("hour"), (-cut).alias("cut"), lift.alias("lift"), shaped.alias("final"))
        return F.struct(plain.alias("before"), shaped.alias("shaped"), x["hour"].alias("hour"), F.concat(acc["out"], F.array(one)).alias("out"))

    folded = days.select("series_id", "day", F.explode(F.aggregate("x", start, step, lambda acc: acc["out"])).alias("y"))
    return rows.join(folded.select("series_id", "day", "y.hour", c("y.cut").alias("d_evening_decline"), c("y.lift").alias("d_shape_guard"), c("y.final").alias("final_mw")), ["series_id", "day", "hour"])


RISE, DROP, DROP_FALLING, DROP_BACKED = (1800.0, 2400.0, 3000.0), (1600.0, 2600.0, 3600.0), (1600.0, 2800.0, 4200.0), (2600.0, 4800.0, 6500.0)


def _ramped(rows: DataFrame) -> DataFrame:
    """The next three hours stay within a ramp around the last actual; a wider one down while demand falls, wider still
    on working days whose support falls."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(F.least(c("lead"), F.lit(3)), F.lit(1)).cast("int"))
    backed = ~c("off") & c("lag_24h_hourly_delta").isNotNull() & c("recent_same_business_type_delta_mean").isNotNull() & (c("support") <= -900.0)
    drop = F.when(c("falling") & F.coalesce(backed, F.lit(False)), F.greatest(at(DROP_FALLING), at(DROP_BACKED))).when(c("falling"), at(DROP_FALLING)).otherwise(at(DROP))
    held = F.least(F.greatest(c("final_mw"), c("last_mw") - drop), c("last_mw") + at(RISE))
    on = F.coalesce((c("last_hour") >= 10) & c("lead").between(1, 3) & (held != c("final_mw")), F.lit(False))
    r = rows.withColumn("d_ramp_guard", F.when(on, tenth(held) - c("final_mw")).otherwise(0.0))
    return r.withColumn("final_mw", F.when(on, tenth(held)).otherwise(c("final_mw")))


def correct(rows: DataFrame, damp_negative: bool = False, deweight_midday: bool = False, shape_guard: bool = False) -> DataFrame:
    """rows (series_id, ts, forecast_mw, actual_mw with null ahead; ``FEATURES``, actual_source, carried_mw and
    carried_hour where known) with the point and its bands corrected, and adjustment_mw, n_observed, last_hour, reasons
    (rules that moved the hour, in order) and moves: an array of (rule, mw). Observed hours never change."""
    own = [x for x in rows.columns if x != "forecast_mw"]
    with_off = rows if "is_non_business_day" in rows.columns else rows.withColumn("is_non_business_day", F.lit(None).cast("int"))
    r = _ramped(_folded(_stepped(_biased(_prepared(rows, day_state(with_off, deweight_midday))), damp_negative), shape_guard))
    moves = F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), c(f"d_{n}").alias("mw")) for n in RULES]), lambda m: F.abs(m["mw"]) > 1e-9)
    shift = c("final_mw") - c("served_mw")
    bands = {b: F.when(shift != 0, tenth(c(b) + shift)).otherwise(c(b)) for b in BANDS if b in rows.columns}
    kept = [bands[x].alias(x) if x in bands else c(x) for x in own]
    return r.select(*kept, c("served_mw").alias("forecast_mw"), c("final_mw").alias("corrected_mw"), shift.alias("adjustment_mw"), "n_observed", "last_hour", F.array_join(F.transform(moves, lambda m: m["rule"]), ",").alias("reasons"), moves.alias("moves"))


def trace(corrected: DataFrame) -> DataFrame:
    """One row for each hour and rule that moved it: place of the rule in their order, its name and MW."""
    order = F.create_map(*[F.lit(x) for pair in ((n, i) for i, n in enumerate(RULES)) for x in pair])
    return corrected.select("series_id", "ts", F.explode("moves").alias("m")).select("series_id", "ts", F.element_at(order, c("m.rule")).alias("step"), c("m.rule").alias("rule"), c("m.mw").alias("mw"))


def rule_counts(corrected: DataFrame) -> DataFrame:
    """For each series: hours moved by a rule, and the sum and extremes of its moves."""
    t = trace(corrected)
    return t.groupBy("series_id", "rule").agg(F.count("*").alias("hours"), F.sum("mw").alias("total_mw"), F.min("mw").alias("least_mw"), F.max("mw").alias("most_mw"))
