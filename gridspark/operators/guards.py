"""Guards on a day's forecast: bounded shifts of the point and its bands where a rule's conditions hold.

Input rows have the forecast, features of the same hour and is_non_business_day; "support" is the larger known one of
yesterday's and the recent mean hour-to-hour change. A rule reads its own row and the hour before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BANDS = ("p95_lower_mw", "p95_upper_mw", "p99_lower_mw", "p99_upper_mw")


def support() -> Column:
    return F.greatest("lag_24h_hourly_delta", "recent_same_business_type_delta_mean")


def _day() -> W:
    return W.partitionBy("series_id", F.to_date("ts")).orderBy("ts")


def shift(rows: DataFrame, by: Column) -> DataFrame:
    """The point and all bands moved by the same amount; a null amount is none."""
    moved = rows.withColumn("__shift", F.coalesce(by, F.lit(0.0)))
    return moved.withColumns({c: F.col(c) + F.col("__shift") for c in ("forecast_mw", *BANDS) if c in rows.columns}).drop("__shift")


def block_post_holiday_rise(rows: DataFrame, raw: str = "raw_mw") -> DataFrame:
    """Early hours (1-6) of the first day after three or more off days: a rise over the raw forecast is taken back."""
    active = F.hour("ts").between(1, 6) & (F.col("consec_holiday_len") >= 3) & (F.col("days_since_holiday_end") <= 1)
    rise = F.col("forecast_mw") - F.col(raw)
    return shift(rows, F.when(active & (rise > 0), -rise))


def block_hot_day_fall(rows: DataFrame, raw: str = "raw_mw", anomaly: float = 1.0) -> DataFrame:
    """Daytime (10-19) of a warm day: a fall under the raw forecast is taken back."""
    active = F.hour("ts").between(10, 19) & (F.col("temp_anomaly_doy") >= anomaly)
    fall = F.col(raw) - F.col("forecast_mw")
    return shift(rows, F.when(active & (fall > 0), fall))


def cap_over_yesterday(rows: DataFrame, base: float = 2500.0, per_degree: float = 1200.0, most: float = 5000.0, anomaly: float = 1.0) -> DataFrame:
    """Warm days of one type with the day before: at most yesterday's value and an allowance for the warming."""
    active = F.hour("ts").between(10, 19) & (F.col("temp_anomaly_doy") >= anomaly) & (F.col("lag_24h_business_type_mismatch") == 0)
    allowance = F.least(per_degree * F.greatest(F.lit(0.0), F.coalesce("temp_delta_24h", F.lit(0.0))), F.lit(most))
    over = F.col("forecast_mw") - (F.col("lag_24h") + base + allowance)
    return shift(rows, F.when(active & (over > 0), -over))


def lift_morning_shape(rows: DataFrame, share: float = 0.75, least: float = 100.0, most: float = 800.0, slack: float = 250.0, shortfall: float = 700.0) -> DataFrame:
    """Mornings (6-7) of off days: a forecast far under the hour before plus support is lifted part of the way."""
    full = F.lag("forecast_mw").over(_day()) + support()
    gap = (full - slack - F.col("forecast_mw")) * share
    active = F.hour("ts").between(6, 7) & (F.col("is_non_business_day") == 1) & (full - F.col("forecast_mw") >= shortfall) & (gap >= least)
    return shift(rows, F.when(active, F.least(gap, F.lit(most))))


def guard_daytime(rows: DataFrame, raw: str = "raw_mw", heat: float = 2.0, heat_offset: float = 300.0, anomaly: float = 1.0, warm_offset: float = 250.0, most_offset: float = 900.0, cap: tuple[float, float, float] = (2500.0, 1200.0, 5000.0)) -> DataFrame:
    """Daytime (10-19) of hot days after holidays (or a working day whose day a week before was off), and of warm working
    days: a fall under the raw forecast is taken back and an offset added, then yesterday's value with an allowance for
    the warming caps it. In late hours of a warm day whose demand usually falls, the fall stays and no offset is added.
    Needs lag_168h_off besides the features."""
    c, on = F.col, lambda x: F.coalesce(x, F.lit(False))
    work = on(c("is_non_business_day") == 0)
    after = on((c("consec_holiday_len") >= 3) & (c("days_since_holiday_end") <= 1)) | (work & on(c("lag_168h_off") == 1))
    hot, warm = after & on(c("temp_anomaly_7d") >= heat), work & on(c("temp_anomaly_doy") >= anomaly)
    falls = warm & F.hour("ts").between(15, 19) & on((c("recent_same_business_type_delta_mean") <= 0) & (c("lag_24h_hourly_delta") <= 500.0))
    drop = c("forecast_mw") - c(raw)
    base = F.when((drop < 0) & ~falls, c(raw)).otherwise(c("forecast_mw"))
    offset = F.least(F.greatest(F.when(hot, heat_offset), F.when(warm & (drop <= 0), F.when(falls, 0.0).otherwise(warm_offset)), F.lit(0.0)), F.lit(most_offset))
    allowed = F.least(_warming("temp_delta_24h", "cooling_delta_24h") * cap[1], F.lit(cap[2]))
    top = F.when(on(c("lag_24h_business_type_mismatch") > 0), F.lit(None)).otherwise(c("lag_24h") + cap[0] + allowed)
    active = F.hour("ts").between(10, 19) & (hot | warm)
    return shift(rows, F.when(active, F.least(base + offset, top) - c("forecast_mw")))


def pull_midday(rows: DataFrame, drop: float = -500.0, excess: float = 300.0, share: float = 0.75, most: float = 900.0, soft_most: float = 1200.0, soft: float = -300.0, soft_from: int = 10) -> DataFrame:
    """Hour 12 of working days where yesterday or the recent mean falls clearly: a forecast over the hour before plus the
    expected change, the mean of those falls, is pulled toward it. Where the day has softened already, the steepest fall
    is expected, the lower quartile of recent ones among them, and more may come off."""
    c = F.col
    softer = F.coalesce((c("same_day_latest_actual_hour") >= soft_from) & ((c("same_day_latest_hourly_delta") <= soft) | (c("same_day_recent_hourly_delta_mean") <= soft)), F.lit(False))
    falls = F.filter(F.array("lag_24h_hourly_delta", "recent_same_business_type_delta_mean", F.when(softer, c("recent_same_business_type_delta_q25"))), lambda x: x <= drop)
    mean = F.aggregate(falls, F.lit(0.0), lambda a, x: a + x) / F.size(falls)
    expected = F.when(F.size(falls) > 0, F.when(softer, F.array_min(falls)).otherwise(mean))
    over = c("forecast_mw") - (F.lag("forecast_mw").over(_day()) + expected)
    active = (F.hour("ts") == 12) & (c("is_non_business_day") == 0) & (over >= excess)
    return shift(rows, F.when(active, -F.least(over * share, F.when(softer, soft_most).otherwise(most))))


def flatten_spikes(rows: DataFrame) -> DataFrame:
    """Single hours of working days that stand over both neighbours without support of lags, weather or the day so far
    (13-17), or far over them in the morning (8-11), are lowered; so are mornings (8-10) that climb too steeply on days
    that warm. The neighbour before is the corrected one, so a day is one ordered fold over its hours."""
    names = ("temp_delta_24h", "cooling_delta_24h", "discomfort_delta_24h", "same_day_latest_hourly_delta")
    known = rows.withColumns({c: F.lit(None).cast("double") for c in names if c not in rows.columns})
    weather = F.greatest("temp_delta_24h", "cooling_delta_24h")
    calm = F.coalesce((support() <= 500.0), F.lit(True)) & F.coalesce(weather <= 2.0, F.lit(True)) & F.coalesce(F.col("same_day_latest_hourly_delta") <= 900.0, F.lit(True))
    signal = F.coalesce(weather.between(1.5, 6.0), F.lit(False)) | F.coalesce(F.col("discomfort_delta_24h") >= 2.0, F.lit(False))
    at = F.struct("hour", "forecast_mw", support().alias("support"), calm.alias("calm"), signal.alias("signal"), F.coalesce(weather <= 3.5, F.lit(True)).alias("mild"), (F.col("is_non_business_day") == 0).alias("work"))
    day = known.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")})
    days = day.groupBy("series_id", "day").agg(F.sort_array(F.collect_list(at)).alias("d"))
    zero = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast("array<struct<hour:int,cut:double>>").alias("out"))

    def _cut(prev: Column, x: Column) -> Column:
        now, following, hour = x["forecast_mw"], x["next"], x["hour"]
        peak, middle = now - F.greatest(prev, following), (prev + following) / 2
        beyond = (now - prev) - x["support"]
        slope = hour.between(8, 10) & (now - prev >= 4000.0) & (beyond >= 900.0) & x["signal"]
        local = hour.between(8, 11) & (peak >= 1000.0) & (now - following >= 800.0) & (beyond >= 1000.0)
        blocked = F.coalesce(local & ~x["mild"], F.lit(False))
        slope, local = F.coalesce(slope & ~blocked, F.lit(False)), F.coalesce(local & ~blocked, F.lit(False))
        morning = F.least((now - middle - F.when(slope, 400.0).otherwise(700.0)) * 0.75, F.lit(1400.0))
        morning = F.when((slope & (morning >= 100.0)) | (local & ~slope & (morning >= 150.0)), morning)
        later = F.least((now - middle - 450.0) * 0.75, F.lit(700.0))
        later = F.when(hour.between(13, 17) & x["calm"] & (peak >= 600.0) & (later >= 100.0), later)
        return F.when(x["work"] & prev.isNotNull() & following.isNotNull(), F.coalesce(morning, later, F.lit(0.0))).otherwise(0.0)

    def _spike(acc: Column, x: Column) -> Column:
        cut = F.coalesce(_cut(acc["prev"], x), F.lit(0.0))
        return F.struct((x["forecast_mw"] - cut).alias("prev"), F.concat(acc["out"], F.array(F.struct(x["hour"].alias("hour"), cut.alias("cut")))).alias("out"))

    following = F.zip_with("d", F.concat(F.slice("d", 2, 24), F.array(F.lit(None))), lambda a, b: F.struct(*[a[n].alias(n) for n in ("hour", "forecast_mw", "support", "calm", "signal", "mild", "work")], b["forecast_mw"].alias("next")))
    cuts = days.select("series_id", "day", F.explode(F.aggregate(following, zero, _spike, lambda acc: acc["out"])).alias("x")).select("series_id", "day", "x.hour", "x.cut")
    out = day.join(cuts, ["series_id", "day", "hour"], "left")
    return shift(out, -F.col("cut")).select(rows.columns)


def day_profile(rows: DataFrame, weather: DataFrame, calendar: DataFrame, hours: tuple[int, int] = (10, 17)) -> DataFrame:
    """(series_id, day, is_off, run, temp_anomaly): temp_anomaly is the day's mean daytime temperature over that of the
    seven days before, null where those have less than a day's daytime hours."""
    w = weather.where(F.hour("ts").between(*hours) & F.col("temp_c").isNotNull()).groupBy("series_id", F.to_date("ts").alias("day")).agg(F.sum("temp_c").alias("t"), F.count("*").alias("n"))
    week = W.partitionBy("series_id").orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    w = w.withColumns({"before": F.sum("t").over(week), "before_n": F.sum("n").over(week)})
    anomaly = F.when(F.col("before_n") >= hours[1] - hours[0] + 1, F.col("t") / F.col("n") - F.col("before") / F.col("before_n"))
    days = rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count("actual_mw").alias("n_actual"))
    cal = F.broadcast(calendar.select("day", "is_off", F.col("run_before").alias("run")))
    return days.join(cal, "day").join(w.select("series_id", "day", anomaly.alias("temp_anomaly")), ["series_id", "day"], "left")


def analogous_days(days: DataFrame, targets: DataFrame, most: int = 5, run_tolerance: int = 2, temp_tolerance: float = 4.0) -> DataFrame:
    """For each target day (series_id, day, is_off, run, temp_anomaly) the latest days before it of its day type, within
    a month of its season, with a similar run of off days; and a similar temperature, where both are known.

    Days meet by series, day type, month and year: a target looks into three months of its own year and the one before,
    some 90 days each, and only those that are short of ``most`` look further back. So pairs grow with the days, not
    with their square."""
    t = targets.select("series_id", F.col("day").alias("target"), F.col("is_off").alias("t_off"), F.col("run").alias("t_run"), F.col("temp_anomaly").alias("t_temp"))
    enough = days.where(F.col("n_actual") >= 12) if "n_actual" in days.columns else days
    d = enough.select("series_id", "day", "is_off", "run", "temp_anomaly", F.year("day").alias("y"), F.month("day").alias("m"))
    month = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(F.month("target") + k - 1, F.lit(12)) + 1))
    near = (F.col("day") < F.col("target")) & (F.abs(F.col("run") - F.col("t_run")) <= run_tolerance) & F.coalesce(F.abs(F.col("temp_anomaly") - F.col("t_temp")) <= temp_tolerance, F.lit(True))
    cells = t.withColumn("tm", month)

    def met(cells: DataFrame, years: Column) -> DataFrame:
        keyed = cells.withColumn("ty", years)
        return keyed.join(d, (keyed.series_id == d.series_id) & (keyed.t_off == d.is_off) & (keyed.tm == d.m) & (keyed.ty == d.y)).where(near).select(keyed.series_id, "target", "day")

    recent = met(cells, F.explode(F.array(F.year("target"), F.year("target") - 1)))
    full = recent.groupBy("series_id", "target").count().where(F.col("count") >= most).select("series_id", "target")
    first = days.agg(F.min(F.year("day"))).first()[0]
    out = recent
    if first is not None:
        older = F.sequence(F.lit(first), F.year("target") - 2)
        short = cells.join(full, ["series_id", "target"], "left_anti").where(F.year("target") - 2 >= first)
        out = recent.unionByName(met(short, F.explode(older)))
    rank = F.row_number().over(W.partitionBy("series_id", "target").orderBy(F.desc("day")))
    return out.withColumn("rank", rank).where(F.col("rank") <= most)


def analog_shift(rows: DataFrame, analogs: DataFrame, share: float = 0.7, single_share: float = 0.5, most: float = 2500.0) -> DataFrame:
    """rows with the point and bands moved by what the analogous days had over their own forecasts at the same hour, in
    part, and n_analogs. Days without analogs stay."""
    residual = rows.where("actual_mw is not null and forecast_mw is not null").select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), (F.col("actual_mw") - F.col("forecast_mw")).alias("residual"))
    counts = analogs.groupBy("series_id", "target").agg(F.count("*").alias("n_analogs"))
    mean = analogs.join(residual, ["series_id", "day"]).groupBy("series_id", "target", "hour").agg(F.avg("residual").alias("residual"))
    r = rows.withColumns({"__day": F.to_date("ts"), "__hour": F.hour("ts")})
    keyed = lambda df, *names: df.withColumnsRenamed(dict(names))
    r = r.join(keyed(counts, ("target", "__day")), ["series_id", "__day"], "left").join(keyed(mean, ("target", "__day"), ("hour", "__hour")), ["series_id", "__day", "__hour"], "left")
    by = F.col("residual") * F.when(F.col("n_analogs") == 1, single_share).otherwise(share)
    moved = shift(r, F.greatest(F.lit(-most), F.least(F.lit(most), by)) * F.when(by.isNotNull(), 1.0))
    return moved.select(*rows.columns, F.coalesce("n_analogs", F.lit(0)).alias("n_analogs"))


def guard_chain(rows: DataFrame) -> DataFrame:
    """All guards in their order over rows whose raw_mw is the forecast before the shift of analogous days; the forecast
    after each stage is a column: analog_mw, guarded_mw, midday_mw, shaped_mw."""
    r = rows.withColumn("analog_mw", F.col("forecast_mw"))
    for rule in (block_post_holiday_rise, guard_daytime, limit_analog_fall, lift_morning_shape, lift_return_shortfall, cap_return_excess, cap_afternoon_analog, cap_declining_analog, limit_afternoon_fall):
        r = rule(r)
    r = pull_midday(r.withColumn("guarded_mw", F.col("forecast_mw")))
    return flatten_spikes(r.withColumn("midday_mw", F.col("forecast_mw"))).withColumn("shaped_mw", F.col("forecast_mw"))


# Rules on business days after a change of day type, and on the shift that analogous days have given (forecast - raw).


def _warming(*columns: str) -> Column:
    return F.greatest(F.lit(0.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


def _returns(hours: tuple[int, ...]) -> Column:
    """Hours of a working day whose day before was of the other type."""
    return F.hour("ts").isin(*hours) & (F.col("is_non_business_day") == 0) & (F.col("lag_24h_business_type_mismatch") > 0)


def warm_day_offset(rows: DataFrame, upward: float = 250.0, anomaly: float = 1.0, lag_rise: float = 500.0, scale: float = 1.0) -> DataFrame:
    """Daytime (10-19) of warm working days is lifted a little; not in late hours (15-19) where both yesterday and the
    recent mean of the day type fall."""
    declining = F.hour("ts").between(15, 19) & (F.col("recent_same_business_type_delta_mean") <= 0) & (F.col("lag_24h_hourly_delta") <= lag_rise * scale)
    active = F.hour("ts").between(10, 19) & (F.col("is_non_business_day") == 0) & (F.col("temp_anomaly_doy") >= anomaly)
    return shift(rows, F.when(active & ~F.coalesce(declining, F.lit(False)), F.lit(upward * scale)))


def limit_analog_fall(rows: DataFrame, raw: str = "raw_mw", support_least: float = 500.0, slack: float = 900.0, scale: float = 1.0) -> DataFrame:
    """Off days (7-15): a fall from the raw forecast is taken back where the change before it rises, or the raw forecast
    is not far above the mean of its day type."""
    backed = F.coalesce(support() >= support_least * scale, F.lit(False)) | F.coalesce(F.col(raw) <= F.col("recent_same_business_type_mean") + slack * scale, F.lit(False))
    fall = F.col(raw) - F.col("forecast_mw")
    return shift(rows, F.when(F.hour("ts").between(7, 15) & (F.col("is_non_business_day") == 1) & (fall > scale) & backed, fall))


#: Share of a shortfall that is made up, by hour of the return.
RETURN_SHARES = {6: 0.25, 7: 0.35, 8: 0.45, 9: 0.50, 10: 0.30, 11: 0.20}


def lift_return_shortfall(rows: DataFrame, gap: float = 6000.0, slack: float = 1000.0, most: float = 1000.0, shape: float = 800.0, veto_from: int = 7, veto_lead: int = 3, veto: float = 1200.0, scale: float = 1.0) -> DataFrame:
    """Mornings (6-11) of a return to work where the usual level is far over yesterday's: a forecast under that level is
    lifted part of the way, unless its own rise is as steep as usual, or an hour observed shortly before has shown the
    forecast to be too high."""
    usual = F.col("recent_same_business_type_mean")
    steep = F.col("recent_same_business_type_delta_mean") - (F.col("forecast_mw") - F.lag("forecast_mw").over(_day()))
    seen = F.col("same_day_latest_actual_hour")
    then = F.filter(F.collect_list(F.struct(F.hour("ts").alias("h"), F.col("forecast_mw").alias("f"))).over(_day().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), lambda x: x["h"] == seen)
    lead = F.hour("ts") - seen
    vetoed = F.coalesce((seen >= veto_from) & lead.between(1, veto_lead) & (F.get(then, F.lit(0))["f"] - F.col("same_day_latest_actual_mw") >= veto * scale), F.lit(False))
    share = F.element_at(F.create_map(*[F.lit(x) for kv in RETURN_SHARES.items() for x in kv]), F.hour("ts"))
    short = usual - slack * scale - F.col("forecast_mw")
    active = _returns(tuple(RETURN_SHARES)) & (usual - F.col("lag_24h") >= gap * scale) & F.coalesce(steep >= shape * scale, F.lit(True)) & ~vetoed & (short > 0)
    return shift(rows, F.when(active, F.least(short * share, F.lit(most * scale))))


def cap_return_excess(rows: DataFrame, gap: float = 1000.0, slack: float = 500.0, per_degree: float = 100.0, most_degrees: float = 300.0, share: float = 0.6, most: float = 900.0, strong: float = 700.0, shape_share: float = 0.35, most_shape: float = 650.0, strong_share: float = 0.25, scale: float = 1.0) -> DataFrame:
    """Mornings (8-11) of a return to work: a forecast over the usual level and its allowances for warming and, from 9
    on, for a strong rise is lowered part of the way; less of it where the rise is strong."""
    usual = F.col("recent_same_business_type_mean")
    warm = F.least(_warming("temp_delta_24h", "cooling_delta_24h", "temp_anomaly_doy") * per_degree * scale, F.lit(most_degrees * scale))
    rises = F.coalesce((F.hour("ts") >= 9) & (support() >= strong * scale), F.lit(False))
    shape = F.when(rises, F.least(support() * shape_share, F.lit(most_shape * scale))).otherwise(0.0)
    over = F.col("forecast_mw") - (usual + slack * scale + warm + shape)
    active = _returns((8, 9, 10, 11)) & (usual - F.col("lag_24h") >= gap * scale) & (over > 0)
    return shift(rows, F.when(active, -F.least(over * F.when(rises, strong_share).otherwise(share), F.lit(most * scale))))


def cap_afternoon_analog(rows: DataFrame, raw: str = "raw_mw", least: float = 600.0, support_most: float = 900.0, allowed: float = 300.0, degrees: float = 0.5, per_degree: float = 120.0, most_degrees: float = 300.0, scale: float = 1.0) -> DataFrame:
    """Afternoons (13-16) of warming working days: a rise over the raw forecast without support keeps an allowance."""
    warm, rise = _warming("temp_delta_24h", "cooling_delta_24h"), F.col("forecast_mw") - F.col(raw)
    keep = allowed * scale + F.least(warm * per_degree * scale, F.lit(most_degrees * scale))
    active = F.hour("ts").between(13, 16) & (F.col("is_non_business_day") == 0) & (rise >= least * scale) & (warm >= degrees) & F.coalesce(support() <= support_most * scale, F.lit(True)) & (rise > keep)
    return shift(rows, F.when(active, keep - rise))


def cap_declining_analog(rows: DataFrame, raw: str = "raw_mw", least: float = 300.0, allowed: float = 100.0, support_most: float = 200.0, degrees: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Afternoons and evenings (13-20) of working days like the day before, without warming or support: a rise over the
    raw forecast keeps a small allowance."""
    rise = F.col("forecast_mw") - F.col(raw)
    active = F.hour("ts").between(13, 20) & (F.col("is_non_business_day") == 0) & (F.col("lag_24h_business_type_mismatch") == 0) & (rise >= least * scale) & (_warming("temp_delta_24h", "cooling_delta_24h") <= degrees) & (support() <= support_most * scale)
    return shift(rows, F.when(active & (rise > allowed * scale), allowed * scale - rise))


def limit_afternoon_fall(rows: DataFrame, raw: str = "raw_mw", least: float = 600.0, allowed: float = 300.0, degrees: float = 0.5, support_least: float = -700.0, slack: float = 900.0, scale: float = 1.0) -> DataFrame:
    """Afternoons (13-16) of warming working days: a fall from the raw forecast is limited, unless the changes before it
    fall steeply or the raw forecast is far over the mean of its day type."""
    fall = F.col(raw) - F.col("forecast_mw")
    backed = F.coalesce(support() >= support_least * scale, F.lit(True)) & F.coalesce(F.col(raw) <= F.col("recent_same_business_type_mean") + slack * scale, F.lit(True))
    active = F.hour("ts").between(13, 16) & (F.col("is_non_business_day") == 0) & (fall > least * scale) & (_warming("temp_delta_24h", "cooling_delta_24h") >= degrees) & backed
    return shift(rows, F.when(active & (fall > allowed * scale), fall - allowed * scale))
