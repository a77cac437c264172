"""Gated experts: the point forecast of an hour from several fitted models, chosen and blended by what the hour is.

An expert is a column, so any fitted model that Spark can score serves; ``linear`` makes one from coefficients. Gates are
expressions of the row; only the daily level looks at the other hours of its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S

#: Share of the lag expert, the change of cooling degrees where it is left out and from which on it is whole.
LAG_SHARE, NO_LAG, FULL_LAG = 0.5, -4.0, 0.0
#: Share of the view without humidity changes, of the full view on days off, and the trust region around the full view.
VIEW_SHARE, OFF_FULL_SHARE, TRUST_MW = 0.5, 0.4, 500.0
#: Share of the specialist on days off, where lags are there and where they are not.
OFF_SHARE, UNAVAILABLE_OFF_SHARE = 0.5, 1.0
LEVEL_SHARE, LEVEL_MW = 0.2, 750.0
#: Where one of these is unknown, the models without lags speak.
LAGS = ("lag_24h", "lag_last_biz_hour", "lag_last_nonhol_hour")


def linear(coefficients: dict[str, float], intercept: float = 0.0) -> Column:
    """A fitted linear model as a column; null where a feature is."""
    return sum((F.col(name) * weight for name, weight in coefficients.items()), F.lit(intercept))


def lag_share() -> Column:
    """Share of the lag expert: less on working days after a day of the other type on which cooling demand falls."""
    part = S.clip((F.col("cooling_delta_24h") - NO_LAG) / (FULL_LAG - NO_LAG), 0.0, 1.0)
    moves = (F.col("lag_24h_business_type_mismatch") > 0) & (F.col("is_non_business_day") == 0) & part.isNotNull()
    return F.when(F.coalesce(moves, F.lit(False)), LAG_SHARE * part).otherwise(LAG_SHARE)


def _mixed(direct: Column, lag_residual: Column, share: Column | float) -> Column:
    """direct and yesterday plus its residual; direct alone on days off or where yesterday is unknown."""
    s = share if isinstance(share, Column) else F.lit(share)
    both = (1 - s) * direct + s * (F.col("lag_24h") + lag_residual)
    return F.when((F.col("is_non_business_day") == 0) & both.isNotNull(), both).otherwise(direct)


def view(direct: Column, lag_residual: Column, specialist: Column, with_lag: Column) -> Column:
    """One view's forecast: lag blend on working days where lags are whole, specialist blend on days off."""
    work = F.when(with_lag, _mixed(direct, lag_residual, lag_share())).otherwise(direct)
    return F.when(F.col("is_non_business_day") == 0, work).otherwise((1 - OFF_SHARE) * direct + OFF_SHARE * specialist)


def gated(rows: DataFrame, full: dict[str, Column], no_humidity: dict[str, Column], robust: dict[str, Column], unavailable: dict[str, Column], partial: Column | None = None, level: Column | None = None) -> DataFrame:
    """rows plus legacy_mw (the full view's plain blend), forecast_mw and gates, the names of the gates that decided.

    Views are dictionaries of direct, lag_residual and non_business; ``unavailable`` of direct and non_business.
    ``partial`` says where lags are only in part there: the lag expert is left out then. ``level`` is the daily model's
    mean of the day; complete days move toward it, in part and not far."""
    off, whole = F.col("is_non_business_day") == 1, ~F.coalesce(partial if partial is not None else F.lit(False), F.lit(False))
    no_lags = F.lit(False)
    for c in LAGS:
        no_lags = no_lags | F.col(c).isNull()
    r = rows.withColumn("legacy_mw", _mixed(full["direct"], full["lag_residual"], LAG_SHARE))
    r = r.withColumn("__view", VIEW_SHARE * view(no_humidity["direct"], no_humidity["lag_residual"], no_humidity["non_business"], whole) + (1 - VIEW_SHARE) * view(robust["direct"], robust["lag_residual"], robust["non_business"], whole))
    r = r.withColumn("__held", F.col("legacy_mw") + S.clip(F.col("__view") - F.col("legacy_mw"), -TRUST_MW, TRUST_MW))
    r = r.withColumn("__view_mw", F.when(off, OFF_FULL_SHARE * F.col("legacy_mw") + (1 - OFF_FULL_SHARE) * F.col("__held")).otherwise(F.col("__held")))
    without = F.when(off, (1 - UNAVAILABLE_OFF_SHARE) * unavailable["direct"] + UNAVAILABLE_OFF_SHARE * unavailable["non_business"]).otherwise(unavailable["direct"])
    r = r.withColumns({"__no_lags": no_lags, "__moved": F.lit(0.0)}).withColumn("forecast_mw", F.when(F.col("__no_lags"), without).otherwise(F.col("__view_mw")))
    if level is not None:
        day = W.partitionBy("series_id", F.to_date("ts"))
        now = F.when(F.count("forecast_mw").over(day) == 24, F.avg("forecast_mw").over(day))
        r = r.withColumn("__moved", F.coalesce(S.clip(LEVEL_SHARE * (level - now), -LEVEL_MW, LEVEL_MW), F.lit(0.0))).withColumn("forecast_mw", F.col("forecast_mw") + F.col("__moved"))
    attenuated = (lag_share() < LAG_SHARE) & whole & ~F.col("__no_lags")
    names = {"lags_unavailable": F.col("__no_lags"), "partial_lags": ~whole & ~F.col("__no_lags"), "attenuated": attenuated, "specialist": off, "trust_region": (F.abs(F.col("__view") - F.col("legacy_mw")) > TRUST_MW) & ~F.col("__no_lags"), "daily_level": F.col("__moved") != 0}
    gates = F.array_join(F.array_compact(F.array(*[F.when(on, n) for n, on in names.items()])), ",")
    return r.withColumn("gates", gates).select(*rows.columns, "legacy_mw", "forecast_mw", "gates")
