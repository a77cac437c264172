"""Column expressions on one row: time, weather, text and number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def band(hour: Column, bands=C.TIME_BANDS) -> Column:
    out = F.lit(None).cast("string")
    for name, first, last in bands:
        out = F.when(hour.between(first, last), name).otherwise(out)
    return out


def season_zone(day: Column) -> Column:
    doy, out = F.dayofyear(day), F.lit(0)
    for first, last, zone in C.SEASON_ZONES:
        out = F.when(doy.between(first, last), zone).otherwise(out)
    return out


def lead_bucket(minutes: Column) -> Column:
    """Text of the bucket of a lead, its lower end excluded; null outside all of them."""
    out = F.lit(None).cast("string")
    for low, high in C.LEAD_BUCKETS:
        out = F.when((minutes > low) & (minutes <= high), f"{low}-{high}").otherwise(out)
    return out


def clip(x: Column, low, high) -> Column:
    """x within bounds; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_double(text: Column) -> Column:
    """The number in a text; blanks and anything else are null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def degree(temp: Column, base: float, cooling: bool = True) -> Column:
    over = temp - base if cooling else F.lit(base) - temp
    return F.when(temp.isNotNull(), F.greatest(F.lit(0.0), over))


def discomfort_index(temp: Column, humidity: Column) -> Column:
    return 0.81 * temp + 0.01 * humidity * (0.99 * temp - 14.3) + 46.3


def apparent_temperature(temp: Column, humidity: Column, wind: Column | None = None) -> Column:
    """From temperature, humidity and wind (1 m/s where unknown, never negative); the temperature without humidity."""
    speed = F.lit(1.0) if wind is None else F.coalesce(F.when(wind.isNotNull(), F.greatest(F.lit(0.0), wind)), F.lit(1.0))
    vapor = humidity / 100 * 6.105 * F.exp(17.27 * temp / (237.7 + temp))
    return F.coalesce(temp + 0.33 * vapor - 0.70 * speed - 4.0, temp)


def seasonal_humidity(day: Column) -> Column:
    out = F.lit(C.DEFAULT_HUMIDITY)
    for month, value in C.SEASONAL_HUMIDITY.items():
        out = F.when(F.month(day) == month, value).otherwise(out)
    return out


def add_source(current: Column, added: str) -> Column:
    """A '+'-joined source list with one more source, each once."""
    parts = F.filter(F.split(F.coalesce(current, F.lit("")), r"\+"), lambda x: x != "")
    return F.array_join(F.array_union(parts, F.array(F.lit(added))), "+")


def source_category(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(s.contains("observ"), "observed").when(s.contains("fallback") | s.contains("seasonal"), "fallback").when(s.contains("forecast"), "forecast").otherwise("unknown")


def error_direction(bias: Column, mae: Column | None = None) -> Column:
    """over, under or neutral; with an MAE, mixed where the bias is small against it."""
    sign = F.when(bias > 0, "over").when(bias < 0, "under").otherwise("neutral")
    return sign if mae is None else F.when(F.abs(bias) < F.greatest(F.lit(100.0), 0.35 * mae), "mixed").otherwise(sign)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the row's canonical JSON; equal inputs have equal fingerprints."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def improvement_pct(reference: Column, candidate: Column) -> Column:
    return F.try_divide(reference - candidate, reference) * 100


def decay(rate: float, lead: Column) -> Column:
    return F.pow(F.lit(rate), lead)


def local_timestamp(day: Column, time: Column) -> Column:
    """From 'Y/M/D' and 'H:MM' without zero padding, null where that fails."""
    return F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("y/M/d H:mm"))


def to_local(ts: Column, zone: str = "Asia/Tokyo", source: str = "UTC") -> Column:
    """A time of one zone as the clock of another shows it."""
    return F.convert_timezone(F.lit(source), F.lit(zone), ts.cast("timestamp_ntz"))


def first_number(*values: Column) -> Column:
    """The first value that is a finite number."""
    return F.coalesce(*[finite(v.cast("double")) for v in values])


def compact_json(*fields: Column) -> Column:
    """A JSON object of the fields that are not null."""
    return F.to_json(F.struct(*fields))


def event_id(kind: Column, ts: Column) -> Column:
    """An event's id: its kind and the minute it begins."""
    return F.format_string("%s-%s", kind, F.date_format(ts, "yyyyMMddHHmm"))


def round_tenth(x: Column) -> Column:
    """To one decimal; a tie goes to the even digit."""
    return F.bround(x, 1)


def prefixed(values: Column, *prefixes: str) -> Column:
    """Of a map of named values the first one whose name begins with a prefix, prefixes in their order."""
    def of(prefix: str) -> Column:
        held = F.map_filter(values, lambda k, v: k.startswith(prefix) & v.isNotNull())
        return F.get(F.map_values(held), F.lit(0))

    return F.coalesce(*[of(p) for p in prefixes])
