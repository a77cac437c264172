"""Fixed values shared by operators: bands, buckets, limits."""

OBSERVED, OBSERVED_LEGACY, FALLBACK = "observed", "observed_legacy", "reference_forecast_fallback"
#: Evaluation bands: name, first hour, last hour.
TIME_BANDS = (("overnight", 0, 5), ("morning", 6, 10), ("daytime", 11, 15), ("late_afternoon", 16, 18), ("evening", 19, 23))
#: Bands of the daily-level features.
DAY_PARTS = (("night", 0, 5), ("morning", 6, 11), ("afternoon", 12, 17), ("evening", 18, 23))
#: Lead buckets in minutes, lower end excluded.
LEAD_BUCKETS = ((0, 120), (120, 240), (240, 480), (480, 1440))
COOLING_BASE, HEATING_BASE = 22.0, 18.0
#: Season zones by day of year: first, last, zone.
SEASON_ZONES = ((115, 132, 1), (220, 235, 2), (358, 366, 3), (1, 10, 3))
Z95, Z99 = 1.96, 2.576
#: Monthly humidity where nothing better is known.
SEASONAL_HUMIDITY = {1: 52.0, 2: 54.0, 3: 58.0, 4: 63.0, 5: 68.0, 6: 75.0, 7: 78.0, 8: 76.0, 9: 72.0, 10: 66.0, 11: 61.0, 12: 56.0}
DEFAULT_HUMIDITY = 65.0
#: Public holidays with a fixed date (month, day), for test calendars; a real calendar is an input table.
FIXED_HOLIDAYS = ((1, 1), (2, 11), (2, 23), (4, 29), (5, 3), (5, 4), (5, 5), (8, 11), (11, 3), (11, 23))
