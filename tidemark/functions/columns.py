"""Column expressions that several operators share; all are built-in functions underneath."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Text that stands for "not known".
TEXT_SENTINELS = ("UNKNOWN", "UNDEFINED", "N/A", "NONE", "NIL", "0")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a naive UTC timestamp (the session time zone has to be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def time_bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket of so many seconds, counted from the epoch."""
    return F.timestamp_micros(F.floor(micros(ts) / (seconds * 1_000_000)) * (seconds * 1_000_000)).cast("timestamp_ntz")


def boundaries_crossed(unit: str, later: Column, earlier: Column) -> Column:
    """How many borders of minute, hour or day lie between, unlike an elapsed-time difference."""
    size = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * 1_000_000
    return (F.floor(micros(later) / size) - F.floor(micros(earlier) / size)).cast("long")


def grid_cell(x: Column, size: float) -> Column:
    """Lower edge of the grid cell; the epsilon keeps points on a line in the cell that starts there."""
    return F.round(F.floor(x / size + F.lit(1e-9)) * size, 6)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two headings, 0 to 180."""
    return F.abs(signed_turn(a, b))


def signed_turn(a: Column, b: Column) -> Column:
    """Turn from b to a in [-180, 180)."""
    return F.pmod(a - b + 540.0, F.lit(360.0)) - 180.0


def clip(x: Column, low: float, high: float, null_value: float | None = None) -> Column:
    """x limited to [low, high]; null stays null or becomes null_value (least and greatest would skip it)."""
    return F.when(x.isNull(), F.lit(null_value)).when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def normal_text(x: Column) -> Column:
    """Upper case, outer blanks and @ padding gone, white space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.upper(F.trim(x, F.lit(" @"))), r"\s+", " ")), F.lit(""))


def known_text(x: Column) -> Column:
    """True if the normalised text says something."""
    return x.isNotNull() & ~x.isin(*TEXT_SENTINELS)


def valid_imo(x: Column) -> Column:
    """Seven digits, not all zero, the last one the checksum of the others times 7 to 2."""
    total = sum((F.substring(x, i + 1, 1).try_cast("int") * (7 - i) for i in range(6)), F.lit(0))
    shape = x.rlike("^[0-9]{7}$") & (x != "0000000")
    return F.coalesce(shape & (total % 10 == F.substring(x, 7, 1).try_cast("int")), F.lit(False))


def in_range(key: Column, low: int = 200_000_000, high: int = 799_999_999) -> Column:
    return key.between(low, high)


def valid_position(lat: Column, lon: Column) -> Column:
    """Inside the globe and not at (0, 0)."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def web_mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(3.141592653589793) / 4 + F.radians(lat) / 2))


#: Registries that the transport workers' federation lists as flags of convenience, second registers left out.
FLAGS_OF_CONVENIENCE = (
    "Antigua and Barbuda", "Bahamas", "Barbados", "Belize", "Bermuda", "Bolivia", "Cameroon", "Cayman Islands", "Comoros", "Cook Islands", "Curacao", "Cyprus", "Dominica", "Equatorial Guinea", "Eswatini",
    "Faroe Islands", "Gabon", "Gambia", "Georgia", "Gibraltar", "Guinea-Bissau", "Honduras", "Jamaica", "Lebanon", "Liberia", "Malta", "Madeira", "Marshall Islands", "Mauritius", "Moldova", "Mongolia", "Myanmar",
    "North Korea", "Niue", "Palau", "Panama", "Saint Kitts and Nevis", "Saint Vincent and the Grenadines", "San Marino", "Sao Tome and Principe", "Sierra Leone", "Sri Lanka", "Tanzania", "Togo", "Tuvalu", "Vanuatu",
)


def mid_of(mmsi: Column) -> Column:
    """The flag-state prefix of a ship station's number: its first three digits."""
    return F.floor(mmsi / 1_000_000).cast("int")


def is_foc(country: Column) -> Column:
    """Whether a country is listed as a flag of convenience; an unknown one is not."""
    return F.coalesce(country.isin(*FLAGS_OF_CONVENIENCE), F.lit(False))


def foc_status(country: Column) -> Column:
    return F.when(country.isNull(), "unknown_flag").when(is_foc(country), "foc").otherwise("not_foc")
