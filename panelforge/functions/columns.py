"""Row-level functions as Spark columns: composition, robust scaling, geography, names, rules.

Everything here stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# fixed values -----------------------------------------------------------------
MAD_SCALE = 1.4826
EARTH_KM = 6371.0088
WILSON_Z = 1.959963984540054
KERNEL_EPSILON = 1e-12
#: WGS84 semi-major axis (m), squared eccentricity, and the standard parallel of the equal-area grid.
WGS84_A, WGS84_E2, EQUAL_AREA_LAT = 6378137.0, 0.00669437999014, 30.0


def over(*keys: str):
    return Window.partitionBy(*keys)


# composition ---------------------------------------------------------------------

def share(value: str, *keys: str) -> Column:
    """Closed share of a value within its keys."""
    return F.col(value) / F.sum(value).over(over(*keys))


def clr(part: str, *keys: str) -> Column:
    """Centred log-ratio of a positive part within its keys; a part <= 0 is an error."""
    checked = F.when(F.col(part) > 0, F.log(part)).otherwise(F.raise_error(F.lit("composition parts must be positive")).cast("double"))
    return checked - F.avg(F.log(part)).over(over(*keys))


def zero_replaced(value: str, *keys: str) -> Column:
    """Zeros become half of the row's least positive part (to be closed again)."""
    least = F.min(F.when(F.col(value) > 0, F.col(value))).over(over(*keys))
    return F.when(F.col(value) > 0, F.col(value)).otherwise(least * 0.5)


def zscore(value: str, *keys: str) -> Column:
    """Population z-score within keys; a constant is an error."""
    sd = F.stddev_pop(value).over(over(*keys))
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(over(*keys))) / sd).otherwise(F.raise_error(F.lit("constant column")).cast("double"))


def min_max(value: str, *keys: str, higher: bool = True) -> Column:
    """Min-max normalisation; flat columns become 1.0; ``higher=False`` turns it round."""
    lo, hi = F.min(value).over(over(*keys)), F.max(value).over(over(*keys))
    up = (F.col(value) - lo) / (hi - lo)
    return F.when(hi == lo, F.lit(1.0)).otherwise(up if higher else 1 - up)


# vectors -----------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, clipped to [0, 2]; zero vectors are at distance 1."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / scale))).otherwise(F.lit(1.0))


# geography -------------------------------------------------------------------------------

def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    h = F.least(F.lit(1.0), h)
    return EARTH_KM * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def equal_area_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area metres (WGS84 ellipsoid, standard parallel 30 degrees)."""
    e = math.sqrt(WGS84_E2)
    s0 = math.sin(math.radians(EQUAL_AREA_LAT))
    k0 = math.cos(math.radians(EQUAL_AREA_LAT)) / math.sqrt(1 - WGS84_E2 * s0 * s0)
    s = F.sin(F.radians(lat))
    q = (1 - WGS84_E2) * (s / (1 - WGS84_E2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return F.radians(lon) * (WGS84_A * k0), q * (WGS84_A / (2 * k0))


def block_id(lon: Column, lat: Column, size_km: float, shift_x: float = 0.0, shift_y: float = 0.0) -> Column:
    """Square block of an equal-area grid as ``column:row``; shifts are shares of a block."""
    x, y = equal_area_xy(lon, lat)
    side = size_km * 1000.0
    return F.concat_ws(":", F.floor(x / side + shift_x).cast("string"), F.floor(y / side + shift_y).cast("string"))


# names and codes ----------------------------------------------------------------------------

#: Compatibility forms folded to plain ones (NFKC) where names hold them: full-width letters and digits, ligatures, spaces, signs.
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_PLAIN = {**_WIDE, "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u3000": " ", "²": "2", "³": "3", "¹": "1", "ª": "a", "º": "o"}
_LONG = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "№": "no", "ß": "ss", "ς": "σ"}


def normal_name(name: Column) -> Column:
    """Compatibility forms and case folded, combining marks joined for yo and short i, yo folded to ye, runs of non-word characters to one space, trimmed."""
    folded = F.lower(F.translate(name, "".join(_PLAIN), "".join(_PLAIN.values())))
    for long, plain in {**_LONG, "е\u0308": "ё", "и\u0306": "й"}.items():
        folded = F.replace(folded, F.lit(long), F.lit(plain))
    folded = F.translate(folded, "ё", "е")
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


def display_name(name: Column, prefixes: list[str]) -> Column:
    """Strip the first prefix that fits and start with a capital."""
    cut = F.coalesce(*(F.when(F.lower(name).startswith(p), F.substring(name, len(p) + 1, 1 << 20)) for p in prefixes), name)
    cut = F.trim(cut)
    return F.concat(F.upper(F.substring(cut, 1, 1)), F.substring(cut, 2, 1 << 20))


def first_match(name: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Ordered substring classification, case-insensitive."""
    low = F.lower(name)
    return F.coalesce(*(F.when(low.contains(part), F.lit(kind)) for part, kind in rules), F.lit(otherwise))


def text_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "true", F.lit(False))


# rules -----------------------------------------------------------------------------------------

#: Least peer share of a core, least precision and Jaccard of a stable one; largest peer share and Jaccard of a transition.
STABILITY = {"core_peer": 0.85, "core_precision": 0.75, "core_jaccard": 0.65, "transition_peer": 0.75, "transition_jaccard": 0.5}


def stability_class(peer: Column, precision: Column, jaccard: Column, micro: Column, limits: dict[str, float] = STABILITY) -> Column:
    """Units of a micro class are unresolved; a core unit's class is stable or else expansive; loose units are in transition."""
    core = peer >= limits["core_peer"]
    tight = (precision >= limits["core_precision"]) & (jaccard >= limits["core_jaccard"])
    loose = (peer < limits["transition_peer"]) & (jaccard < limits["transition_jaccard"])
    resolved = F.when(core, F.when(tight, "stable_core").when(~tight, "expansive_core")).when(loose, "transition")
    return F.coalesce(F.when(~micro, resolved), F.lit("unresolved"))


def transition_direction(left: Column, right: Column, left_name: str, right_name: str, least: int = 3) -> Column:
    """Votes to a direction; the right side wins when both reach ``least``."""
    return F.when(right >= least, f"{left_name}->{right_name}").when(left >= least, f"{right_name}->{left_name}").otherwise(f"{left_name}-{right_name}-middle")


def balance(left: Column, right: Column) -> Column:
    return F.when(left + right > 0, (left - right) / (left + right)).otherwise(F.lit(0.0))


def wilson(successes: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson interval; null bounds when n <= 0."""
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def ratio_direction(value: Column, base: Column, band: float = 0.02) -> Column:
    """above / below / near with a dead band around 1; null base ratio is undefined."""
    r = value / F.nullif(base, F.lit(0.0))
    return F.when(r.isNull(), "undefined").when(r > 1 + band, "above").when(r < 1 - band, "below").otherwise("near")


def two_sided(value: Column, high: str, low: str, least: float) -> Column:
    return F.when(value >= least, high).when(value <= -least, low).otherwise("middle")


def relative_difference(a: Column, b: Column) -> Column:
    """Symmetric: |a - b| over the mean of their sizes; 0 for two zeros."""
    size = (F.abs(a) + F.abs(b)) / 2
    return F.when(size > 0, F.abs(a - b) / size).otherwise(F.lit(0.0))


def metric(value: Column, reason: Column) -> Column:
    """Metric record: value and status; an undefined value is null with its reason."""
    return F.struct(F.when(reason.isNull(), value).alias("value"), F.coalesce(F.concat(F.lit("undefined:"), reason), F.lit("ok")).alias("status"))


# random numbers that any engine can repeat ------------------------------------------------------------

def hash_uniform(*parts: Column | int) -> Column:
    """Uniform in (0, 1) from integer keys: multiply modulo a prime and flip bits, twice for each key."""
    prime = 2147483647
    h: Column = F.lit(12345).cast("bigint")
    for p in parts:
        key = (F.lit(p) if isinstance(p, int) else p).cast("bigint") % prime
        h = (((h + key + 1) * 48271) % prime).bitwiseXOR(F.lit(1540483477))
        h = ((h * 16807 + 11) % prime).bitwiseXOR(F.lit(668265261))
    h = (h * 69621) % prime
    return (h + 0.5) / prime


def hash_normal(*parts: Column | int) -> Column:
    """Standard normal by Box-Muller from two hash draws."""
    return F.sqrt(-2 * F.log(hash_uniform(*parts, 1))) * F.cos(2 * math.pi * hash_uniform(*parts, 2))
