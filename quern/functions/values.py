"""Functions of composite values: ranges, arrays, vectors, geometry, JSON, intervals, enums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Ranges as structs of lower, upper, lower_inc, upper_inc; a null bound is infinite


def make_range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(bounds[0] == "[").alias("lower_inc"), F.lit(bounds[1] == "]").alias("upper_inc"))


def range_empty(r: Column) -> Column:
    return F.coalesce((r["lower"] > r["upper"]) | ((r["lower"] == r["upper"]) & ~(r["lower_inc"] & r["upper_inc"])), F.lit(False))


def contains_value(r: Column, x: Column) -> Column:
    above = r["lower"].isNull() | (x > r["lower"]) | ((x == r["lower"]) & r["lower_inc"])
    below = r["upper"].isNull() | (x < r["upper"]) | ((x == r["upper"]) & r["upper_inc"])
    return above & below


def overlaps(a: Column, b: Column) -> Column:
    return ~range_empty(a) & ~range_empty(b) & ~before(a, b) & ~before(b, a)


def before(a: Column, b: Column) -> Column:
    """All of a lies below all of b."""
    return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def adjacent(a: Column, b: Column) -> Column:
    """They meet without a gap and without a common value."""
    meet = lambda x, y: (x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"])
    return F.coalesce(meet(a, b), F.lit(False)) | F.coalesce(meet(b, a), F.lit(False))


def contains_range(a: Column, b: Column) -> Column:
    low = a["lower"].isNull() | (a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))
    high = a["upper"].isNull() | (a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))
    return range_empty(b) | (F.coalesce(low, F.lit(False)) & F.coalesce(high, F.lit(False)))


# Integer arrays


def array_contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def array_subtract(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def array_index(a: Column, x: Column) -> Column:
    """Place of x from 1, or 0."""
    return F.array_position(a, x)


# Vectors and points as arrays of double


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def taxicab(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cube_union(a: Column, b: Column) -> Column:
    """The least box that holds two points."""
    return F.struct(F.zip_with(a, b, F.least).alias("lo"), F.zip_with(a, b, F.greatest).alias("hi"))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6378168.0) -> Column:
    """Distance on the surface of the earth, in metres."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(h))


def polygon_area(points: Column) -> Column:
    """Area of a simple polygon of structs x, y."""
    following = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x)) / 2


def slope(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.when(x1 == x2, F.lit(float("inf"))).otherwise((y2 - y1) / (x2 - x1))


def circle_area(radius: Column) -> Column:
    return F.pi() * radius * radius


# JSON text


def json_has_key(j: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(j), key), F.lit(False))


def json_contains(j: Column, pairs: dict[str, str]) -> Column:
    """Top-level members with these values as text."""
    out = F.lit(True)
    for k, v in pairs.items():
        out = out & F.coalesce(F.get_json_object(j, f"$.{k}") == v, F.lit(False))
    return out


def json_set(j: Column, key: str, value: Column, schema: str = "map<string,string>") -> Column:
    """A member of a flat object replaced or added."""
    old = F.map_filter(F.from_json(j, schema), lambda k, _: k != key)
    return F.to_json(F.map_concat(old, F.create_map(F.lit(key), value.cast("string"))))


# Intervals as months, days, seconds


def justify_hours(seconds: Column) -> Column:
    """Whole days of 24 hours and the rest."""
    days = F.when(seconds < 0, F.ceil(seconds / 86400)).otherwise(F.floor(seconds / 86400))
    return F.struct(days.cast("long").alias("days"), (seconds - days * 86400).alias("seconds"))


def justify_days(days: Column) -> Column:
    """Whole months of 30 days and the rest."""
    months = F.when(days < 0, F.ceil(days / 30)).otherwise(F.floor(days / 30))
    return F.struct(months.cast("long").alias("months"), (days - months * 30).cast("long").alias("days"))


# Enums: ordered labels


def enum_position(x: Column, labels: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), x)


def enum_min(x: Column, labels: list[str]) -> Column:
    """Aggregate: the label that comes first."""
    return F.element_at(F.array(*map(F.lit, labels)), F.min(F.nullif(enum_position(x, labels).cast("int"), F.lit(0))))


def num_nulls(*columns: Column) -> Column:
    return sum((c.isNull().cast("int") for c in columns), F.lit(0))


def bool_text(s: Column) -> Column:
    """The spellings of truth values; null for others."""
    t = F.lower(F.trim(s))
    yes = F.lit(False)
    no = F.lit(False)
    for word in ("true", "yes", "on"):
        yes = yes | ((F.lit(word).startswith(t)) & (t != "") & ((t != "o")))
    for word in ("false", "no", "off"):
        no = no | ((F.lit(word).startswith(t)) & (t != "") & ((t != "o")))
    return F.when(yes | (t == "1"), True).when(no | (t == "0"), False)


# Further document and range values

MAP = "map<string,string>"


def json_exists_any(j: Column, keys: list[str]) -> Column:
    """Whether an object has one of the keys."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(j), F.array(*map(F.lit, keys))), F.lit(False))


def json_exists_all(j: Column, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(j))) == 0, F.lit(False))


def json_concat(a: Column, b: Column) -> Column:
    """Members of both objects, those of the second where a key is in both; values as text."""
    one, two = F.from_json(a, MAP), F.from_json(b, MAP)
    return F.to_json(F.map_concat(F.map_filter(one, lambda k, _: ~F.map_contains_key(two, k)), two))


def json_delete(j: Column, key: str) -> Column:
    return F.to_json(F.map_filter(F.from_json(j, MAP), lambda k, _: k != key))


def avg_interval(start: Column, stop: Column) -> Column:
    """The mean of stop - start as an aggregate, in seconds with fractions."""
    return F.avg(stop.cast("double") - start.cast("double"))


def get_bit(x: Column, n: int) -> Column:
    """Bit n of an integer, the lowest being 0."""
    return F.shiftrightunsigned(x.cast("long"), n).bitwiseAND(F.lit(1)).cast("int")


def set_bit(x: Column, n: int, value: int) -> Column:
    mask = F.lit(1 << n).cast("long")
    return x.cast("long").bitwiseOR(mask) if value else x.cast("long").bitwiseAND(~(1 << n))


def range_intersection(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """[greatest lower, least upper) of two half-open ranges; null where they don't overlap."""
    lo, hi = F.greatest(lo1, lo2), F.least(hi1, hi2)
    return F.when(lo < hi, F.struct(lo.alias("lower"), hi.alias("upper")))


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    """A time of day as text, HH:MM:SS; null outside its range."""
    good = hour.between(0, 23) & minute.between(0, 59) & (second >= 0) & (second < 60)
    return F.when(good, F.format_string("%02d:%02d:%02d", hour, minute, F.floor(second)))
