"""Time values of many formats and zones to microseconds since 1970-01-01 UTC.

All formats are one regular expression of alternatives with named groups. One replacement
writes the groups as a fixed list of components, so each value is matched once, inside
generated JVM code. Calendar ranges are checked on the components and the instant is put
together by integer day arithmetic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components in the order in which the replacement writes them.
FIELDS = ("y", "mo", "mon", "d", "p", "q", "h", "mi", "s", "f", "ap", "z", "u", "uf", "ue")

# First letters of month names (English, German, French, Spanish, Portuguese), accents removed.
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fev": 2, "mar": 3, "apr": 4, "avr": 4, "abr": 4, "may": 5, "mai": 5, "jun": 6, "juin": 6,
    "jul": 7, "juil": 7, "aug": 8, "aou": 8, "ago": 8, "sep": 9, "set": 9, "oct": 10, "okt": 10, "out": 10, "nov": 11,
    "dec": 12, "dez": 12, "dic": 12,
}

# Zone abbreviations in minutes east of Greenwich.
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

LOW_US, HIGH_US = 1104537600 * 10**6, 1924992000 * 10**6  # 2005-01-01 and 2031-01-01


def _pattern(unix: bool) -> str:
    def time(x: str, hour: str = r"\d{1,2}") -> str:
        return (
            rf"(?<h{x}>{hour})\s*[:時]\s*(?<mi{x}>\d{{2}})分?(?:[:](?<s{x}>\d{{2}})(?:[.,](?<f{x}>\d+))?)?"
            rf"(?:\s*(?<ap{x}>[ap]\.?m\b\.?))?(?:\s*(?:Uhr|h))?(?:\s*(?<z{x}>(?:UTC|GMT)?[+\-−]\d{{1,2}}(?::?\d{{2}})?|[A-Z]{{1,5}}))?"
        )

    day, weekday = r"\d{1,2}", r"(?:\p{L}{2,10}\.?,?\s+)?"
    name = r"\p{L}{3,10}"
    forms = [
        rf"(?<yA>\d{{4}})(?<dsA>[-/])(?<moA>{day})\k<dsA>(?<dA>{day})(?:(?:T|\s+){time('A')})?",
        r"(?<yB>\d{4})(?<moB>\d{2})(?<dB>\d{2})(?:T?(?<hB>\d{2})(?:(?<miB>\d{2})(?:(?<sB>\d{2})(?:\.(?<fB>\d+))?)?)?(?:\s*(?<zB>[+\-−]\d{2}:?\d{2}|[A-Z]{1,5}))?)?",
        rf"{weekday}(?<dC>{day})\.?(?:-|\s+(?:de\s+)?)(?<monC>{name})\.?,?(?:-|\s+(?:de\s+)?)(?<yC>\d{{4}}|\d{{2}})(?:,?\s+(?:(?:à|a las|às|um|at)\s+)?{time('C')})?",
        rf"{weekday}(?<monD>{name})\.?\s+(?<dD>{day})(?:st|nd|rd|th)?,?\s+(?<yD>\d{{4}})(?:,?\s+(?:at\s+)?{time('D')})?",
        rf"(?<wdE>\p{{L}}{{3}})\s+(?<monE>{name})\s+(?<dE>{day})\s+(?<hE>\d{{2}}):(?<miE>\d{{2}}):(?<sE>\d{{2}})(?:\s+(?<zE>[A-Z]{{1,5}}))?\s+(?<yE>\d{{4}})",
        rf"(?<yF>\d{{4}})年\s*(?<moF>{day})月\s*(?<dF>{day})日(?:\s*{time('F')})?",
        rf"(?<pG>{day})(?<dsG>[/.\-])(?<qG>{day})\k<dsG>(?<yG>\d{{4}})(?:,?\s+{time('G')})?",
    ]
    if unix:
        forms.insert(0, r"(?<uU>[+-]?\d+)(?:\.(?<ufU>\d*))?(?:E(?<ueU>[+-]?\d{1,3}))?")
    return "(?iu)^(?:" + "|".join(forms) + ")$"


def _components(value: Column, unix: bool) -> Column:
    """array<string> of FIELDS, or null where no form fits; one match per value."""
    pattern = _pattern(unix)
    groups = lambda f: [g for x in "ABCDEFGU" if f"(?<{(g := f + x)}>" in pattern]
    write = "\u0001" + "\u0002".join("".join(f"${{{g}}}" for g in groups(f)) for f in FIELDS)
    trimmed = F.regexp_replace(value, "^[\\s\\u00a0\\u3000\\ufeff]+|[\\s\\u00a0\\u3000\\ufeff]+$", "")
    found = F.regexp_replace(trimmed, pattern, write)
    return F.when(found.startswith("\u0001"), F.split(F.substring(found, 2, 10_000_000), "\u0002", -1))


def _lookup(key: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integers alone."""
    div = lambda a, b: F.floor(a / F.lit(b)).cast("bigint")
    yy = y - F.when(m <= 2, 1).otherwise(0)
    shifted = m + F.when(m > 2, -3).otherwise(9)
    return 365 * yy + div(yy, 4) - div(yy, 100) + div(yy, 400) + div(153 * shifted + 2, 5) + d - 1 - 719468


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def components(df: DataFrame, value: Column, unix: bool = False, zone: Column | None = None, order: Column | None = None) -> DataFrame:
    """df with _t_parts (one match per value, null where no form fits), _t_zone and _t_order; see ``utc_micros``."""
    null = F.lit(None).cast("string")
    parts = _components(value, unix)
    return df.select(*df.columns, parts.alias("_t_parts"), (null if zone is None else zone).alias("_t_zone"), (null if order is None else order).alias("_t_order"))


def assemble(df: DataFrame, out: str = "utc_us") -> DataFrame:
    """df of ``components`` with ``out`` instead of its _t_ columns.

    The steps are projections of their own, so that no component is computed twice.
    """
    keep = [c for c in df.columns if not c.startswith("_t_")]
    at = df.select(*keep, "_t_zone", "_t_order", *[F.col("_t_parts")[i].alias(f"_t_{f}") for i, f in enumerate(FIELDS)])
    part = lambda f: F.col(f"_t_{f}")
    num = lambda f: part(f).try_cast("int")
    plain = F.translate(F.lower(part("mon")), "áâãäéêèíîóôúûüç", "aaaaeeeiioouuuc")
    mdy = part("order") == "mdy"
    half = F.lower(F.substring(part("ap"), 1, 1))
    decimal = F.concat(part("u"), F.lit("."), part("uf"), F.lit("0"))
    at = at.select(
        *keep, "_t_zone", (F.length("_t_y") == 2).alias("_t_y2"), num("y").alias("_t_y"),
        F.coalesce(num("mo"), _lookup(F.substring(plain, 1, 4), MONTHS), _lookup(F.substring(plain, 1, 3), MONTHS), F.when(mdy, num("p")).otherwise(num("q"))).alias("_t_mo"),
        F.coalesce(num("d"), F.when(mdy, num("q")).otherwise(num("p"))).alias("_t_d"),
        F.when(half == "", F.coalesce(num("h"), F.lit(0))).when(num("h").between(1, 12), num("h") % 12 + F.when(half == "p", 12).otherwise(0)).alias("_t_h"),
        F.coalesce(num("mi"), F.lit(0)).alias("_t_mi"), F.coalesce(num("s"), F.lit(0)).alias("_t_s"),
        F.substring(F.rpad(part("f"), 6, "0"), 1, 6).try_cast("bigint").alias("_t_f"),
        F.lower(F.translate(part("z"), "−:", "-")).alias("_t_z"),
        (part("u") != "").alias("_t_number"),
        F.when(part("ue") == "", decimal).otherwise(F.concat(decimal, F.lit("E"), part("ue")).try_cast("double").cast("decimal(38,9)").cast("string")).try_cast("decimal(29,9)").alias("_t_x"),
    )
    x, z = part("x"), part("z")
    at = at.select(
        *keep, "_t_zone", "_t_z", "_t_mo", "_t_d", "_t_h", "_t_mi", "_t_s", "_t_f", "_t_number",
        (part("y") + F.when(part("y2"), F.when(part("y") < 70, 2000).otherwise(1900)).otherwise(0)).alias("_t_y"),
        F.regexp_extract(z, r"^(?:utc|gmt)?([+-])(\d{1,2})(?:\d\d)?$", 1).alias("_t_sign"),
        F.regexp_extract(z, r"^(?:utc|gmt)?([+-])(\d{1,2})(?:\d\d)?$", 2).try_cast("int").alias("_t_zh"),
        F.regexp_extract(z, r"\d{1,2}(\d\d)$", 1).try_cast("int").alias("_t_zm"),
        F.when(x < 10**11, F.floor(x * 1000000)).when(x < 10**14, F.floor(x * 1000)).when(x < 10**17, F.floor(x)).otherwise(F.floor(x / 1000)).try_cast("bigint").alias("_t_unix"),
    )
    year, month, day, hour, minute, second, fraction = (part(f) for f in ("y", "mo", "d", "h", "mi", "s", "f"))
    valid = (
        month.between(1, 12) & (day >= 1) & (day <= _month_days(year, month)) & (minute <= 59) & (second <= 59)
        & ((hour <= 23) | ((hour == 24) & (minute == 0) & (second == 0) & (fraction == 0)))
    )
    seconds = _days(year, month, day) * 86400 + hour * 3600 + minute * 60 + second
    zh, zm, sign = part("zh"), F.coalesce(part("zm"), F.lit(0)), F.when(part("sign") == "-", -1).otherwise(1)
    at = at.select(
        *keep, "_t_zone", "_t_z", "_t_number", "_t_unix",
        F.when(valid, seconds.cast("bigint") * 1_000_000 + fraction).alias("_t_wall"),
        F.when(part("sign") == "", _lookup(z, ZONES)).when((zh <= 14) & (zm <= 59), sign * (zh * 60 + zm)).cast("bigint").alias("_t_offset"),
    )
    wall = part("wall")
    local = F.when(part("zone").isNull(), wall).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), part("zone"))))
    micros = F.when(part("number"), part("unix")).when(part("z") == "", local).otherwise(wall - part("offset") * 60_000_000)
    at = at.select(*keep, micros.alias("_t_us"))
    return at.select(*[k for k in keep if k != out], F.when((part("us") >= LOW_US) & (part("us") < HIGH_US), part("us")).alias(out))


def utc_micros(df: DataFrame, value: Column, zone: Column | None = None, order: Column | None = None, unix: bool = False, out: str = "utc_us") -> DataFrame:
    """df with ``out``: bigint microseconds UTC of a time value in any known form, null where it is unusable.

    zone: IANA zone of values without one (UTC where null). order: "dmy" or "mdy" of all-numeric
    dates (dmy where null). unix: plain numbers are Unix times whose unit follows from their size.
    A wall-clock time that occurs twice is the first, a skipped one is read with the offset before
    the change. Null and empty values, impossible dates or times, unknown zones and
    instants outside 2005-2030 give null. Columns whose names begin with ``_t_`` are dropped.
    """
    return assemble(components(df, value, unix, zone, order), out)


def first_per_row(frames: list[DataFrame]) -> DataFrame:
    """table_name, row_id, utc_us: one row per distinct row_id with a usable value (the earliest, if copies differ).

    frames: of ``components`` over table_name and row_id. The instants are put together after the
    only shuffle, in which the aggregation finds its rows already together.
    """
    both = reduce(lambda a, b: a.unionByName(b), frames)
    whole = both.where(F.col("row_id").isNotNull()).repartition("table_name", "row_id")
    # Only the aggregate is filtered: a filter on a computed column would be pushed below the steps and repeat them.
    return assemble(whole).groupBy("table_name", "row_id").agg(F.min("utc_us").alias("utc_us")).where(F.col("utc_us").isNotNull())
