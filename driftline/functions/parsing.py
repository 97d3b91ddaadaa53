"""Text to instants, angles, lengths and labels. Unreadable text gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import as_col

_ISO_FORMATS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd",
]
_TABLE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy/MM/dd HH:mm:ss",
]


def first_format(text: Column, formats: list[str]) -> Column:
    """Microseconds of the first format that reads the text (session time zone UTC)."""
    return F.coalesce(*[F.unix_micros(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def parse_instant_us(text) -> Column:
    """ISO-like or slashed dates; a trailing offset is applied, T and Z are optional."""
    raw = F.trim(as_col(text))
    plain = F.replace(F.replace(raw, F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    aware = F.unix_micros(F.try_to_timestamp(F.when(raw.rlike(r"[+-]\d\d:\d\d$"), raw)))
    return F.coalesce(first_format(plain, _ISO_FORMATS), aware)


def parse_table_instant_us(date, time) -> Column:
    """Date and time cells of an observation table; a blank time is midnight."""
    t = F.trim(as_col(time))
    t = F.when(t.isNull() | (t == ""), F.lit("00:00:00")).otherwise(t)
    return first_format(F.concat(F.trim(as_col(date)), F.lit(" "), t), _TABLE_FORMATS)


def decimal(text) -> Column:
    """Number with a decimal point or comma; blank or unreadable is NULL."""
    return F.replace(F.trim(as_col(text)), F.lit(","), F.lit(".")).try_cast("double")


def angle_deg(text, hours: bool = False) -> Column:
    """Decimal degrees, or sexagesimal parts split on colon, blank or h/m/s/d; hours scale parts by 15."""
    s = F.trim(as_col(text))
    s = F.trim(F.regexp_replace(s, r"^['\"]+|['\"]+$", ""))
    body = F.regexp_replace(F.ltrim(s), r"^[+-]+", "")
    parts = F.filter(F.split(body, r"[:hmsd\s]+"), lambda p: p != "")
    nums = F.transform(parts, lambda p: p.try_cast("double"))
    readable = (F.size(nums) > 0) & ~F.exists(nums, lambda n: n.isNull())
    size = sum(
        (F.coalesce(F.get(nums, F.lit(i)), F.lit(0.0)) / float(60**i) for i in (1, 2)),
        F.coalesce(F.get(nums, F.lit(0)), F.lit(0.0)),
    )
    sexa = F.when(s.startswith("-"), -size).otherwise(size)
    if hours:
        several = F.size(F.split(s, r"[:hmsd\s]+")) >= 2
        sexa = F.when(several, sexa * 15.0).otherwise(sexa)
    return F.coalesce(s.try_cast("double"), F.when(readable, sexa))


# Metres in a unit of aperture; bare numbers above the limit are millimetres.
APERTURE_UNITS = {"mm": 0.001, "cm": 0.01, "m": 1.0, "in": 0.0254, "inch": 0.0254, "ft": 0.3048}
BARE_LIMIT = 40.0


def aperture_m(text) -> Column:
    """First number of the text with the unit behind it, in metres. A decimal comma counts as a point."""
    s = F.replace(F.lower(F.trim(as_col(text))), F.lit(","), F.lit("."))
    number = F.regexp_extract(s, r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?", 0)
    behind = F.ltrim(F.substring(s, F.instr(s, number) + F.length(number), F.length(s)))
    value = number.try_cast("double")
    out = F.when(value > BARE_LIMIT, value / 1000.0).otherwise(value)
    for unit in sorted(APERTURE_UNITS, key=len):  # the longest name is tried first
        out = F.when(behind.startswith(unit), value * APERTURE_UNITS[unit] if unit != "m" else F.when(value > BARE_LIMIT, value / 1000.0).otherwise(value)).otherwise(out)
    return out


# File-name time patterns in order of trust.
NAME_TIME_PATTERNS = [
    r"(20\d{2})-(\d{2})-(\d{2})-(\d{2})(\d{2})(\d{2})?",
    r"(20\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})",
    r"(20\d{2})-(\d{2})-(\d{2})-(\d{2})-(\d{2})",
    r"(20\d{2})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})",
    r"(20\d{2})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})?",
    r"(20\d{2})_(\d{2})_(\d{2})_(\d{2})(\d{2})",
]


def instant_from_name_us(name) -> Column:
    """The first pattern that matches the base name and names a real instant wins; missing seconds are zero."""
    base = F.regexp_replace(as_col(name), r"^.*[/\\]", "")
    tries = []
    for pattern in NAME_TIME_PATTERNS:
        groups = pattern.count("(")
        part = [F.regexp_extract(base, pattern, i) for i in range(1, min(groups, 6) + 1)]
        sec = F.when(part[5] != "", part[5]).otherwise(F.lit("00")) if len(part) == 6 else F.lit("00")
        tries.append(F.unix_micros(F.try_to_timestamp(F.concat(*part[:5], sec), F.lit("yyyyMMddHHmmss"))))
    return F.coalesce(*tries)


# Filter labels and the name pieces that suggest them, first match wins.
FILTER_HINTS = [
    ("IR742", ["ir742", "742", "ir_742"]),
    ("IR685", ["ir685", "685", "ir_685"]),
    ("CH4", ["ch4", "890", "methane"]),
    ("R", ["_r_", "-r-", "red", "filter_r"]),
    ("G", ["_g_", "-g-", "green", "filter_g"]),
    ("B", ["_b_", "-b-", "blue", "filter_b"]),
    ("RGB", ["rgb", "colour", "color"]),
]


def filter_from_name(name) -> Column:
    low = F.lower(as_col(name))
    out = F.lit("UNKNOWN")
    for label, hints in reversed(FILTER_HINTS):
        out = F.when(low.rlike("|".join(hints)), F.lit(label)).otherwise(out)
    return out


def mid_exposure_us(header) -> Column:
    """Mid-exposure instant from a MAP of header keys.

    Date keys in order; a bare date takes the separate time key; all but the average keys are exposure starts and get
    half the exposure added; a Modified Julian Date is the last resort.
    """
    h = as_col(header)
    value = lambda k: F.nullif(F.trim(F.try_element_at(h, F.lit(k))), F.lit(""))
    clock = F.coalesce(*[value(k) for k in ("TIME-OBS", "TIME_OBS", "UT", "UTC", "TIME")])
    exp = F.coalesce(*[value(k).try_cast("double") for k in ("EXPTIME", "EXPOSURE", "TELAPSE", "INTTIME")])
    half = F.when((exp > 0) & (exp < 86400), F.round(exp * 5e5).cast("bigint")).otherwise(F.lit(0))
    raws = F.array(*[
        F.struct(value(k).alias("raw"), F.lit("AVG" in k).alias("mid"))
        for k in ("DATE-AVG", "DATE_AVG", "DATE-OBS", "DATE_OBS", "DATE")
    ])
    joined = lambda r: F.concat(F.substring(r, 1, 10), F.lit(" "), clock)
    spelled = F.flatten(F.transform(raws, lambda d: F.array(
        F.struct(d["raw"].alias("text"), d["mid"].alias("mid")),
        F.struct(F.when(d["raw"].rlike(r"^\d{4}"), joined(d["raw"])).alias("text"), d["mid"].alias("mid")),
    )))
    read = F.transform(
        spelled, lambda d: parse_instant_us(d["text"]) + F.when(d["mid"], F.lit(0)).otherwise(half)
    )
    found = [F.get(F.filter(read, lambda x: x.isNotNull()), F.lit(0))]
    mjd = F.coalesce(*[value(k).try_cast("double") for k in ("MJD-OBS", "MJD_OBS", "MJD")])
    found.append(F.round((mjd - 40587.0) * 86400.0 * 1e6).cast("bigint"))
    return F.coalesce(*found)


def observation_time_us(user_us, file_us) -> Column:
    """The file's time, unless the user's is on the same day and within two minutes; the user's when no file time."""
    u, f = as_col(user_us), as_col(file_us)
    day = F.lit(86_400_000_000)
    same_day = F.floor(u / day) == F.floor(f / day)
    agree = same_day & (F.abs(u - f) <= 120_000_000)
    return F.when(f.isNull() | agree, u).otherwise(f)


def observation_time_source(user_us, file_us) -> Column:
    u, f = as_col(user_us), as_col(file_us)
    picked = observation_time_us(u, f)
    return F.when(picked.isNull(), F.lit("none")).when(f.isNull() | ((picked == u) & u.isNotNull()), F.lit("user")).otherwise(
        F.lit("file")
    )
