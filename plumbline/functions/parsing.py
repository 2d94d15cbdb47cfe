"""Grammars of printed survey values as Column functions.

Unreadable text gives null, never a guess.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grammars of whole strings.
BEARING = r"^([NS])\s*(\d{1,2})[°d]\s*(\d{1,2})['′]\s*(?:(\d{1,2}(?:\.\d+)?)[\"″])?\s*([EW])$"
ANGLE = r"^(\d{1,3})[°d]\s*(\d{1,2})['′]\s*(?:(\d{1,2}(?:\.\d+)?)[\"″])?$"
DISTANCE = r"^(\d+\.\d{2,3})['′]?(\s*\(T\))?$|^(\d{1,3}(?:,\d{3})+\.\d{2,3})['′](\s*\(T\))?$"
STATION = r"^(\d+)\+(\d{2}(?:\.\d+)?)$"
SQFT_PER_ACRE = 43560


def dms(d: Column, m: Column, s: Column) -> Column:
    return d.cast("double") + m.cast("double") / 60 + F.coalesce(s.cast("double"), F.lit(0.0)) / 3600


def _group(text: Column, grammar: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, grammar, i), F.lit(""))


def bearing_azimuth(text: Column) -> Column:
    """Azimuth of a quadrant bearing such as N 45°30'00\" E."""
    g = [_group(text, BEARING, i) for i in range(1, 6)]
    a = dms(g[1], g[2], g[3])
    north, east = g[0] == "N", g[4] == "E"
    return F.when(north & east, a).when(north, F.pmod(360 - a, F.lit(360.0))).when(east, 180 - a).otherwise(180 + a)


def azimuth_bearing(az: Column) -> Column:
    """Quadrant bearing to whole seconds; 60 seconds carry over."""
    quadrant = F.when(az < 90, az).when(az < 180, 180 - az).when(az < 270, az - 180).otherwise(360 - az)
    total = F.round(quadrant * 3600).cast("long")
    return F.format_string("%s %02d°%02d'%02d\" %s", F.when((az < 90) | (az >= 270), "N").otherwise("S"), F.expr("0L") + F.floor(total / 3600), F.floor(total / 60) % 60, total % 60, F.when(az < 180, "E").otherwise("W"))


def angle_degrees(text: Column) -> Column:
    return dms(*[_group(text, ANGLE, i) for i in range(1, 4)])


def distance_feet(text: Column) -> Column:
    """A plain or comma-grouped distance; the foot mark may lack on the plain branch only."""
    return F.regexp_replace(F.coalesce(_group(text, DISTANCE, 1), _group(text, DISTANCE, 3)), ",", "").cast("double")


def is_total(text: Column) -> Column:
    return F.coalesce(_group(text, DISTANCE, 2), _group(text, DISTANCE, 4)).isNotNull()


def station_feet(text: Column) -> Column:
    return _group(text, STATION, 1).cast("double") * 100 + _group(text, STATION, 2).cast("double")


def area_sqft(text: Column) -> Column:
    """Square feet of an area text in acres (AC) or square feet (SF, S.F.)."""
    number = r"^\*?([\d,]*\.?\d+)\s*"
    acres = F.regexp_replace(_group(text, number + r"AC\b", 1), ",", "").cast("double")
    feet = F.regexp_replace(_group(text, number + r"S\.?F\b", 1), ",", "").cast("double")
    return F.coalesce(acres * SQFT_PER_ACRE, feet)


def coordinate(text: Column) -> Column:
    """struct<axis, value>: N or Y is northing, E or X easting; 4 to 8 digits before the point."""
    axis = F.regexp_extract(text, r"\b([NYEX])\b", 1)
    value = F.regexp_replace(F.nullif(F.regexp_extract(text, r"(?<![\d,.])(\d[\d,]{3,9}(?:\.\d+)?)(?![\d,])", 1), F.lit("")), ",", "").cast("double")
    return F.struct(F.when(axis.isin("N", "Y"), "N").when(axis.isin("E", "X"), "E").alias("axis"), F.when((value >= 1000) & (value < 1e8), value).alias("value"))


def canonical_quotes(text: Column) -> Column:
    return F.translate(text, "‘’′“”″´`", "'''\"\"\"''")


def repair_bearing(text: Column) -> Column:
    """A bearing whose degree sign was read as another mark, or in lower case; other texts stay."""
    loose = r"(?i)^([ns])\s*(\d{1,2})[°'*\"d]\s*(\d{1,2})['′]\s*(\d{1,2}(?:\.\d+)?)[\"″]\s*([ew])$"
    fixed = F.concat(F.upper(F.regexp_extract(text, loose, 1)), F.lit(" "), F.regexp_extract(text, loose, 2), F.lit("°"), F.regexp_extract(text, loose, 3), F.lit("'"), F.regexp_extract(text, loose, 4), F.lit('" '), F.upper(F.regexp_extract(text, loose, 5)))
    return F.when(text.rlike(loose), fixed).otherwise(text)


def apparent_kind(text: Column) -> Column:
    """What a string looks like; the first rule wins."""
    return F.when(text.rlike(BEARING), "bearing").when(text.rlike(ANGLE), "angle").when(text.rlike(STATION), "station").when(text.rlike(DISTANCE), "distance").when(text.rlike(r"^\s*$"), "empty").otherwise("text")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def wildcard_match(pattern: Column, candidate: Column) -> Column:
    """A tag in which '?' stands for one character, or for none."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"([\\.\[\]{}()*+^$|-])", r"\\$1"), r"\?", ".?")
    return F.expr("true") & F.regexp(candidate, F.concat(F.lit("^"), body, F.lit("$")))


def repaired_coordinate(text: Column) -> Column:
    """A lettered coordinate without spaces, in upper case: a B between digits is an 8; a run of 6 to 8 digits gets its point before the last two."""
    plain = F.regexp_replace(F.upper(F.regexp_replace(text, r"\s", "")), r"(?<=[0-9.])B(?=[0-9.])", "8")
    return F.regexp_replace(plain, r"^([NE])[.:]?(\d{4,6})(\d{2})$", "$1$2.$3")


def readings(text: Column) -> Column:
    """array<struct<axis, value>> of the distinct ways to read a lettered coordinate: as written, and repaired."""
    lettered = r"^([NYEX])[.:]?(\d{4,8}(?:\.\d+)?)$"

    def read(t: Column) -> Column:
        axis = F.regexp_extract(t, lettered, 1)
        return F.struct(F.when(axis.isin("N", "Y"), "N").when(axis.isin("E", "X"), "E").alias("axis"), F.nullif(F.regexp_extract(t, lettered, 2), F.lit("")).cast("double").alias("value"))

    plain = F.upper(F.regexp_replace(text, r"\s", ""))
    return F.filter(F.array_distinct(F.array(read(plain), read(repaired_coordinate(text)))), lambda x: x["value"].isNotNull())


#: Phrases (lower case, single spaces) that say a number near them is no length.
GUARD_PHRASES = {
    "station": ("sta",),
    "area": ("ac", "acre", "acres", "sq ft", "sqft"),
    "notes": ("datum", "epoch"),
    "detail": ("detail",),
    "scale": ("not to scale", "nts"),
}


def _spaced_words(text: Column) -> Column:
    """Lower-case words apart by single spaces, one at each end; the points of initials go, other marks but + and ± part words."""
    initials = F.regexp_replace(F.lower(text), r"\b([a-z])\.", "$1")
    return F.concat(F.lit(" "), F.regexp_replace(initials, "[^a-z0-9+±]+", " "), F.lit(" "))


def context_guard(text: Column) -> Column:
    """Why a number in a text is no length: the first kind of GUARD_PHRASES with a phrase in the text; null if nothing speaks against it.

    A plus sign between digits is a station, a plus-minus sign an area.
    """
    words = _spaced_words(text)
    marks = {"station": text.rlike("[0-9][+][0-9]"), "area": text.contains("±")}
    kinds = [F.when(reduce(or_, [words.contains(f" {p} ") for p in phrases], marks.get(kind, F.lit(False))), F.lit(kind)) for kind, phrases in GUARD_PHRASES.items()]
    return F.coalesce(*kinds)


def survey_notation(text: Column) -> Column:
    """One way to write a bearing, an angle or a distance whose marks were misread; other texts lose spaces and bars only.

    Figures are read from the right, whatever stands between them: the last two are seconds, two before them minutes,
    the rest degrees. Compass letters at both ends make a bearing; an angle ends in a mark and has no decimal point, so
    that a length never turns into one; values out of range are left alone. A remark such as (T) stays at the end.
    """
    plain = F.upper(F.regexp_replace(canonical_quotes(text), r"[\s|\[\]]", ""))
    remark = F.regexp_extract(plain, r"\([^()]*\)$", 0)
    core = F.substring(plain, F.lit(1), F.length(plain) - F.length(remark))
    figures = F.ltrim(digits(core), F.lit("0"))
    size = F.length(digits(core))
    second, minute = F.right(digits(core), F.lit(2)), F.substring(digits(core), size - 3, F.lit(2))
    degree = F.coalesce(F.substring(digits(core), F.lit(1), size - 4).try_cast("int"), F.lit(0))
    ranged = (minute < "60") & (second < "60")
    read = F.concat(degree.cast("string"), F.lit("°"), minute, F.lit("'"), second, F.lit('"'))
    body = F.translate(core, "O", "°")  # a round degree mark
    from_, to = F.regexp_replace(F.left(core, F.lit(1)), r"\$", "S"), F.right(core, F.lit(1))
    bearing = body.rlike("^[NS$][^A-Z]+[EW]$") & size.between(5, 6) & ranged & (degree <= 90)
    angle = body.rlike("^[0-9][^A-Z.,]*[\"'*]$") & size.between(5, 7) & ranged & (degree < 360) & (figures != "")
    length = core.rlike(r"^[0-9][0-9,]*\.[0-9]{2,3}'?$")
    return F.when(bearing, F.concat(from_, read, to, remark)).when(angle, F.concat(read, remark)).when(length, F.concat(F.rtrim(core, F.lit("'")), remark)).otherwise(plain)
