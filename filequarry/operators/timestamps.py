"""Timestamps written in many ways, brought to one UTC instant of microsecond precision.

All formats form one regex alternation with named groups. One regexp_replace turns a value into a list of its components;
everything after that is integer arithmetic inside whole-stage code generation. No Python touches a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filequarry.session import materialised

# Month names and the offsets, in minutes, of zone abbreviations.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "mär": 3, "okt": 10, "dez": 12,
}
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_DAY_NAME = r"(?:[A-Za-zäöü]{2,10})"
_OFFSET = r"[Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2}"
_ZONE = r"[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)*"
_CLOCK = r"(?<h>\d{1,2}):(?<i>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?"

#: One entry per way of writing. Group names: y year, m month, M month's name, d day, h i s f clock, p am or pm, z offset or zone
#: abbreviation, n zone name, e seconds since 1970, l milliseconds, u microseconds. Each is made unique by its format's number.
FORMATS = {
    "iso": rf"(?<y>\d{{4}})-(?<m>\d{{2}})-(?<d>\d{{2}})(?:[Tt ]{_CLOCK}(?: ?(?<z>{_OFFSET}))?(?: ?\[?(?<n>{_ZONE})\]?)?)?",
    "basic": rf"(?<y>\d{{4}})(?<m>\d{{2}})(?<d>\d{{2}})T(?<h>\d{{2}})(?<i>\d{{2}})(?<s>\d{{2}})(?:[.,](?<f>\d{{1,9}}))?(?<z>{_OFFSET})?",
    "digits": r"(?<y>\d{4})(?<m>\d{2})(?<d>\d{2})(?:(?<h>\d{2})(?<i>\d{2})(?<s>\d{2}))?",
    "pdf": r"D:(?<y>\d{4})(?:(?<m>\d{2})(?:(?<d>\d{2})(?:(?<h>\d{2})(?:(?<i>\d{2})(?<s>\d{2})?)?)?)?)?(?<z>[Zz](?:00'?00'?)?|[+-]\d{2}'?(?:\d{2}'?)?)?",
    "exif": rf"(?<y>\d{{4}}):(?<m>\d{{2}}):(?<d>\d{{2}}) {_CLOCK}(?<z>{_OFFSET})?",
    "dots": rf"(?<d>\d{{1,2}})\.(?<m>\d{{1,2}})\.(?<y>\d{{4}}|\d{{2}})(?:,? {_CLOCK}(?: Uhr)?)?",
    "day month year": rf"(?:{_DAY_NAME},? )?(?<d>\d{{1,2}})\.? (?<M>[A-Za-zä]{{3,9}})\.?,? (?<y>\d{{4}})(?:,? {_CLOCK}(?: Uhr)?(?: (?<z>{_OFFSET}|[A-Z]{{2,4}}))?)?",
    "ctime": rf"{_DAY_NAME} (?<M>[A-Za-zä]{{3,9}}) +(?<d>\d{{1,2}}) {_CLOCK}(?: (?<z>[A-Z]{{1,4}}|{_OFFSET}))? (?<y>\d{{4}})",
    "slashes": rf"(?<m>\d{{1,2}})/(?<d>\d{{1,2}})/(?<y>\d{{4}}|\d{{2}})(?:,? {_CLOCK} ?(?<p>[AaPp]\.?[Mm]\.?)?)?",
    "seconds": r"(?<e>\d{9,10})(?:\.(?<f>\d{1,9}))?",
    "milliseconds": r"(?<l>\d{12,13})",
    "microseconds": r"(?<u>\d{15,16})",
}
NO_ZONE = 9999  # a zone that was written but means nothing
_PARTS = "y m M d h i s f p z n e l u".split()


def _alternation() -> tuple[str, str]:
    """The pattern of all formats, and the replacement that lists a value's components."""
    names: dict[str, list[str]] = {k: [] for k in _PARTS}
    alternatives = []
    for number, pattern in enumerate(FORMATS.values()):
        for k in _PARTS:
            if f"(?<{k}>" in pattern:
                name = f"{k}{'x' if k == 'M' else ''}{number}"
                names[k].append(name)
                pattern = pattern.replace(f"(?<{k}>", f"(?<{name}>")
        alternatives.append(pattern)
    return r"\A\s*(?:" + "|".join(alternatives) + r")\s*\z", "|".join("".join("${%s}" % n for n in names[k]) for k in _PARTS)


PATTERN, COMPONENTS = _alternation()


def days_since_1970(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a date of the Gregorian calendar, from integers alone; years begin in March."""
    year = y - F.when(m <= 2, 1).otherwise(0)
    month = m + F.when(m <= 2, 9).otherwise(-3)
    of_year = F.floor((month * 153 + 2) / 5) + d - 1
    return (year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + of_year - 719468).cast("bigint")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])


def with_instant(df: DataFrame, raw: str, zone: str, out: str = "instant_us") -> DataFrame:
    """df with the microseconds since 1970-01-01 UTC that the text column `raw` denotes, or null.

    The column `zone` (an IANA name) holds for values without a zone of their own; a local time that occurs twice means the first,
    one that a change of clocks leaves out denotes nothing. Parts not given are zero. Null, empty, unreadable and impossible values
    give null, as do local times whose zone is null or unknown.

    Each step is a projection of its own: Catalyst keeps them apart where a result is used more than once, so that every
    component is worked out once and the generated code stays small.
    """
    kept = df.columns
    zero = F.lit(0).cast("bigint")
    # The regular expression leaves a text that no format fits as it is, without the separators.
    parts = df.select("*", F.split(F.regexp_replace(raw, PATTERN, COMPONENTS), r"\|").alias("_parts"))
    parts = parts.select(*kept, F.when(F.size("_parts") == len(_PARTS), F.col("_parts")).alias("_parts"))
    text = {k: F.nullif(F.col("_parts")[j], F.lit("")) for j, k in enumerate(_PARTS)}
    values = parts.select(*kept, *[(text[k].try_cast("bigint") if k in "ymdhiselu" else text[k]).alias(f"_{k}{'x' if k == 'M' else ''}") for k in _PARTS], F.length(text["y"]).alias("_width"))

    year = F.col("_y") + F.when(F.col("_width") == 2, 2000).otherwise(0)
    month = F.when(F.col("_Mx").isNotNull(), F.try_element_at(_map(MONTHS), F.lower("_Mx"))).otherwise(F.coalesce("_m", F.lit(1)))
    fraction = F.coalesce(F.rpad(F.substring("_f", 1, 6), 6, "0").try_cast("bigint"), zero)
    noon = F.when(F.upper(F.substring("_p", 1, 1)) == "P", 12).otherwise(0)
    hour = F.when(F.col("_p").isNull(), F.coalesce("_h", zero)).when(F.col("_h").between(1, 12), F.col("_h") % 12 + noon)
    digits = F.regexp_replace("_z", r"[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    sign = F.when(F.substring("_z", 1, 1) == "-", -1).otherwise(1)
    written = F.when(F.col("_z").rlike(r"^[+-]"), F.when((hours <= 18) & (minutes <= 59), sign * (hours * 60 + minutes))).when(
        F.col("_z").isNotNull(), F.try_element_at(_map(ABBREVIATIONS), F.upper(F.regexp_replace("_z", r"^([Zz]).*", "Z")))
    )
    fields = values.select(
        *kept, "_e", "_l", "_u", "_z", "_n", year.alias("_year"), month.cast("bigint").alias("_month"), F.coalesce("_d", F.lit(1)).alias("_day"), hour.alias("_hour"),
        F.coalesce("_i", zero).alias("_minute"), F.coalesce("_s", zero).alias("_second"), fraction.alias("_fraction"), written.alias("_written"), F.try_element_at(_map(ABBREVIATIONS), F.col("_n")).alias("_short"),
    )

    y, m, d = F.col("_year"), F.col("_month"), F.col("_day")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last) & F.col("_hour").between(0, 23) & (F.col("_minute") <= 59) & (F.col("_second") <= 59)
    local = ((days_since_1970(y, m, d) * 24 + F.col("_hour")) * 60 + F.col("_minute")) * 60_000_000 + F.col("_second") * 1_000_000 + F.col("_fraction")
    offset = F.when(F.col("_z").isNotNull(), F.coalesce("_written", F.lit(NO_ZONE))).otherwise(F.col("_short"))
    known = sorted(df.sparkSession.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    name = F.when(offset.isNull(), F.coalesce("_n", zone))
    placed = fields.select(*kept, "_e", "_l", "_u", "_fraction", F.when(valid, local).alias("_local"), offset.cast("bigint").alias("_offset"), F.when(name.isin(known), name).alias("_name"))
    moved = placed.select("*", F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_name")).alias("_utc"))
    regional = F.when(F.from_utc_timestamp("_utc", F.col("_name")) == F.timestamp_micros("_local"), F.unix_micros("_utc"))
    dated = F.when(F.col("_offset").isNull(), regional).when(F.col("_offset") != NO_ZONE, F.col("_local") - F.col("_offset") * 60_000_000)
    return moved.select(*kept, F.coalesce(F.col("_e") * 1_000_000 + F.col("_fraction"), F.col("_l") * 1000, F.col("_u"), dated).alias(out))


def field_texts(meta: str = "meta_data") -> dict[str, Column]:
    """The texts of crawl records that hold timestamps: fdate, sort_date, and dcterms:created of the metadata (of a list, its first entry)."""
    created = F.get_json_object(meta, "$['dcterms:created']")
    first = F.get_json_object(meta, "$['dcterms:created'][0]")
    return {"fdate": F.col("fdate"), "sort_date": F.col("sort_date"), meta: F.when(F.substring(created, 1, 1) == "[", first).otherwise(created)}


def normalise_fields(records: DataFrame, pools: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each record and timestamp field: the columns of `keep`, field, raw, instant_us (null where it denotes no instant).

    A record without a pool, or of an unknown one, keeps the instants that name their own zone. Further columns are ignored.
    """
    zones = pools.select(F.col("pool").alias("_pool"), F.col("tz").alias("_tz")).where("_pool is not null").dropDuplicates(["_pool"])
    texts = field_texts()
    joined = records.select(*keep, F.col("pool").alias("_of"), *[c.alias(f"_raw_{k}") for k, c in texts.items()]).join(zones, F.col("_of") == F.col("_pool"), "left")
    long = joined.select(*keep, "_tz", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"_raw_{k}").alias("raw")) for k in texts])).alias("_v"))
    return with_instant(long.select(*keep, "_tz", "_v.field", "_v.raw"), "raw", "_tz").drop("_tz")


CHUNKS = 64  # parts in which the records of one way of writing one instant are gathered


def same_instant_pairs(records: DataFrame, pools: DataFrame) -> DataFrame:
    """Pairs of records of one device and path that write one instant of a field differently: field, rec_a, rec_b (rec_a < rec_b).

    Records with a null device, path or id are in no pair; a record given twice under one id is in no pair with itself.

    Records are first gathered by what they write, in CHUNKS parts and combined before they are shuffled, and these parts are joined:
    the copies of an unchanged file, however many, never meet each other, and each instant is worked out once.
    """
    dated = normalise_fields(records, pools, ["rec_id", "device_id", "path"])
    # Written once, as both sides of the join read it; filters and the join's exchange are then shared.
    dated = materialised(dated.select("rec_id", "device_id", "path", "field", "raw", "instant_us")).where("instant_us is not null and device_id is not null and path is not null")
    same = ["device_id", "path", "field", "instant_us"]
    written = dated.groupBy(*same, "raw", F.pmod("rec_id", F.lit(CHUNKS)).alias("chunk")).agg(F.collect_list("rec_id").alias("recs"))
    a, b = written.alias("a"), written.alias("b")
    together = F.lit(True)
    for k in same:
        together = together & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    met = a.join(b, together & (F.col("a.raw") < F.col("b.raw")))
    pairs = met.select(F.col("a.field").alias("field"), F.explode("a.recs").alias("x"), F.col("b.recs").alias("_b")).select("field", "x", F.explode("_b").alias("y"))
    return pairs.where("x <> y").select("field", F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
