"""Capture file names: Type_target_exposure_Bin_camera_filter_gain_stamp_rotation_temp_sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the name parts.
EXTENSION = r"(?i)\.(fit|fits)$"
TYPES = ("light", "flat", "dark", "bias")
STAMP = r"^\d{8}-\d{6}$"
EXPOSURE = r"^\d+(\.\d+)?(s|ms)$"
BIN = r"^Bin\d+$"
GAIN = r"^gain\d+$"
ROTATION = r"^\d+deg$"
TEMP = r"^-?\d+(\.\d+)?C$"
SEQUENCE = r"^\d+$"
CAPTURE_FIELDS = ("type", "target", "exposure", "bin_token", "camera", "filter", "gain", "stamp", "rotation", "temp", "sequence")


def stamp_key(stamp: Column) -> Column:
    """Epoch seconds of a printed yyyymmdd-hhmmss stamp read as UTC; null for no real date."""
    def part(at: int, n: int) -> Column:
        return F.substring(stamp, at, n).try_cast("int")
    ok = stamp.rlike(STAMP) & (part(10, 2) <= 23) & (part(12, 2) <= 59) & (part(14, 2) <= 59)
    made = F.try_make_timestamp(part(1, 4), part(5, 2), part(7, 2), part(10, 2), part(12, 2), part(14, 2), F.lit("UTC"))
    return F.when(ok, F.unix_timestamp(made))


def obs_time(text: Column) -> Column:
    """DATE-OBS text as epoch milliseconds; UTC where no zone is given."""
    t = F.trim(F.regexp_replace(text, "'", ""))
    zoned = F.when(t.rlike(r"[zZ]|[+-]\d\d:?\d\d$"), t).otherwise(F.concat(t, F.lit("Z")))
    # words such as "now" are times to Spark; an observation time begins with a year
    return F.when(t.rlike(r"^\d{4}-"), F.unix_millis(F.try_to_timestamp(F.regexp_replace(zoned, "[zZ]$", "+00:00"))))


def parse_capture_names(df: DataFrame, name: str) -> DataFrame:
    """Add the parts of a capture name and its ``key``; all null where the name is not one, or is ambiguous.

    The only stamp anchors the rest: gain and filter stand before it, the last Bin token before those, and the
    last exposure before that.
    """
    def last(pattern: str, before: Column) -> Column:
        return F.array_max(F.filter("__at", lambda i: (i <= before) & F.element_at("__t", i).rlike(pattern)))

    def token(i: Column) -> Column:
        return F.try_element_at(F.col("__t"), i)

    def joined(start: Column, count: Column) -> Column:
        return F.array_join(F.slice("__t", start, F.greatest(count, F.lit(0))), "_")
    n = F.col(name)
    rows = df.withColumn("__t", F.split(F.regexp_replace(n, EXTENSION, ""), "_"))
    rows = rows.withColumn("__at", F.sequence(F.lit(1), F.size("__t")))
    rows = rows.withColumn("__stamps", F.filter("__at", lambda i: F.element_at("__t", i).rlike(STAMP)))
    ok = n.rlike(EXTENSION) & F.lower(F.get("__t", 0)).isin(*TYPES) & (F.size("__stamps") == 1)
    rows = rows.withColumn("__stamp", F.when(ok, F.get("__stamps", 0)))
    stamp = F.col("__stamp")
    rows = rows.withColumn("__bin", F.when((stamp >= 3) & token(stamp - 1).rlike(GAIN), last(BIN, stamp - 3)))
    rows = rows.withColumn("__exp", F.when(F.col("__bin") > 1, last(EXPOSURE, F.col("__bin") - 1)))
    rows = rows.withColumn("__tail", F.when(F.col("__exp") > 1, F.slice("__t", stamp + 1, F.greatest(F.size("__t") - stamp, F.lit(0)))))

    def of_kind(pattern: str) -> Column:
        return F.filter("__tail", lambda t: t.rlike(pattern))
    rows = rows.withColumns({"__rot": of_kind(ROTATION), "__tmp": of_kind(TEMP), "__seq": of_kind(SEQUENCE)})
    good = ((F.size("__rot") <= 1) & (F.size("__tmp") == 1) & (F.size("__seq") == 1) & F.col("__tail").isNotNull())
    b, e = F.col("__bin"), F.col("__exp")
    parts = {
        "type": token(F.lit(1)), "target": joined(F.lit(2), e - 2), "exposure": token(e), "bin_token": token(b),
        "camera": F.when(b + 1 <= stamp - 3, joined(b + 1, stamp - 3 - b)), "filter": token(stamp - 2),
        "gain": token(stamp - 1), "stamp": token(stamp), "rotation": F.get("__rot", 0), "temp": F.get("__tmp", 0),
        "sequence": F.get("__seq", 0)}
    rows = rows.withColumns({k: F.when(good, v) for k, v in parts.items()})
    return rows.withColumn("key", stamp_key(F.col("stamp"))).drop(
        "__t", "__at", "__stamps", "__stamp", "__bin", "__exp", "__tail", "__rot", "__tmp", "__seq")
