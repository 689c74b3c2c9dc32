"""Content keys: SHA-1 of text, sorted parameters, chains of stages, source files, short folder keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the key format.
FORMAT_VERSION = "1"
FNV_START = 0x811C9DC5
FNV_PRIME = 0x01000193
IDEAL_QE_CURVE = "Ideal QE curve"


def params_string(params: Column) -> Column:
    """``key=value;...`` of a map of texts, keys sorted; nested values come as JSON text."""
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(params)),
                                               lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit(""))


def chain_key(previous: Column, stage: Column, params: Column) -> Column:
    """The key of a stage from the key before it; a missing one starts a chain."""
    return F.sha1(F.concat_ws("|", F.lit(FORMAT_VERSION), F.coalesce(previous, F.lit("")), stage, params_string(params)))


def chain_key_text(previous: str | None, stage: str, params: dict[str, str]) -> str:
    """``chain_key`` of plain values, for naming a table before a job runs."""
    text = ";".join(f"{k}={params[k]}" for k in sorted(params))
    return hashlib.sha1(f"{FORMAT_VERSION}|{previous or ''}|{stage}|{text}".encode()).hexdigest()


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as UTC text."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def file_source_key(path: Column, size: Column, mtime_ms: Column) -> Column:
    return F.sha1(F.concat_ws("|", F.lit("file"), path, size.cast("string"), iso_ms(mtime_ms)))


def crop_tag(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.concat(F.lit("|crop:"), F.concat_ws(",", *[c.cast("string") for c in (x0, y0, x1, y1)]))


def crop_halos_tag(crop: Column, reduce_halos: Column) -> Column:
    return F.concat(crop, F.lit("|halos:"), F.when(reduce_halos, "1").otherwise("0"))


def rgb_source_key(r: Column, g: Column, b: Column, tag: Column) -> Column:
    return F.sha1(F.concat(F.concat_ws("|", F.lit("rgb"), r, g, b), tag))


def palette_source_key(palette: Column, keys: list[Column], tag: Column) -> Column:
    return F.sha1(F.concat(F.concat_ws("|", F.lit("palette"), palette, *keys), tag))


def white_balance_key(keys: list[Column], crop: Column, filters_json: Column, instrument: Column, reference: Column) -> Column:
    """The key of a mono white-balance measurement; a missing reference or instrument reads null."""
    text = F.concat(F.concat_ws("|", F.lit("cleanwb"), *keys), crop, F.lit("|"), filters_json, F.lit("|"),
                    F.coalesce(instrument, F.lit("null")), F.lit("|ref:"), F.coalesce(reference, F.lit("null")))
    return F.sha1(text)


def fnv_hash(text: Column) -> Column:
    """8 hex digits of FNV-1a over UTF-16 code units."""
    def units(c: Column) -> Column:
        p = F.ascii(c).cast("long")
        high = F.floor((p - 65536) / 1024).cast("long") + 0xD800
        return F.when(p > 65535, F.array(high, (p - 65536) % 1024 + 0xDC00)).otherwise(F.array(p))
    codes = F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), units))
    h = F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long")) % F.lit(1 << 32).cast("long"))
    return F.lower(F.lpad(F.hex(h), 8, "0"))
