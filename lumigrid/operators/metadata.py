"""Typed key/value metadata in a map column. Keys are kept in upper case and looked up in any case."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import META_VALUE, METADATA, ColorSpace

#: fixed values: kind and the slot that holds it
SLOTS = {
    "u8": "i", "u16": "i", "u32": "i", "i8": "i", "i16": "i", "i32": "i", "i64": "i", "u64": "u",
    "f32": "f", "f64": "f", "string": "s", "colorspace": "s", "duration": "ns", "systemtime": "ns",
}
TIMESTAMP, CAMERA, PROGRAM, EXPOSURE = "TIMESTAMP", "CAMERA", "PROGNAME", "EXPOSURE"
RANGES = {"u8": (0, 255), "u16": (0, 65535), "u32": (0, 2**32 - 1), "i8": (-128, 127), "i16": (-(2**15), 2**15 - 1), "i32": (-(2**31), 2**31 - 1), "i64": (-(2**63), 2**63 - 1), "u64": (0, 2**64 - 1)}


def key_name(name: str) -> str:
    if not name:
        raise ValueError("Key cannot be empty")
    if len(name.encode()) > 80:
        raise ValueError("Key cannot be longer than 80 characters")
    return name.upper()


def _text_check(text: str, what: str) -> None:
    if not text:
        raise ValueError(f"{what} cannot be empty")
    if len(text.encode()) > 4096:
        raise ValueError(f"{what} cannot be longer than 4096 characters")


def item(kind: str, value, comment: str | None = None) -> Column:
    """A metadata value: a Python value or a column of one of the kinds."""
    if kind not in SLOTS:
        raise ValueError(f"Unknown kind {kind}")
    if comment is not None:
        _text_check(comment, "Comment")
    if isinstance(value, ColorSpace):
        value = value.text()
    if not isinstance(value, Column):
        if kind == "string":
            _text_check(value, "Value")
        if kind in RANGES and not RANGES[kind][0] <= value <= RANGES[kind][1]:
            raise ValueError(f"{value} is outside {kind}")
        value = F.lit(Decimal(value) if kind == "u64" else value)  # a 64-bit unsigned value may not fit a long
    elif kind == "string":
        size = F.octet_length(value)
        value = F.when(size == 0, F.raise_error(F.lit("Value cannot be empty")).cast("string")).when(size > 4096, F.raise_error(F.lit("Value cannot be longer than 4096 characters")).cast("string")).otherwise(value)
    if kind == "f32":
        value = value.cast("float")
    slots = {"kind": F.lit(kind), SLOTS[kind]: value, "comment": F.lit(comment)}
    return F.struct(*[slots.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in META_VALUE.fields]).cast(META_VALUE)


def new_metadata(timestamp_ns: Column, keys: dict[str, Column] | None = None) -> Column:
    """Metadata with a time stamp and ``keys``, in one map; of names that differ in case only, the last stays."""
    entries = {}
    for name, value in (keys or {}).items():
        key = key_name(name)
        if key == TIMESTAMP:
            raise ValueError("Cannot re-insert timestamp key")
        entries.pop(key, None)
        entries[key] = value
    pairs = [F.lit(TIMESTAMP), item("systemtime", timestamp_ns, "Timestamp of the image")]
    for key, value in entries.items():
        pairs += [F.lit(key), value]
    return F.create_map(*pairs).cast(METADATA)


def _put(meta: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(meta, lambda k, _: k != key), F.create_map(F.lit(key), value))


def insert_key(meta: Column, name: str, value: Column) -> Column:
    """Add or overwrite; the time stamp cannot be inserted."""
    key = key_name(name)
    if key == TIMESTAMP:
        raise ValueError("Cannot re-insert timestamp key")
    return _put(meta, key, value)


def _missing(meta: Column, key: str, then: Column, strict: bool) -> Column:
    found = F.map_contains_key(meta, key)
    return F.when(found, then).otherwise(F.raise_error(F.lit("Key not found")).cast(METADATA) if strict else meta)


def remove_key(meta: Column, name: str, strict: bool = True) -> Column:
    key = key_name(name)
    if key == TIMESTAMP:
        raise ValueError("Cannot remove timestamp key")
    return _missing(meta, key, F.map_filter(meta, lambda k, _: k != key), strict)


def replace_key(meta: Column, name: str, value: Column, strict: bool = True, kind: str | None = None) -> Column:
    """Overwrite a key that is there. The time stamp takes a system time only, so state its ``kind``."""
    key = key_name(name)
    if key == TIMESTAMP and kind != "systemtime":
        raise ValueError("The timestamp must be a system time")
    return _missing(meta, key, _put(meta, key, value), strict)


def get_key(meta: Column, name: str) -> Column:
    return F.try_element_at(meta, F.lit(name.upper()))


def get_value(meta: Column, name: str, kind: str, strict: bool = False) -> Column:
    """The value if it is of exactly this kind, else null; if ``strict``, a value of another kind raises."""
    found = get_key(meta, name)
    own = F.when(found["kind"] == kind, found[SLOTS[kind]])
    if not strict:
        return own
    slot = {f.name: f.dataType for f in META_VALUE.fields}[SLOTS[kind]]
    return F.when(found["kind"] != kind, F.raise_error(F.concat(F.lit("Invalid type "), found["kind"])).cast(slot)).otherwise(own)


def get_comment(meta: Column, name: str) -> Column:
    return get_key(meta, name)["comment"]


def get_timestamp(meta: Column) -> Column:
    """Nanoseconds since the epoch."""
    return get_value(meta, TIMESTAMP, "systemtime")


def get_exposure(meta: Column) -> Column:
    """Nanoseconds, if the exposure is a duration."""
    return get_value(meta, EXPOSURE, "duration")
