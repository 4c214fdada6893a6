"""Short readable tokens, identifiers and hashes, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of cluster key suffixes, and the 64-bit FNV-1a parameters.
BASE32 = "23456789ABCDEFGHJKLMNPQRSTUVWXYZ"
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def short_token(value: Column) -> Column:
    """A value's short form: the last digits of a number, the initials of several words, the start of one."""
    core = F.substring_index(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), "@", 1)
    alnum = F.regexp_replace(core, "[^a-z0-9]", "")
    parts = F.filter(F.split(core, "[^a-z0-9]+"), lambda p: p != "")
    initials = F.array_join(F.transform(F.slice(parts, 1, 4), lambda p: F.substring(p, 1, 1)), "")
    token = F.when(alnum.rlike("^[0-9]+$"), F.right(alnum, F.lit(3))).when(F.size(parts) >= 2, initials).otherwise(F.substring(alnum, 1, 4))
    return F.upper(F.coalesce(token, F.lit("")))


def token_of(attr: Column, value: Column, fallback: Column) -> Column:
    """The value's token, else the attribute's, else the fallback's; 12 characters at most."""
    blank = F.lit("")
    first = F.coalesce(F.nullif(short_token(value), blank), F.nullif(short_token(attr), blank), short_token(fallback))
    return F.substring(first, 1, 12)


def key_suffix(material: Column) -> Column:
    """The last two digits in base 32 of the FNV-1a hash: its low ten bits, so arithmetic modulo 1024 will do."""
    low = lambda x: F.lit(x % 1024)
    bytes_of = F.regexp_extract_all(F.hex(F.encode(material, "UTF-8")), F.lit("(..)"), F.lit(1))
    h = F.aggregate(bytes_of, low(FNV_OFFSET), lambda a, b: (a.bitwiseXOR(F.conv(b, 16, 10).cast("int")) * low(FNV_PRIME)) % 1024)
    digit = lambda x: F.substring(F.lit(BASE32), x + 1, F.lit(1))
    return F.concat(digit(F.shiftright(h, 5)), digit(h.bitwiseAND(F.lit(31))))


def global_id(shard: Column, version: Column, local: Column) -> Column:
    """16 bits of shard, 16 of version, 32 of local id in one long."""
    part = lambda x, bits: F.shiftleft(x.cast("long"), bits)
    return part(shard, 48).bitwiseOR(part(version, 32)).bitwiseOR(local.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def shard_of(gid: Column) -> Column:
    return F.shiftrightunsigned(gid, 48)


def version_of(gid: Column) -> Column:
    return F.shiftrightunsigned(gid, 32).bitwiseAND(F.lit(0xFFFF))


def local_of(gid: Column) -> Column:
    return gid.bitwiseAND(F.lit(0xFFFFFFFF))


def display_global_id(gid: Column) -> Column:
    text = lambda x: x.cast("string")
    return F.concat(F.lit("GC"), text(shard_of(gid)), F.lit("."), text(local_of(gid)), F.lit(".v"), text(version_of(gid)))


def display_record(record_id: Column) -> Column:
    return F.concat(F.lit("R"), record_id.cast("string"))


def display_identity(entity_type: Column, perspective: Column, uid: Column) -> Column:
    return F.concat_ws(":", entity_type, perspective, uid)
