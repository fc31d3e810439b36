"""Bytes and encodings. Texts are taken as UTF-8."""

from __future__ import annotations

from pyspark.sql import functions as F

from .terms import BIN, LIST, NUM, TEXT, Term, as_bytes, as_num, as_text, byte_values, bytes_of, failed, let, made


def blen(x) -> Term:
    x = as_bytes(x)
    return made(NUM, F.octet_length(x.value).cast("decimal(10,0)"), x, precision=10)


def to_utf8(x) -> Term:
    return as_bytes(x)


def from_utf8(x) -> Term:
    x = as_bytes(x)
    s = x.value.cast("string")
    return made(TEXT, s, x, errors=(failed(~F.is_valid_utf8(s), "E_UTF8"),))


def to_hex(x) -> Term:
    x = as_bytes(x)
    return made(TEXT, F.lower(F.hex(x.value)), x)


def from_hex(x) -> Term:
    x = as_text(x)
    ok = x.value.rlike(r"^[0-9a-fA-F]*\z") & (F.octet_length(x.value) % 2 == 0)
    return made(BIN, F.unhex(F.when(ok, x.value)), x, errors=(failed(~ok, "E_BAD_ARG"),))


def encode_base64(x) -> Term:
    x = as_bytes(x)
    return made(TEXT, F.translate(F.base64(x.value), "\r\n", ""), x)


def decode_base64(x) -> Term:
    x = as_text(x)
    ok = x.value.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.octet_length(x.value) % 4 == 0)
    return made(BIN, F.unbase64(F.when(ok, x.value)), x, errors=(failed(~ok, "E_BAD_ARG"),))


def crc32(x) -> Term:
    x = as_bytes(x)
    return made(TEXT, F.lower(F.lpad(F.hex(F.crc32(x.value)), 8, "0")), x)


def btl(x) -> Term:
    """List of the byte values."""
    x = as_bytes(x)
    entry = lambda c, i: F.struct((i + 1).cast("string").alias("k"), F.ascii(c).cast("decimal(3,0)").alias("v"))
    return made(LIST, F.transform(byte_values(x.value), entry), x, of=lambda c: Term(NUM, c, precision=3))


def ltb(x: Term) -> Term:
    """Bytes of a list of whole numbers 0 to 255 without fraction digits. One pass; elements are judged again only where one is bad."""
    number = lambda e: as_num(x.of(e["v"]))
    chars = F.array(*(F.lit(chr(i)) for i in range(256)))

    def char(e):
        n = number(e)
        found = F.get(chars, n.value.try_cast("int"))
        return found if n.shown is None and not n.scale else F.when((F.lit(n.scale) if n.shown is None else n.shown) == 0, found)

    def judged(entries, raw, error):
        bad = F.when(F.size(entries) == 0, "E_NO_SCALAR").when(F.octet_length(raw) != F.size(entries), F.when(F.exists(entries, lambda e: number(e).value.isNull()), "E_NOT_NUM").otherwise("E_RANGE"))
        return let(lambda code: F.struct(F.when(code.isNull(), raw).alias("value"), code.alias("error")), F.coalesce(error, bad))

    error = F.lit(None).cast("string") if x.error is None else x.error
    done = let(lambda entries, error: let(judged, entries, bytes_of(F.transform(entries, char)), error), x.value, error)
    return Term(BIN, done["value"], done["error"], x.deps, both=done)
