"""Hashes, ring positions and keys as column expressions. Everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols of a hash in the order of their values, and the forward size of the ring.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
RING_MAX = 9223372036854775807
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Characters that sort in bytes as the symbols of the alphabet sort by value.
_IN_ORDER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_`abcdefghijklmnopqrstuvwxyz"


def encode64(data: Column) -> Column:
    """Bytes as symbols of the alphabet, without padding."""
    return F.translate(F.rtrim(F.base64(data), F.lit("=")), "+/", "-_")


def decode64(text: Column) -> Column:
    """Bytes of symbols; line feeds are ignored; null if there are other characters."""
    plain = F.translate(F.regexp_replace(text, "[\r\n]", ""), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(plain.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(plain) % 4 != 1), F.unbase64(padded))


def md5_symbols(text: Column) -> Column:
    """The md5 of a text as 22 symbols."""
    return encode64(F.unhex(F.md5(text.cast("binary"))))


def word_hash(word: Column) -> Column:
    """Twelve symbols of a word, case ignored. A hash never begins with five underscores: they are shifted out."""
    h = F.substring(md5_symbols(F.lower(word)), 1, 12)
    lead = F.length(h) - F.length(F.ltrim(h, F.lit("_")))
    return F.when(F.startswith(h, F.lit("_____")), F.rpad(F.substr(h, lead - 3), 12, F.lit("A"))).otherwise(h)


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_-]{12}$"), F.lit(False))


def is_reserved(hash_: Column) -> Column:
    return F.startswith(hash_, F.lit("_____"))


def host_hash(url_hash: Column) -> Column:
    return F.substring(url_hash, 7, 6)


def ring_position(hash_: Column) -> Column:
    """Place on the ring of 2**63: the first ten symbols, 60 bits, and three ones below."""
    ten = F.rpad(F.substring(hash_, 1, 10), 12, F.lit("A"))
    bits = F.conv(F.substring(F.hex(decode64(ten)), 1, 15), 16, 10).cast("long")
    return F.shiftleft(bits, 3) + F.lit(7)


def hash_at(position: Column) -> Column:
    """A hash at a ring position: its first ten symbols, then the last of the alphabet."""
    hex_ = F.concat(F.lpad(F.hex(F.shiftright(position, 3)), 15, F.lit("0")), F.lit("0"))
    return F.concat(F.substring(encode64(F.unhex(hex_)), 1, 10), F.lit("__"))


def ring_distance(a: Column, b: Column) -> Column:
    """How far it is forward on the ring from ``a`` to ``b``."""
    return (b - a).bitwiseAND(F.lit(RING_MAX))


def ring_fraction(distance: Column) -> Column:
    return distance.cast("double") / F.lit(float(2**63))


def partition_mask(exponent: int) -> int:
    """Bits below the partition of a ring in ``2**exponent`` partitions."""
    return (1 << (63 - exponent)) - 1


def posting_position(word: Column, url: Column, exponent: int) -> Column:
    """Ring position of a posting: high bits of its document, low bits of its word."""
    mask = partition_mask(exponent)
    high = RING_MAX & ~mask
    return ring_position(word).bitwiseAND(F.lit(mask)).bitwiseOR(ring_position(url).bitwiseAND(F.lit(high)))


def distance_from_word(position: Column, word: Column, exponent: int) -> Column:
    """How far a position is past the place of a word's postings in its partition."""
    return (position - ring_position(word)).bitwiseAND(F.lit(partition_mask(exponent)))


def ring_sector(position: Column) -> Column:
    """One of 64 sectors."""
    return F.shiftright(position, 57).cast("int")


def alphabet_order(hash_: Column) -> Column:
    """A key whose byte order is the order of the symbols' values."""
    return F.translate(hash_, ALPHABET, _IN_ORDER)


def split_hashes(text: Column) -> Column:
    """Hashes of twelve symbols written one after another; a shorter rest is ignored."""
    n = F.floor(F.length(text) / 12).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * 12 + 1, F.lit(12)))).otherwise(F.array().cast("array<string>"))


def url_key(url: Column) -> Column:
    """Name of a document's object: hex of the sha256 of its address."""
    return F.sha2(url, 256)


def numeric_key(url: Column) -> Column:
    """The top 63 bits of that sha256, as a positive number."""
    sha = F.sha2(url, 256)
    top = F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")
    return top * 8 + F.shiftright(F.conv(F.substring(sha, 16, 1), 16, 10).cast("int"), 1)


def network_key(*parts: Column) -> Column:
    """The md5 over joined fields by which a request proves its network."""
    return F.md5(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def random_hash(seed: int | None = None) -> Column:
    """A hash of 72 random bits; of reproducible ones with a seed."""
    part = lambda i: F.lpad(F.hex(F.floor(F.rand(None if seed is None else seed + i) * 2**24).cast("long")), 6, F.lit("0"))
    return encode64(F.unhex(F.concat(part(0), part(1), part(2))))
