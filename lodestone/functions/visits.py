"""Signed links that lead through a visit recorder to a page."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def signature(secret: str, expires: Column, page: Column) -> Column:
    """Hex of the HMAC-SHA256 over the expiry (seconds) and the page: two hashes behind the padded key, in the JVM."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    said = F.encode(F.concat(expires.cast("long").cast("string"), F.lit("\n"), page), "utf-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256)


def link(secret: str, origin: str, expires: Column, page: Column, disabled: Column | None = None) -> Column:
    """The page's link through the recorder at ``origin``; a page that isn't http or https, or ``disabled``, stays as it is."""
    made = F.concat(F.lit(f"{origin}/visit?url="), F.replace(F.url_encode(page), F.lit("+"), F.lit("%20")), F.lit("&expires="), expires.cast("string"), F.lit("&signature="), signature(secret, expires, page))
    web = F.coalesce(page.rlike("^https?://"), F.lit(False))
    return F.when(web & ~F.coalesce(disabled, F.lit(False)), made).otherwise(page) if disabled is not None else F.when(web, made).otherwise(page)


def genuine(secret: str, expires: Column, page: Column, given: Column) -> Column:
    return F.coalesce(signature(secret, expires, page) == given, F.lit(False))


def expired(expires: Column, now: Column) -> Column:
    return now > expires


def order_of(page: Column, order_id: Column) -> Column:
    """The crawl order for a visited page: the page alone, whatever it says about indexing of links."""
    profile = F.struct(F.lit("visit").alias("Name"), F.lit("wide").alias("Scope"), F.lit(".*").alias("URLMustMatch"), F.lit("").alias("URLMustNotMatch"), F.lit(0).alias("MaxDepth"), F.lit(True).alias("AllowQueryURLs"), F.lit(0).alias("MaxPagesPerHost"), F.lit(False).alias("IgnoresIndexingRefusal"))
    return F.struct(order_id.alias("OrderID"), profile.alias("Profile"), F.array(page).alias("SeedURLs"))
