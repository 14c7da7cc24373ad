"""Crawl planning: admission of addresses, rounds over a link graph, recrawls, retries, disposals and redirects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import urls
from lodestone.session import materialise

# Retries, their shortest and longest delay in seconds and its growth, seconds until a page is due again.
RETRIES, SHORTEST_DELAY, LONGEST_DELAY, GROWTH, GRACE_SECONDS = 3, 0.5, 30.0, 1.5, 3600


@dataclass(frozen=True)
class Profile:
    """What an order admits. ``scope`` is ``wide``, ``domain`` (hosts of the seeds) or ``subpath`` (their directories)."""

    scope: str = "wide"
    must_match: str = ".*"
    must_not_match: str | None = None
    max_depth: int = 3
    allow_query: bool = False
    max_per_host: int | None = None
    #: pages of a run at most; None for any number
    max_pages: int | None = 10_000


def within_scope(candidates: DataFrame, seeds: DataFrame, scope: str, url: str = "url") -> DataFrame:
    """Candidates within the scope of the seeds. Directories are joined by equality with each prefix of an address."""
    if scope == "wide":
        return candidates
    if scope == "domain":
        hosts = seeds.select(urls.host_of(F.col(url)).alias("__h")).distinct()
        return candidates.withColumn("__h", urls.host_of(F.col(url))).join(hosts, "__h", "left_semi").drop("__h")
    folders = seeds.select(urls.directory_of(F.col(url)).alias("__d")).distinct()
    bare = F.regexp_replace(F.col(url), r"[?#].*$", "")
    parts = F.split(bare, "/")
    prefixes = F.transform(F.sequence(F.lit(3), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    rows = candidates.withColumn("__id", F.col(url)).withColumn("__d", F.explode(F.when(F.size(parts) >= 4, prefixes).otherwise(F.array().cast("array<string>"))))
    return candidates.join(rows.join(folders, "__d", "left_semi").select(F.col("__id").alias(url)).distinct(), url, "left_semi")


def admissible(candidates: DataFrame, seeds: DataFrame, p: Profile, url: str = "url") -> DataFrame:
    """Candidates that pass the checks which need no count."""
    ok = F.col(url).rlike(p.must_match)
    if p.must_not_match:
        ok = ok & ~F.col(url).rlike(p.must_not_match)
    if not p.allow_query:
        ok = ok & ~urls.has_query(F.col(url))
    return within_scope(candidates.where(ok), seeds, p.scope, url)


def capped_per_host(candidates: DataFrame, limit: int, order: list[str], url: str = "url") -> DataFrame:
    """The first addresses of each host. Tasks cut hosts to the limit before the shuffle."""
    n = F.row_number().over(W.partitionBy(urls.host_of(F.col(url))).orderBy(*order))
    return candidates.withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


def traversal(seeds: DataFrame, links: DataFrame, p: Profile) -> DataFrame:
    """``url, depth`` of the pages a crawl visits: rounds from the seeds over ``source, target`` until the depth.

    Within a round addresses are admitted in their own order, as arrival is not defined. The budget of pages counts while
    the crawl goes on: the round that exceeds it is cut, and what is cut is not walked on from. Each round is written
    out, so that lineage stays short and a lost executor costs one round; so are the links, which every round reads.
    """
    links = materialise(links.select("source", "target"), "crawl-links")
    front = admissible(seeds.select("url").distinct(), seeds, p).withColumn("depth", F.lit(0))
    if p.max_per_host:
        front = capped_per_host(front, p.max_per_host, ["url"])
    seen = front = materialise(front.orderBy("url").limit(p.max_pages) if p.max_pages else front, "crawl-round")
    visited = front.count()
    for depth in range(1, p.max_depth + 1):
        if p.max_pages and visited >= p.max_pages:
            break
        found = links.join(front.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        found = admissible(found.join(seen.select("url"), "url", "left_anti"), seeds, p).withColumn("depth", F.lit(depth))
        if p.max_per_host:
            used = seen.groupBy(urls.host_of(F.col("url")).alias("__h")).agg(F.count(F.lit(1)).alias("__used"))
            rank = F.row_number().over(W.partitionBy("__h").orderBy("url"))
            found = found.withColumn("__h", urls.host_of(F.col("url"))).withColumn("__n", rank).where(F.col("__n") <= p.max_per_host).join(used, "__h", "left")
            found = found.where(F.col("__n") + F.coalesce("__used", F.lit(0)) <= p.max_per_host).select("url", "depth")
        front = materialise(found, "crawl-round")
        n = front.count()
        if p.max_pages and visited + n > p.max_pages:
            front = materialise(front.orderBy("url").limit(p.max_pages - visited), "crawl-cut")
            n = p.max_pages - visited
        if not n:
            break
        seen, visited = seen.unionByName(front), visited + n
    return seen


def recrawl_due(visit: DataFrame, now: Column, grace_seconds: int = GRACE_SECONDS) -> DataFrame:
    """Pages with ``due``: never visited, or not within the grace."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("visited_at").cast("timestamp"))
    return visit.withColumn("due", F.coalesce(age >= F.lit(grace_seconds * 1_000_000), F.lit(True)))


def retry_delay(attempt: Column) -> Column:
    """Seconds before a retry: growing, up to a bound."""
    return F.least(F.lit(SHORTEST_DELAY) * F.pow(F.lit(GROWTH), attempt - 1), F.lit(LONGEST_DELAY))


def retry_after(header: Column, now: Column, default: int = 60) -> Column:
    """Seconds a server asks to wait: a number or a date, else a minute."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(header.rlike(r"^\s*\d{1,9}\s*$"), F.trim(header).cast("int")), F.when(date.isNotNull(), F.greatest((F.unix_timestamp(date) - F.unix_timestamp(now)).cast("int"), F.lit(0))), F.lit(default))


def fetch_status(status: Column) -> Column:
    """Outcome of a response by its status: ``ceased`` where access is refused for good, ``not-a-page`` for other faults of the request."""
    deferred, ceased = status.isin(429, 503), status.isin(401, 403, 451)
    return F.when(status.between(200, 299), "fetched").when(status == 304, "unmodified").when(deferred, "deferred").when(ceased, "ceased").when(status.between(400, 499), "not-a-page").otherwise("failed")


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))


def media_type_allowed(content_type: Column, allowed: list[str]) -> Column:
    """Whether pages of a type are taken; an empty list allows all."""
    kind = media_type(content_type)
    return F.coalesce(kind.isin([a.lower() for a in allowed]), F.lit(False)) if allowed else F.lit(True)


# Disposals by the error of an extraction; any other is the last.
EXTRACTION_DISPOSALS = {"unsupported media type": "unsupported-media-type", "nested too deep": "nesting-too-deep", "document budget exhausted": "document-budget-exhausted"}
UNEXTRACTABLE = "unextractable"


def extraction_disposal(error: Column) -> Column:
    """Why a page is disposed of whose content could not be extracted; null without an error."""
    known = F.create_map(*[x for k, v in EXTRACTION_DISPOSALS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(error.isNotNull(), F.coalesce(F.element_at(known, F.lower(F.trim(error))), F.lit(UNEXTRACTABLE)))


def always_due(visit: DataFrame) -> DataFrame:
    """The rule by which every page is due."""
    return visit.withColumn("due", F.lit(True))


def robots_directives(header: Column) -> Column:
    """``noindex`` and ``nofollow`` of robots directives; ``none`` means both. A directive for a named robot is none of ours."""
    words = F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), ","), lambda w: F.trim(w))
    has = lambda x: F.arrays_overlap(words, F.array(F.lit(x), F.lit("none")))
    return F.struct(has("noindex").alias("noindex"), has("nofollow").alias("nofollow"))


def redirects(chains: DataFrame) -> DataFrame:
    """``url, resolved_url`` of every hop to the last one, but for itself. ``chain`` lists the addresses in order."""
    last = F.element_at("chain", -1)
    return chains.where(F.size("chain") > 1).select(F.explode(F.array_distinct("chain")).alias("url"), last.alias("resolved_url")).where("url <> resolved_url").distinct()


def resolved(pages: DataFrame, redirected: DataFrame, url: str = "url") -> DataFrame:
    """Pages with the address they lead to, else their own."""
    r = redirected.select(F.col("url").alias(url), "resolved_url")
    return pages.join(r, url, "left").withColumn("resolved_url", F.coalesce("resolved_url", url))


def disposal_of_members(members: DataFrame, page: str) -> DataFrame:
    """Reason a container is disposed of: only if every member is; then that of the first."""
    return members.groupBy(page).agg(F.bool_and(F.col("disposal").isNotNull()).alias("__all"), F.min_by("disposal", "member").alias("__first")).select(page, F.when(F.col("__all"), F.col("__first")).alias("disposal"))
