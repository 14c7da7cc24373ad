"""Search over postings: terms, filters, join of documents, rank, metadata, reports and topics, each one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import hashing, tokens, wire

# Results, seconds, postings kept per term, topics.
RESULTS, SECONDS, PER_TERM, TOPICS = 10, 3.0, 1000, 5
_KIND_BIT = {"image": 2, "audio": 3, "video": 4, "application": 5}
_KIND_TYPE = {"image": "i", "audio": "a", "video": "m"}


@dataclass(frozen=True)
class Criteria:
    """What a request asks for. A term given twice joins with itself: it counts twice, also for the spread."""

    terms: tuple[str, ...]
    excluded_terms: tuple[str, ...] = ()
    language: str | None = None
    required_documents: tuple[str, ...] = ()
    site_hash: str | None = None
    content_kind: str | None = None
    strict_content_kind: bool = False
    required_appearance: int | None = None
    max_spread: int = 0
    results: int = RESULTS
    per_term: int = PER_TERM
    seconds: float = field(default=SECONDS)


def _numbers(form: dict[str, str], key: str, default: int) -> int:
    try:
        return int(form.get(key, "") or default)
    except ValueError:
        return default


def criteria_of(form: dict[str, str], site_hashes: dict[str, str] | None = None) -> Criteria:
    """Criteria of a request form, with its defaults: 10 results, 3 seconds at most, language and site by modifier only.

    ``site_hashes`` gives the host hash of sites, as :func:`lodestone.functions.urls.site_host_hash` computes them.
    """
    cut = lambda k: tuple(form.get(k, "")[i : i + 12] for i in range(0, len(form.get(k, "")) // 12 * 12, 12))
    language, site = None, None
    for part in form.get("modifier", "").split():
        if part.startswith("/language/") and len(part) == 12:
            language = part[10:]
        elif part.startswith("site:"):
            site = part[5:]
    kind = {"1": "image", "2": "audio", "3": "video", "4": "application"}.get({"image": "1", "audio": "2", "video": "3", "app": "4"}.get(form.get("contentdom", ""), ""))
    seconds = min(_numbers(form, "time", int(SECONDS * 1000)) / 1000, SECONDS)
    return Criteria(
        terms=cut("query"), excluded_terms=cut("exclude"), language=language, required_documents=cut("urls"), site_hash=(site_hashes or {}).get(site) if site else None,
        content_kind=kind, strict_content_kind=form.get("strictContentDom", "") in ("on", "1", "true"), max_spread=_numbers(form, "maxdist", 0), results=_numbers(form, "count", RESULTS), seconds=seconds if seconds > 0 else SECONDS,
    )


def ignored_options(form: Column, names: tuple[str, ...]) -> Column:
    """Those of the named options that a request sets, though they have no effect."""
    return F.filter(F.array(*[F.when(F.coalesce(F.element_at(form, F.lit(n)), F.lit("")) != "", F.lit(n)) for n in names]), lambda x: x.isNotNull())


def accepts(c: Criteria) -> Column:
    """The conditions on a posting alone, all of which reach the scan."""
    ok = F.lit(True)
    if c.language is not None:
        ok = ok & (F.col("language") == c.language)
    if c.site_hash is not None:
        ok = ok & (hashing.host_hash(F.col("url_hash")) == c.site_hash)
    if c.content_kind is not None:
        strict = c.strict_content_kind and c.content_kind in _KIND_TYPE
        ok = ok & (F.col("document_type") == ord(_KIND_TYPE[c.content_kind]) if strict else F.getbit("appearance", F.lit(_KIND_BIT[c.content_kind])) == 1)
    if c.required_appearance is not None:
        ok = ok & (F.col("appearance").bitwiseAND(c.required_appearance) != 0)
    return F.coalesce(ok, F.lit(False))


def term_postings(postings: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Postings of some words: one pushed-down predicate."""
    return postings.where(F.col("word_hash").isin(*terms)) if terms else postings.limit(0)


def filtered(postings: DataFrame, c: Criteria, for_report: bool = False, terms: tuple[str, ...] | None = None) -> DataFrame:
    """Accepted postings of the terms. Reports ignore exclusions; an excluded term counts unfiltered."""
    rows = term_postings(postings, tuple(dict.fromkeys(c.terms if terms is None else terms))).where(accepts(c))
    if c.required_documents:
        rows = rows.where(F.col("url_hash").isin(*c.required_documents))
    if c.excluded_terms and not for_report:
        rows = rows.join(term_postings(postings, c.excluded_terms).select("url_hash"), "url_hash", "left_anti")
    return rows


def kept(rows: DataFrame, per_term: int = PER_TERM) -> DataFrame:
    """The most frequent postings of each term: at most ``per_term`` by hits, equals in the order of documents.

    Spark cuts each task's rows to the limit before it shuffles them, so a term of any size stays bounded.
    """
    n = F.row_number().over(W.partitionBy("word_hash").orderBy(F.desc("hits"), "url_hash"))
    return rows.withColumn("__n", n).where(F.col("__n") <= per_term).drop("__n")


def term_counts(postings: DataFrame, c: Criteria) -> DataFrame:
    """Per term the postings held, those accepted, and those kept."""
    held = term_postings(postings, c.terms).groupBy("word_hash").agg(F.count(F.lit(1)).alias("held"))
    total = filtered(postings, c).groupBy("word_hash").agg(F.count(F.lit(1)).alias("accepted"))
    return held.join(total, "word_hash", "left").select("word_hash", "held", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.least(F.coalesce("accepted", F.lit(0)), F.lit(c.per_term)).alias("kept"))


def matches(postings: DataFrame, c: Criteria) -> DataFrame:
    """``url_hash, occurrences, first_position, last_position, spread`` of documents that have every term."""
    times = {t: c.terms.count(t) for t in c.terms}
    weight = F.lit(1)
    if any(n > 1 for n in times.values()):
        weight = F.element_at(F.create_map(*[x for t, n in times.items() for x in (F.lit(t), F.lit(n))]), F.col("word_hash"))
    n = len(c.terms)
    joined = kept(filtered(postings, c), c.per_term).groupBy("url_hash").agg(
        F.sum(F.col("hits") * weight).alias("occurrences"), F.min("text_position").alias("first_position"), F.max("text_position").alias("last_position"), F.count(F.lit(1)).alias("__t"),
    )
    spread = F.expr(f"cast((last_position - first_position) div {n - 1} as int)") if n > 1 else F.lit(0)
    out = joined.where(F.col("__t") == len(times)).drop("__t").withColumn("spread", spread)
    return out.where(F.col("spread") <= c.max_spread) if c.max_spread > 0 else out


def ranked(found: DataFrame, results: int = RESULTS) -> DataFrame:
    """Matches in order of relevance: most occurrences, least spread, first document; all if ``results`` is not positive."""
    order = [F.desc("occurrences"), F.asc("spread"), F.asc("url_hash")]
    return found.orderBy(*order).limit(results) if results > 0 else found.orderBy(*order)


def documents(postings: DataFrame, metadata: DataFrame, c: Criteria) -> DataFrame:
    """Metadata of the most relevant documents with ``rank``. Documents without metadata leave gaps.

    Without a limit on the results there is no rank: one over all matches would have to pass through a single task.
    """
    found = matches(postings, c)
    if c.results <= 0:
        return metadata.join(found.withColumn("rank", F.lit(None).cast("int")), "url_hash")
    rank = F.row_number().over(W.orderBy(F.desc("occurrences"), "spread", "url_hash"))  # over the few results alone
    top = ranked(found, c.results).withColumn("rank", rank)
    return metadata.join(F.broadcast(top) if c.results <= 10_000 else top, "url_hash")


def report(postings: DataFrame, c: Criteria, mode: str, requested: tuple[str, ...] = ()) -> DataFrame:
    """``word_hash, documents`` (abstract of the kept documents) that a request asks for.

    ``auto`` lists the term with most documents if there are several terms and no required documents; ``terms`` those
    requested, without exclusions; ``none`` nothing.
    """
    if mode == "terms" and requested:
        rows = kept(filtered(postings, c, True, requested), c.per_term)
    elif mode == "auto" and len(set(c.terms)) > 1 and not c.required_documents:
        rows = kept(filtered(postings, c), c.per_term)
        best = rows.groupBy("word_hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word_hash").limit(1)
        rows = rows.join(F.broadcast(best.select("word_hash")), "word_hash", "left_semi")
    else:
        rows = kept(filtered(postings, c), c.per_term).limit(0)
    # at most per_term hashes a term
    return rows.groupBy("word_hash").agg(F.collect_list("url_hash").alias("h")).select("word_hash", F.size("h").alias("n_documents"), wire.abstract(F.col("h")).alias("abstract"))


def topics(results: DataFrame, c: Criteria, title: str = "descr", limit: int = TOPICS) -> DataFrame:
    """The most frequent words of the results' titles, neither common nor asked for."""
    words = results.select(F.explode(tokens.title_words(F.col(title))).alias("topic"))
    words = words.where(~F.col("topic").isin(*tokens.COMMON_TITLE_WORDS))
    if c.terms:
        words = words.where(~hashing.word_hash(F.col("topic")).isin(*c.terms))
    return words.groupBy("topic").agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), "topic").limit(limit)
