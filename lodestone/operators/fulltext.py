"""Full-text search over documents with title and content, routed by language, and recall of pages by address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing, tokens
from lodestone.operators.index import latest

# Weight of a title, results of a page, characters shown where nothing is highlighted.
TITLE_WEIGHT, PAGE, SHOWN = 3, 10, 300
OTHER = "und"


def primary_language(label: Column) -> Column:
    """First subtag of a language label, in small letters."""
    return F.nullif(F.element_at(F.split(F.lower(F.trim(label)), "[-_]"), 1), F.lit(""))


def routed(documents: DataFrame, allowed: list[str], label: str = "language") -> DataFrame:
    """Documents with the index they belong to: that of their language if there is one, else the one for others."""
    lang = primary_language(F.col(label))
    return documents.withColumn("language_index", F.when(lang.isin(*allowed), lang).otherwise(F.lit(OTHER)))


def index_names(base: str, languages: list[str], version: int = 1) -> dict[str, str]:
    """Index names by language. Duplicates and labels that are no language are refused."""
    seen: dict[str, str] = {}
    for x in languages:
        key = x.strip().lower().replace("_", "-").split("-")[0]
        if not (len(key) in (2, 3) and key.isalpha()):
            raise ValueError(f"no language: {x!r}")
        if key in seen:
            raise ValueError(f"twice: {key}")
        seen[key] = f"{base}_v{version}_{key}"
    return seen | {OTHER: f"{base}_v{version}_{OTHER}"}


def corpus(documents: DataFrame, url: str = "url", order: tuple[str, ...] = ("crawled_at", "stream_seq")) -> DataFrame:
    """The last version of each address, with both keys under which indexes keep it."""
    kept = latest(documents, [url], list(order))
    return kept.withColumns({"object_key": hashing.url_key(F.col(url)), "numeric_key": hashing.numeric_key(F.col(url))})


# Endings that forms of a word differ in, by language, longest first. Other languages are only folded.
ENDINGS = {
    "en": ("ingly", "edly", "ing", "ies", "ed", "es", "ly", "s"),
    "de": ("ern", "em", "en", "er", "es", "e", "s", "n"),
    "fr": ("ements", "ement", "euses", "euse", "eux", "es", "er", "ez", "e", "s"),
    "ru": ("иями", "ями", "ами", "ого", "его", "ому", "ему", "ыми", "ими", "ов", "ев", "ей", "ам", "ям", "ах", "ях", "ой", "ый", "ий", "ая", "яя", "ое", "ее", "ые", "ие", "ом", "ем", "а", "я", "о", "е", "ы", "и", "у", "ю", "ь"),
}
#: A stem keeps at least so many letters.
SHORTEST_STEM = 3


def folded(text: Column) -> Column:
    """Small letters without accents, for languages without an analyser of their own."""
    return F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿąćęłńóśźż", "aaaaaaceeeeiiiinooooouuuuyyacelnoszz")


def stem(word: Column, language: Column) -> Column:
    """What a word is compared by: without its ending in a language that has an analyser, else folded."""
    low = F.lower(word)
    out = folded(word)
    for lang, endings in ENDINGS.items():
        out = F.when(language == lang, F.regexp_replace(low, f"^(.{{{SHORTEST_STEM},}}?)(?:{'|'.join(endings)})$", "$1")).otherwise(out)
    return out


def searchable(documents: DataFrame) -> DataFrame:
    """Documents with title and address; others are never found."""
    return documents.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def postings(documents: DataFrame, analysed: bool = False) -> DataFrame:
    """``word, url, language, in_title, hits``: the inverted index of titles and contents, to be kept sorted by word.

    ``analysed``: words are stems of the document's language.
    """
    lang = F.coalesce(primary_language(F.col("language")), F.lit(OTHER))
    found = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(tokens.TOKEN), F.lit(0)), F.lower)
    docs = searchable(documents).select("url", lang.alias("language"), F.explode(F.array(F.struct(F.lit(True).alias("in_title"), found("title").alias("w")), F.struct(F.lit(False).alias("in_title"), found("content").alias("w")))).alias("f"))
    words = docs.select("url", "language", "f.in_title", F.explode("f.w").alias("word")).where(~F.col("word").isin(".", "!", "?"))
    if analysed:
        words = words.withColumn("word", stem(F.col("word"), F.col("language")))
    return words.groupBy("word", "url", "language", "in_title").agg(F.count(F.lit(1)).cast("int").alias("hits"))


def search(index: DataFrame, words: list[str], language: str | None = None, title_weight: int = TITLE_WEIGHT, analysed: bool = False) -> DataFrame:
    """``url, score`` of documents that have every word in title or content: occurrences, those in the title weighted.

    Reads the postings of these words alone. Words are compared in small letters, or as stems if the index has such; no
    word gives no document. ``language`` is a primary subtag; None or ``all`` is any.
    """
    wanted = list(dict.fromkeys(w.strip().lower() for w in words if w.strip()))
    if not wanted:
        return index.select("url", F.lit(0).cast("long").alias("score")).limit(0)
    rows = index
    if language is not None and language != "all":
        rows = rows.where(F.col("language") == language.lower().replace("_", "-").split("-")[0])
    if analysed:  # a word has another stem in each language
        lang = F.col("language")
        parts = [rows.where((F.col("word") == stem(F.lit(w), lang))).withColumn("asked", F.lit(i)) for i, w in enumerate(wanted)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
    else:
        rows = rows.where(F.col("word").isin(*wanted)).withColumn("asked", F.col("word"))
    each = rows.groupBy("url", "asked").agg(F.sum(F.col("hits") * F.when(F.col("in_title"), title_weight).otherwise(1)).alias("score"))
    found = each.groupBy("url").agg(F.count(F.lit(1)).alias("__n"), F.sum("score").alias("score"))
    return found.where(F.col("__n") == len(wanted)).drop("__n")


def search_over(indexes: dict[str, DataFrame], words: list[str], analysed: bool = False) -> DataFrame:
    """The same over the indexes of all languages, each with its name; a page in two of them is found once, in the better."""
    parts = [search(df, words, analysed=analysed).withColumn("language_index", F.lit(name)) for name, df in sorted(indexes.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("url").agg(F.max_by("language_index", F.struct("score", "language_index")).alias("language_index"), F.max("score").alias("score"))


def search_document(pages: DataFrame) -> DataFrame:
    """Full-text documents ``title, url, content, crawled_at, language`` of pages; one without text is none."""
    lang = F.coalesce(primary_language(F.col("language")), F.lit(OTHER))
    return pages.where(F.coalesce(F.trim("text"), F.lit("")) != "").select(F.coalesce("title", F.lit("")).alias("title"), F.col("canonical_url").alias("url"), F.col("text").alias("content"), "crawled_at", lang.alias("language"))


def page_of(found: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """One page of results, best first, equals in the order of addresses."""
    return found.orderBy(F.desc("score"), "url").offset(max(number - 1, 0) * size).limit(size)


def excerpt(content: Column, words: list[str], around: int = 60) -> Column:
    """Fragments around the words joined by an ellipsis, else the beginning of the content."""
    pattern = r"(?is)\b.{0,%d}(?:%s).{0,%d}" % (around, "|".join(rf"\b\Q{w}\E\b" for w in words) or "(?!)", around)
    parts = F.slice(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), 1, 3)
    return F.when(F.size(parts) > 0, F.array_join(parts, " … ")).otherwise(F.left(content, F.lit(SHOWN)))


# Kinds of representations that formats ask for, and the one meant where none is known.
KINDS, DEFAULT_KIND = ("markdown", "text"), "markdown"


def kinds(formats: Column) -> Column:
    """The kinds that a request's formats ask for, in their order; unknown ones are left out."""
    known = F.filter(F.coalesce(formats, F.array().cast("array<string>")), lambda f: f.isin(*KINDS))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(DEFAULT_KIND)))


def objects(pages: DataFrame, body: str, order: list[str], url: str = "canonical_url") -> DataFrame:
    """``name, url, body``: one object for each address, the last version of its page, named by its key."""
    kept = latest(pages.select(url, body, *[c for c in order if c not in (url, body)]).where(F.col(body).isNotNull()), [url], order)
    return kept.select(hashing.url_key(F.col(url)).alias("name"), F.col(url).alias("url"), F.col(body).alias("body"))


def recall(requests: DataFrame, corpora: dict[str, DataFrame], redirected: DataFrame | None = None, max_bytes: int = 4 << 20) -> DataFrame:
    """``url, kind, body, state`` for each requested address and kind: found, too large, or unavailable.

    ``corpora`` maps a kind to ``url, body``. Addresses that redirect are looked up where they lead.
    """
    asked = requests.select("url").distinct()
    if redirected is not None:
        asked = asked.join(redirected.select("url", "resolved_url"), "url", "left").select("url", F.coalesce("resolved_url", "url").alias("at"))
    else:
        asked = asked.withColumn("at", F.col("url"))
    out = None
    for kind, df in corpora.items():
        rows = asked.join(df.select(F.col("url").alias("at"), "body"), "at", "left")
        size = F.octet_length("body")
        state = F.when(F.col("body").isNull(), "unavailable").when(size > max_bytes, "too large").otherwise("found")
        part = rows.select("url", F.lit(kind).alias("kind"), F.when(size <= max_bytes, F.col("body")).alias("body"), state.alias("state"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no corpus")
    return out
