"""Texts cut off at a length limit or in transfer, and how often each source cuts.

Two named kinds of evidence. ``limit``: per source, the discrete hazard of a length is the share of texts that end there
among those that reach it. A limit shows as a hazard far above the hazards of the lengths around it; the tail probability
of each is bounded (Chernoff), and lengths are significant under false-discovery control (Benjamini-Hochberg, within
each source), for lengths in characters and in bytes. A text of a significant length is cut if its ending is incomplete:
if no sentence ends there. ``transfer``: at any other length a text is cut only if the ending itself shows it.

Endings: what follows the last complete unit of the text, before a mark that stands after it. A text that ends in a
sentence mark is complete; one that stops in running text is cut. A list entry, or words before a mark that stands
apart, are in doubt; off the limits they are cut unless their last two words end clauses elsewhere: at the rate
``CLAUSE_RATE`` of all their occurrences in distinct texts, not counting one (before a mark, a word with a capital
stands for any such word). Signatures, addresses, command and log lines are complete in form, and cut at limits alone,
as their last name or number can't show a cut.

Null and blank texts are never cut. A null source is a source of its own. Equal texts are judged alike, and count
once for the hazards and clauses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import materialise, spread

#: Lengths on either side that a hazard is tested against, and those next to it that share its cause (blanks trimmed).
NEIGHBOURS, NEAR = 150, 3
FALSE_DISCOVERIES = 0.01
#: Texts at least to end at a length for it to be tested as a limit.
LEAST = 3
#: Share of the occurrences of two words that end a clause, for these to be able to end a text.
CLAUSE_RATE = 0.1
#: Words in doubt, and copies of texts, that tasks hold in memory; beyond, all pairs are counted and joins shuffle.
MAX_HELD = 500_000

_CLOSING = "\"'”’»)]}"
_SENTENCE_MARKS = ".!?。！？"
_BRACKETED = re.compile(r"…|\.\.\.|[a-z ]+")
_LIST = re.compile(r"^\s*(?:[-*•‣◦›–]|\d{1,3}[.)])\s+\S")
_SIGNED = re.compile(r"^\s*[—–]+\s*\S")
_SIGNATURE = re.compile(r"^\s*[—–]+\s*[^\W\d_a-z][^\W\d_]+(?:[ '\-][^\W\d_]+)+$")
_ADDRESS = re.compile(r"^\s*(?:https?|ftp)://[^\s/]+\.[a-z]{2,}(?::\d+)?(?:[/?#]\S*)?$")
_ADDRESS_LIKE = re.compile(r"^\s*(?:h|ht|htt|https?:?/{0,2}\S*|ftp:\S*)$")
_COMMAND = re.compile(r"^\s*[$>#]?\s*[a-z][a-z0-9_.\-]*(?:\s+\S+)*\s+--?[a-z][\w\-]*(?:[ =]\S+)*$")
_VALUE = re.compile(r"--?[a-z][\w\-]*[ =]\S*[.\d]\S*$")
_LOG = re.compile(r"^\s*\d{4}-\d\d-\d\d.*\b\w+=\S+")
_CLAUSE_MARKS = ".!?;,"
_AROUND = "\"“”„«»‘()[]…"
_INSIDE = str.maketrans("", "", "'’-")

COMPLETE, CUT, ASK, FORM = "complete", "cut", "ask", "form"
LIMIT, TRANSFER = "limit", "transfer"


def _without_mark(text: str) -> tuple[str, str]:
    """A text without the mark at its end that shows a cut or an ending, and that mark."""
    last = text[-1]
    if last == "�":
        bare = text.rstrip("�")
    elif last == "…" or text.endswith("..."):
        bare = text.rstrip("…") if last == "…" else text.rstrip(".")
    elif last in "-–—→»":
        bare = text[:-1]
    elif text.endswith(">>"):
        bare = text[:-2]
    elif last in ")]" and (at := text.rfind("[" if last == "]" else "(")) >= 0 and (m := _BRACKETED.fullmatch(text, at + 1, len(text) - 1)) and (last == "]" or not m.group().isascii() or "." in m.group()):
        bare = text[:at]
    else:
        return text, ""
    return bare, text[len(bare) :]


def _ends_sentence(text: str) -> bool:
    return text.rstrip(_CLOSING)[-1:] in tuple(_SENTENCE_MARKS)


def ending(text: str) -> tuple[str, str | None]:
    """``(verdict, last two words)``: ``complete``, ``cut``, ``ask`` (by the clause ends of the corpus) or ``form`` (a line complete in form)."""
    text = text.rstrip()
    if not text:
        return COMPLETE, None
    text, mark = _without_mark(text)
    apart = bool(mark) and text[-1:].isspace()
    text = text.rstrip()
    if "�" in mark or not text:
        return CUT, None
    last = text[text.rfind("\n") + 1 :]
    if _ADDRESS_LIKE.match(last):
        return (FORM if _ADDRESS.match(last) and last[-1].isalnum() | (last[-1] == "/") else CUT), None
    if _LOG.match(last):
        return FORM, None
    if _SIGNED.match(last):
        return (FORM if _SIGNATURE.match(last) else CUT), None
    if " -" in last and not _ends_sentence(last) and _COMMAND.match(last):
        return (FORM if last[-1].isalnum() and _VALUE.search(last) else CUT), None
    if _ends_sentence(text):
        return COMPLETE, None
    two = last_two(last)
    words = f"{two[0]} {two[1]}".lower() if two else None
    if _LIST.match(last) and (not mark or apart):
        return (ASK, words) if words else (CUT, None)
    if apart:
        return (ASK, min(_keys(*two), key=lambda k: "*" not in k)) if two else (CUT, None)
    return CUT, None


def last_two(text: str) -> tuple[str, str] | None:
    """The last two words of a text, without marks around them; None if one isn't made of letters."""
    words = text.rsplit(None, 2)[-2:]
    if len(words) < 2:
        return None
    a, b = words[0].strip(_AROUND), words[1].strip(_AROUND)
    return (a, b) if a.translate(_INSIDE).isalpha() and b.translate(_INSIDE).isalpha() else None


def _keys(a: str, b: str) -> list[str]:
    """Two words as they stand, and with either one that has a capital as a star."""
    out = [f"{a} {b}".lower()]
    if b[0].isupper():
        out.append(f"{a} *".lower())
    if a[0].isupper():
        out.append(f"* {b}".lower())
    return out


class Clauses:
    """Occurrences of two words in texts, and how many of them end a clause; of ``asked`` pairs alone, if given."""

    def __init__(self, asked: frozenset[str] | None):
        self.asked, self.firsts = asked, asked and {x.split(" ")[0] for x in asked}
        self.counts: dict[str, list[int]] = {}
        self._tokens: dict[str, tuple[str | None, bool, bool]] = {}

    def _token(self, token: str) -> tuple[str | None, bool, bool]:
        """The word of a token, whether it can begin a pair that is asked for, and whether it ends a clause."""
        word = token.rstrip(_CLAUSE_MARKS).strip(_AROUND)
        word = word if word.translate(_INSIDE).isalpha() else None
        begins = word is not None and (self.asked is None or word.lower() in self.firsts or word[0].isupper() and "*" in self.firsts)
        if len(self._tokens) > 300_000:
            self._tokens.clear()
        self._tokens[token] = out = word, begins, token[-1] in _CLAUSE_MARKS
        return out

    def read(self, text: str) -> None:
        """Pairs within a clause; where a line ends without a mark it isn't known whether a clause does."""
        get, asked, counts = self._tokens.get, self.asked, self.counts
        for line in text.split("\n"):
            tokens = [get(t) or self._token(t) for t in line.split()]
            last = len(tokens) - 1
            for i, (word, begins, ends) in enumerate(tokens):
                if begins and not ends and i < last:
                    second, _, closes = tokens[i + 1]
                    if second is not None and (closes or i + 1 < last):
                        for k in _keys(word, second):
                            if asked is None or k in asked:
                                n = counts.setdefault(k, [0, 0])
                                n[0] += closes
                                n[1] += 1

    def batch(self) -> pa.RecordBatch:
        words, n = list(self.counts), list(self.counts.values())
        self.counts = {}
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64())], names=["words", "ends", "n"])


_SCHEMA = "doc_id long, source string, fp long, n_chars long, n_bytes long, verdict string, words string"
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
    for b in batches:
        rows = [(i, source, fp, len(text), len(text.encode("utf-8", "surrogatepass")), *ending(text)) for i, source, fp, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if text and not text.isspace()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_TYPES)], names=names)


def _rows(documents: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))


def endings(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per non-blank text its source, lengths and verdict, as a written table."""
    return materialise(spread(_rows(documents, doc_id, source, text)).mapInArrow(_read, _SCHEMA), "endings")


def clause_ends(documents: DataFrame, texts: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", max_held: int = MAX_HELD) -> DataFrame:
    """``words, ends, n`` of each pair of words in doubt: in how many places of distinct texts it stands, and ends a clause."""
    asked = materialise(texts.where(F.col("verdict") == ASK).select("words").distinct(), "asked-words")
    held = asked.limit(max_held + 1).collect()
    known = frozenset(r.words for r in held) if len(held) <= max_held else None
    shared = documents.sparkSession.sparkContext.broadcast(known)
    again = texts.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("fp", "first")
    copies = materialise(texts.select("fp", "doc_id").join(again, "fp").where("doc_id <> first").select("doc_id").distinct(), "copies")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Clauses(shared.value)
        for b in batches:
            for t in b.column(0):
                c.read(t.as_py())
            if len(c.counts) > 300_000:
                yield c.batch()
        yield c.batch()

    rows = _rows(documents, doc_id, source, text).where("text is not null")
    rows = rows.join(F.broadcast(copies) if copies.count() <= max_held else copies, "doc_id", "left_anti").select("text")
    counts = spread(rows).mapInArrow(count, "words string, ends long, n long").groupBy("words").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    return asked.join(counts, "words", "left").select("words", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("n", F.lit(0)).alias("n"))


def length_hazards(texts: DataFrame, neighbours: int = NEIGHBOURS, near: int = NEAR, rate: float = FALSE_DISCOVERIES, least: int = LEAST) -> DataFrame:
    """``source, unit, length, n, at_risk, p, limit`` of each length at which texts of a source end.

    Rows are lengths, not texts: every window is over the distinct lengths of one source.
    """
    long = texts.dropDuplicates(["source", "fp"]).select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("l"))
    counts = long.groupBy("source", "l.unit", "l.length").agg(F.count(F.lit(1)).alias("n"))
    of = W.partitionBy("source", "unit")
    risk = F.sum("n").over(of.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0))
    around = F.sum("n").over(of.orderBy("length").rangeBetween(-neighbours, neighbours)) - F.sum("n").over(of.orderBy("length").rangeBetween(-near, near))
    h = counts.withColumns({"at_risk": risk, "around": around})
    # chance that a text which reaches the length ends at it, from the lengths around
    h = h.withColumn("p0", F.least((F.col("around") + 0.5) / ((2 * neighbours) * F.col("at_risk") + 1.0), F.lit(0.5)))
    x = F.col("n") / F.col("at_risk")
    rest = F.when(x < 1, (1 - x) * F.log((1 - x) / (1 - F.col("p0")))).otherwise(F.lit(0.0))
    h = h.withColumn("p", F.when((x > F.col("p0")) & (F.col("n") >= least), F.exp(-F.col("at_risk") * (x * F.log(x / F.col("p0")) + rest))).otherwise(F.lit(1.0)))
    rank, tests = F.row_number().over(of.orderBy("p", "length")), F.count(F.lit(1)).over(of)
    h = h.withColumn("passes", F.when(F.col("p") <= F.lit(rate) * rank / tests, F.col("p")))
    h = h.withColumn("limit", F.coalesce(F.col("p") <= F.max("passes").over(of), F.lit(False)))
    return h.select("source", "unit", "length", "n", "at_risk", "p", "limit")


def truncated(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, cut, evidence, at_limit`` of each non-blank text, and the hazards of the lengths.

    ``evidence`` is ``limit`` or ``transfer`` for a text that is cut, else null.
    """
    texts = endings(documents, doc_id, source, text)
    hazards = materialise(length_hazards(texts), "hazards")
    limits = hazards.where("limit").select(F.col("source").alias("s"), "unit", F.col("length").alias("l"))
    by = lambda unit, c: limits.where(F.col("unit") == unit).select(F.col("s").alias(f"s_{unit}"), F.col("l").alias(f"l_{unit}"))
    chars, sizes = by("chars", "n_chars"), by("bytes", "n_bytes")
    rows = texts.join(chars, F.col("source").eqNullSafe(F.col("s_chars")) & (F.col("n_chars") == F.col("l_chars")), "left")
    rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("s_bytes")) & (F.col("n_bytes") == F.col("l_bytes")), "left")
    rows = rows.withColumn("at_limit", F.col("l_chars").isNotNull() | F.col("l_bytes").isNotNull())
    doubt = (F.col("verdict") == ASK) & ~F.col("at_limit")
    ends = clause_ends(documents, texts, doc_id, source, text).where(F.col("ends") - 1 >= CLAUSE_RATE * F.col("n")).select("words", F.lit(True).alias("can_end"))
    limit = F.col("at_limit") & (F.col("verdict") != COMPLETE)
    rest = rows.where(~doubt).select("doc_id", "source", "at_limit", F.when(limit, LIMIT).when(F.col("verdict") == CUT, TRANSFER).alias("evidence"))
    asked = rows.where(doubt).join(ends, "words", "left").select("doc_id", "source", "at_limit", F.when(F.col("can_end").isNull(), TRANSFER).alias("evidence"))
    out = rest.unionByName(asked)
    return out.select("doc_id", "source", F.col("evidence").isNotNull().alias("cut"), "evidence", "at_limit"), hazards
