"""The language of each text, and of each span of a text in another language, with a confidence.

Script ranges narrow the candidates of a word: the script of its letters leaves the languages whose samples are written
in it; a script of no language says nothing. A word known from labelled samples scores by its frequency in each language, an unknown one in
small letters by its letters (trigrams); an unknown one with a capital is taken for a name and says nothing. A Viterbi
search over the words, with a penalty for each switch, labels spans. Let A be the best language of the whole text, and
the gain of another what it scores above A on its best span. A path with k spans outside of A has at least k switches if
A is on it, else k - 1; so if the greatest gain, and the two greatest together, don't exceed the penalty, no path beats
A throughout, and the search is skipped. Otherwise it runs over all languages that can be on a best path. The test is
vectorised over many texts and never changes the result.

Quoted phrases, addresses, command and log lines don't count. A text has each language in which it has at least two
sentences, or all of its sentences if it has fewer than two. Null and blank texts, and texts without a word that says
anything, have no language.

The model is fitted to at most ``MAX_SAMPLES`` labelled sentences, and to those of at most ``MAX_TEXTS`` further texts
whose label agrees with what the sentences say; every task holds it in memory. These bounds concern the fit alone.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from math import exp, log
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.body import strings
from lodestone.llm.mojibake import as_stored, moves, replaced, restorers, with_rare
from lodestone.llm.sampling import least
from lodestone.session import spread

MAX_SAMPLES = 20_000
MAX_TEXTS = 1_500
SWITCH = 14.0
#: A word with a capital is one of the language, not a name, if so many texts have it.
MIN_TEXTS = 4
_WORST, _WORST_UNKNOWN = 5.0, 2.0
_ALPHA = 0.05
_WORD = re.compile(r"[^\W\d_]+")
_CLOSING = "”\"'»)]"
_QUOTED = re.compile(r"[“„«][^”“„«»\n]+[”“»]|\"[^\"\n]+\"")
_NOT_TEXT = re.compile(r"(?m)^[^\n]*\s--?[a-z][\w\-]*[ =][^\n]*$|^\d{4}-\d\d-\d\d\s[^\n]*=[^\n]*$|\S*(?:://|www\.)\S*|\S*\w=\w\S*")
_MAYBE_NOT_TEXT = ("://", "--", "=", "www.")
#: words and tokens remembered between chunks
MAX_ROWS = 120_000
#: characters handled at once
_CHUNK = 400_000


def samples_of(table: DataFrame, lang: str = "lang", text: str = "text", max_samples: int = MAX_SAMPLES) -> list[tuple[str, str]]:
    """At most ``max_samples`` labelled sentences, the least by their hash."""
    return [(r[0], r[1]) for r in least(table.select(lang, text).where(f"{lang} is not null and {text} is not null"), max_samples)]


@lru_cache(maxsize=65_536)
def _script_of(c: str) -> str:
    """Name of the script a letter is in, as the names of its range begin."""
    return "LATIN" if c < "ɐ" else unicodedata.name(c, "NONE").split(" ", 1)[0].split("-", 1)[0]


def _ends(token: str) -> bool:
    """Whether a token ends a sentence."""
    last = token.rstrip(_CLOSING)[-1:]
    return last != "" and last in ".!?…"


def script(word: str) -> str:
    """The script of most letters of a word, the first of equals."""
    if word.isascii():
        return "LATIN"
    found = Counter(map(_script_of, word))
    return max(found, key=found.__getitem__)


class Model:
    """Scores of words in each language, relative to the best; and labels of texts."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        k = len(self.langs)
        at = {lang: i for i, lang in enumerate(self.langs)}
        small: dict[str, list[int]] = {}
        capital: dict[str, list[int]] = {}
        scripts: dict[str, np.ndarray] = {}
        for lang, text in samples:
            in_text = set()
            for line in self.prepared(text).split("\n"):
                first = True
                for token in line.split():
                    for w in _WORD.findall(token):
                        here = script(w)
                        if w.islower() or here != "LATIN":
                            scripts.setdefault(here, np.zeros(k))[at[lang]] += 1
                            small.setdefault(w.lower(), [0] * k)[at[lang]] += 1
                        elif not first:
                            in_text.add(w.lower())
                        first = False
                    first = first or _ends(token)
            for w in in_text:
                capital.setdefault(w, [0] * k)[at[lang]] += 1
        for w, n in capital.items():
            # names stand in a text or two; a noun that is always written with a capital in many
            if sum(n) >= MIN_TEXTS and w not in small:
                small[w] = n
        most = np.max(list(scripts.values()), axis=0) if scripts else np.zeros(k)
        #: for each script the languages that are mostly written in it
        self.scripts = {x: (n == most) & (n > 0) for x, n in scripts.items()}
        self.told = frozenset(x for x, n in self.scripts.items() if n.any())
        totals = np.array([1.0 + sum(n[i] for n in small.values()) for i in range(k)])
        self._grams(small, k)
        self.ids: dict[str, int] = {}
        rows = [np.zeros(k, np.float32)]  # id 0 says nothing
        for w, n in small.items():
            p = np.log((np.array(n) + _ALPHA) / totals)
            p = np.maximum(p - p.max(), -_WORST)
            self.ids[w] = len(rows)
            rows.append(p.astype(np.float32))
        self.rows = rows
        self.table = np.stack(rows)
        self.known = frozenset(self.ids)
        #: tokens as they stand between spaces: twice the row, and one more if the token ends a sentence
        self.cache: dict[str, int] = {}
        self._made: dict[str, np.ndarray] = {}

    def _grams(self, words: dict[str, list[int]], k: int) -> None:
        grams: dict[str, np.ndarray] = {}
        for w, n in words.items():
            for g in self._of(w):
                grams.setdefault(g, np.zeros(k))[:] += np.minimum(n, 3)
        totals = sum(grams.values(), np.zeros(k)) + 0.5 * len(grams)
        self.grams = {g: np.log((n + 0.5) / totals) for g, n in grams.items()}
        self.no_gram = np.log(0.5 / totals)

    @staticmethod
    def _of(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def _script(self, word: str) -> np.ndarray:
        return np.where(self.scripts[script(word)], 0.0, -_WORST)

    def _row_of(self, word: str) -> int:
        """0 for a word that says nothing, else its row of the table."""
        w = word.lower()
        i = self.ids.get(w)
        if i is not None:
            return i
        here = script(w)
        latin = here == "LATIN"
        if here not in self.told or len(w) < (4 if latin else 2) or latin and not word.islower():
            return 0
        if len(w) < 4:
            return self._add(w, self._script(w))
        p = sum((self.grams.get(g, self.no_gram) for g in self._of(w)), np.zeros(len(self.langs))) / 2 + self._script(w)
        return self._add(w, np.maximum(p - p.max(), -_WORST_UNKNOWN if latin else -_WORST))

    def _id_of(self, token: str) -> int:
        rows = [i for i in map(self._row_of, _WORD.findall(token)) if i]
        row = rows[0] if len(rows) == 1 else self._add("\0" + token, sum(self.rows[i] for i in rows)) if rows else 0
        i = 2 * row + _ends(token)
        if len(self.cache) < MAX_ROWS:
            self.cache[token] = i
        return i

    def _add(self, word: str, p: np.ndarray) -> int:
        self.ids[word] = i = len(self.rows)
        self.rows.append(np.asarray(p, np.float32))
        return i

    @staticmethod
    def prepared(text: str) -> str:
        """Without quoted phrases, addresses, command and log lines."""
        if "“" in text or '"' in text or "«" in text or "„" in text:
            text = _QUOTED.sub(lambda m: " " * len(m.group()), text)
        if any(x in text for x in _MAYBE_NOT_TEXT):
            blank = lambda m: " " * len(m.group())
            text = "\n".join(_NOT_TEXT.sub(blank, x) if any(y in x for y in _MAYBE_NOT_TEXT) else x for x in text.split("\n"))
        return text

    def tokens(self, text: str) -> np.ndarray:
        """Ids of the tokens; an end of a line is a token that ends a sentence."""
        made = self._made.get(text)
        return self._tokens([text])[0] if made is None else made

    def _tokens(self, texts: list[str]) -> list[np.ndarray]:
        """The tokens of many texts: each distinct one is looked up once."""
        lines = pc.split_pattern(pa.array(texts, pa.string()), "\n")
        parts = pc.ascii_split_whitespace(lines.flatten())
        found = parts.flatten().dictionary_encode()
        get, id_of = self.cache.get, self._id_of
        of_found = []
        for token in strings(found.dictionary):
            i = get(token)
            # what stands between blanks of ASCII may be nothing, or hold other blanks
            of_found.append([i] if i is not None else [id_of(t) if (n := get(t)) is None else n for t in token.split()])
        sizes = np.array(list(map(len, of_found)), np.int64)
        flat = np.array(list(chain.from_iterable(of_found)), np.int64)
        token = found.indices.to_numpy()
        n = sizes[token]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[token] - (ends - n), n) + np.arange(n.sum())]
        # where each line ends, among the tokens
        ends = np.concatenate([[0], ends])[np.cumsum(parts.value_lengths().to_numpy())]
        ids = np.insert(ids, ends, 1)
        of_texts = np.cumsum(lines.value_lengths().to_numpy())
        return np.split(ids, (ends[of_texts - 1] + of_texts)[:-1]) if texts else []

    def _refresh(self) -> None:
        """Between chunks: forget words beyond the samples' when they are many; their rows would pile up."""
        if len(self.rows) > MAX_ROWS:
            self.rows, self.cache = self.rows[: 1 + len(self.known)], {}
            self.ids = {w: i for w, i in self.ids.items() if w in self.known}
            self.table = np.stack(self.rows)

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, list[int] | None, np.ndarray]]:
        """For each text its token ids, the path (None if constant), and the summed scores."""
        self._refresh()
        self._made = dict(zip(texts, self._tokens(texts), strict=True))
        ids = [np.asarray(self.tokens(t), np.int64) for t in texts]
        self._made = {}
        if len(self.rows) != len(self.table):
            self.table = np.concatenate([self.table, np.stack(self.rows[len(self.table) :])])
        sums = np.zeros((len(ids), len(self.langs)))
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]) >> 1
        says = np.flatnonzero(flat)  # the others change no sum
        counts = np.bincount(np.repeat(np.arange(len(ids)), list(map(len, ids)))[says], minlength=len(ids))
        some = np.flatnonzero(counts)
        if not len(some):
            return [(x, None, sums[i]) for i, x in enumerate(ids)]
        score, counts = self.table[flat[says]], counts[some]
        first = np.cumsum(counts) - counts
        sums[some] = np.add.reduceat(score, first, axis=0)
        best = sums.argmax(axis=1)
        # gain of each language over the best one of the text on its best span
        of_best = score[np.arange(len(score)), np.repeat(best[some], counts)]
        doc = np.repeat(np.arange(len(some)), counts)
        most = np.empty((len(some), len(self.langs)))
        for lang in range(len(self.langs)):
            c = np.cumsum(score[:, lang] - of_best, dtype=np.float64)
            span = float(np.ptp(c)) + 1.0
            c -= doc * span
            before = np.concatenate([[0.0], c[:-1]])
            before[first[1:]] -= span
            c -= np.minimum.accumulate(before)
            most[:, lang] = np.maximum.reduceat(c, first)
        out: list = [(x, None, sums[i]) for i, x in enumerate(ids)]
        top = np.sort(np.column_stack([most, np.zeros(len(some))]), axis=1)[:, :-3:-1]
        for j in np.flatnonzero((top[:, 0] > SWITCH) | (top.sum(axis=1) > SWITCH)).tolist():
            i, a = int(some[j]), first[j]
            rivals = np.flatnonzero(most[j] > max(0.0, SWITCH - top[j, 0]))
            path = self._path(ids[i] > 1, score[a : a + counts[j]], sorted({int(best[i]), *rivals.tolist()}))
            if path[0] != best[i] or len(set(path)) > 1:
                out[i] = ids[i], path, sums[i]
        return out

    def _path(self, says: np.ndarray, score: np.ndarray, states: list[int]) -> list[int]:
        """The best path, by the scores of the tokens that say something; the others stay in the language before them, at the beginning in the one after."""
        told = self._viterbi(score, states)
        return [told[max(i, 0)] for i in (np.cumsum(says) - 1).tolist()]

    @staticmethod
    def _viterbi(score: np.ndarray, states: list[int]) -> list[int]:
        """The best path over the given languages."""
        columns = score[:, states].tolist()
        k = range(len(states))
        now = [0.0] * len(states)
        back: list[list[int] | None] = []
        for row in columns:
            least = max(now) - SWITCH
            if min(now) >= least:  # none comes from another
                back.append(None)
            else:
                top = now.index(max(now))
                back.append([s if now[s] >= least else top for s in k])
                now = [x if x >= least else least for x in now]
            now = list(map(add, now, row))
        s = max(k, key=now.__getitem__)
        path = []
        for step in reversed(back):
            path.append(states[s])
            s = step[s] if step else s
        return path[::-1]

    def languages(self, ids: np.ndarray, path: list[int] | None, sums: np.ndarray) -> list[int]:
        """The languages a text has."""
        if path is None:
            return [int(sums.argmax())] if self._evidence(sums) else []
        counts: Counter = Counter()
        votes: Counter = Counter()
        sentences = 0
        for i, lang in zip(ids.tolist(), path, strict=True):
            if i > 1:
                votes[lang] += 1
            if i & 1 and votes:
                lang, n = votes.most_common(1)[0]
                if n >= 2:
                    counts[lang] += 1
                    sentences += 1
                votes = Counter()
        return sorted(lang for lang, n in counts.items() if n >= min(2, sentences))

    @staticmethod
    def _evidence(sums: np.ndarray) -> bool:
        a = sorted(sums.tolist())
        return a[-1] - a[-2] > 0.5

    def confidence(self, sums: np.ndarray, words: int) -> float:
        """Of the best language against the next, tempered as words of a text depend on each other."""
        a = np.sort(sums)
        return 1.0 / (1.0 + exp(-min(50.0, (a[-1] - a[-2]) / (1.0 + 0.1 * words**0.5)))) if words else 0.0

    def segments(self, text: str, ids: np.ndarray, path: list[int] | None, sums: np.ndarray) -> list[tuple[int, int, str, float]]:
        """``(start, end, language, confidence)`` of the spans of a text; none for a text without a language."""
        words = int((ids > 1).sum())
        if path is None:
            return [(0, len(text), self.langs[int(sums.argmax())], self.confidence(sums, words))] if self._evidence(sums) else []
        spans = [m.span() for m in re.finditer(r"[^\s]+|\n|$(?<!\n)|(?<=\n)$", text)]
        cuts = [0] + [i for i in range(1, len(path)) if path[i] != path[i - 1]] + [len(path)]
        out, start = [], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            end = len(text) if b == len(path) else min(spans[b][0], len(text))
            part = self.table[ids[a:b] >> 1].sum(axis=0)
            out.append((start, end, self.langs[path[a]], self.confidence(part, int((ids[a:b] > 1).sum()))))
            start = end
        return out


def confirmed(table: DataFrame, lang: Column, text: Column, samples: list[tuple[str, str]], max_texts: int = MAX_TEXTS) -> list[tuple[str, str]]:
    """More samples: of the ``max_texts`` rows that are least by a hash of their text, those whose label is what the samples alone say, in one language."""
    rows = table.select(label_language(lang).alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    rows = least(rows, max_texts)
    model = Model(samples)
    out = []
    for i in range(0, len(rows), 100):
        part = rows[i : i + 100]
        for r, (ids, path, sums) in zip(part, model.label([model.prepared(r.text) for r in part]), strict=True):
            if path is None and r.lang in model.langs and model.languages(ids, path, sums) == [model.langs.index(r.lang)]:
                out.append((r.lang, r.text))
    return out


def label_language(label: Column) -> Column:
    """The two letters a label names, else null."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.nullif(first, F.lit(""))


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        start, held, texts = 0, 0, []
        for n, t in enumerate(b.column(text_at).to_pylist()):
            texts.append(t)
            held += len(t) if t else 0
            if held > _CHUNK:
                yield b.slice(start, n + 1 - start), texts
                start, held, texts = n + 1, 0, []
        if texts:
            yield b.slice(start), texts


def _get_ready(look, texts: list[str]) -> None:  # noqa: ANN001
    """A ``look`` that has a method of this name gets many texts ready at once."""
    if hasattr(look, "look"):
        look.look(texts)


def _looked_at(text: str, spans: list[tuple[int, int]]) -> str:
    return "\n".join(text[a:z] for a, z in spans)


def _placed(spans: list[tuple[int, int]], at: int) -> int:
    """The place in a text of a place in the lines that are looked at."""
    begin = [0, *accumulate(z - a + 1 for a, z in spans)]
    i = bisect_right(begin, at, 0, len(spans)) - 1
    return spans[i][0] + at - begin[i]


def segments(df: DataFrame, keys: list[Column], text: Column, model: Model, clean=None, counts=None) -> DataFrame:  # noqa: ANN001
    """Key columns, ``segment`` (from 1), ``start``, ``end`` (characters of the stored text), ``lang``, ``confidence``.

    ``clean`` makes, in each task, a function from a text to the spans of its lines that are looked at; lines between
    these lie within a segment, but don't count. Garbled texts are repaired before by the ``counts`` of
    ``mojibake.Restorer``, if given.
    """
    rows = spread(with_rare(df.select(*keys, text.alias("__text")).where("__text is not null"), "__text", counts))
    kept, restorer = rows.schema[:-2], counts and restorers(df.sparkSession, counts)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", segment int, start int, end int, lang string, confidence double, sentences int"

    shared = df.sparkSession.sparkContext.broadcast(model)  # words of bounded samples: a megabyte or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, look, r = shared.value, clean() if clean else None, restorer() if restorer else None
        for b, texts in _chunks(batches, len(kept)):
            damage = r.damages(texts, b.column(len(kept) + 1).to_pylist()) if r else [[]] * len(texts)
            texts = [replaced(t, x) if x else t for t, x in zip(texts, damage, strict=True)]
            _get_ready(look, texts)
            lines = [look(t) if look else [(0, len(t))] for t in texts]
            seen = [model.prepared(_looked_at(t, x)) for t, x in zip(texts, lines, strict=True)]
            shifts = [moves(x) for x in damage]
            at, out = [], []
            for n, (t, (ids, path, sums)) in enumerate(zip(seen, model.label(seen), strict=True)):
                has = {model.langs[x] for x in model.languages(ids, path, sums)}
                for i, (a, z, lang, c) in enumerate(model.segments(t, ids, path, sums), 1):
                    a, z = _placed(lines[n], a), _placed(lines[n], z - 1) + 1
                    if shifts[n]:
                        a, z = as_stored(shifts[n], a), as_stored(shifts[n], z, end=True)
                    at.append(n)
                    out.append((i, a, z, lang, round(c, 6), int(lang in has)))
            taken = b.take(pa.array(at, pa.int64()))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            made = [pa.array([r[i] for r in out], k) for i, k in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*taken.columns[:-2], *made], names=[f.name for f in kept] + ["segment", "start", "end", "lang", "confidence", "sentences"])

    return rows.mapInArrow(run, schema).withColumn("counts", F.col("sentences") == 1).drop("sentences")


def languages(df: DataFrame, keys: list[Column], text: Column, model: Model, clean=None, counts=None, read: bool = True) -> DataFrame:  # noqa: ANN001
    """Key columns and ``langs``, the languages each text has (an empty array where it has none).

    ``clean`` makes, in each task, a function from a text to the spans of its lines that are looked at. Garbled
    texts are repaired before by the ``counts`` of ``mojibake.Restorer``, if given. ``read`` says that rows come right
    from a table, and may be spread over the cores.
    """
    rows = with_rare(df.select(*keys, text.alias("__text")), "__text", counts)
    rows = spread(rows) if read else rows
    kept, restorer = rows.schema[:-2], counts and restorers(df.sparkSession, counts)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", langs array<string>"

    shared = df.sparkSession.sparkContext.broadcast(model)  # words of bounded samples: a megabyte or so

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, look, r = shared.value, clean() if clean else None, restorer() if restorer else None

        def labelled(texts: list[str]) -> list[list[str]]:
            _get_ready(look, texts)
            return [[model.langs[x] for x in model.languages(*r)] for r in model.label([model.prepared(_looked_at(t, look(t)) if look else t) for t in texts])]

        for b, texts in _chunks(batches, len(kept)):
            damage = r.damages(texts, b.column(len(kept) + 1).to_pylist()) if r else [[]] * len(texts)
            found = labelled([replaced(t, x) if x else t or "" for t, x in zip(texts, damage, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(found, pa.list_(pa.string()))], names=[f.name for f in kept] + ["langs"])

    return rows.mapInArrow(run, schema)
