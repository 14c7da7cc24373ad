"""The main body of a page whose text mixes it with furniture: menus, notices, side boxes, footers.

A page is a sequence of tokens: words, and tags where the text has lost its markup (bullets, separators of menus and
paths, arrows, marks at the end of a line, how many words stand on it). Every token has a weight, positive for what the
body is made of, negative for the rest; a line scores the sum over its tokens, whatever its length. One linear scan over
the scores of the lines finds the best contiguous region (maximum-scoring subsequence); lines within it that score below
zero interrupt it and are furniture too. A line that opens a list of links turns the headings below it into links,
whatever their words.

The weights are a logistic regression over labelled pages, and the pages label themselves: those at hand (``fitted``), or
all of some tables (``bodyfit.fitted``). Names are masked: words of fewer than ``NAME_SITES`` sites. What is the same in ``REPEATED`` pages or more is furniture, unless it mostly follows the page's
own title (a byline); it opens a list if mostly single lines that repeat nowhere come after it. Shapes of lines that
stand hardly ever between two paragraphs are furniture; sentences, the page's own title (or what stands before a byline), and
what stands between paragraphs without being repeated are of the body. So nothing is written down about any site or language.

Nothing is shuffled: each page is scored where it is read, in one pass. A null text has no lines; an empty or blank line
belongs to neither side and is never reported, nor kept at the ends of a body; a page without any line of positive score
has no body. Without any page to learn from every line is of the body.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain, islice
from sys import intern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sampling import least
from lodestone.session import spread

MAX_SAMPLES, MAX_PAGES, MAX_PAGE_CHARS = 20_000, 2_000, 100_000
REPEATED, NAME_SITES = 5, 3
#: shares by which repeated lines and shapes are told apart
_BYLINE, _OPENER, _OUTSIDE = 0.3, 0.6, 0.05
_WORDS_OF_PARAGRAPH = 12
_CLIP, _FLOOR, _LEAST = 30.0, -4.0, 3
#: in doubt a line stays
_LEAN = 1.0
_STEPS, _RATE, _SHRINK = 150, 0.5, 1e-6
_WORD = re.compile(r"[^\W\d_]+|\d+")
_DIGIT = re.compile(r"\d")
_TAG = re.compile(r"[›»|·←→©•/–…:]")
_TWO_BLANKS = re.compile(r"\s\s")
_CLOSING = "\"'”»)]"
_BULLET = re.compile(r"^\s*(?:([-*•–])|(\d+)[.)])\s")
_ALPHANUMERIC = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"x(?:[ '’,;.!?()\-]+x)*")
_BLANKS = re.compile(r"\s+")
#: upper ends of the classes of how many words a line has
_SIZES = (0, 1, 2, 3, 4, 6, 9, 14, 24, 49)
_NAME = "xxx"
_CACHED = 200
_HELD = 50_000
_TOKENS = 30_000
#: odd, for the hash of a word at a place of a line
_PLACE = 0x9E3779B97F4A7C15
#: characters worked on at once
_AT_ONCE = 1_000_000


class _Tokens(dict):
    """What is made of a token, once; a bounded number of them is held."""

    def __init__(self, make):  # noqa: ANN001
        super().__init__()
        self.make = make

    def __missing__(self, token: str):  # noqa: ANN204
        if len(self) > 100_000:
            self.clear()
        self[token] = made = self.make(token)
        return made


#: No word or number spans a blank, so a line's are those of its tokens.
_words_of = _Tokens(lambda token: tuple(_WORD.findall(token))).__getitem__
_masked_of = _Tokens(lambda token: tuple(["0" if w.isdigit() else w for w in _WORD.findall(token)])).__getitem__
_signs_of = _Tokens(lambda token: _ALPHANUMERIC.sub("x", token)).__getitem__


def _words(line: str) -> list[str]:
    """The words of a line in small letters; where it has a digit, its numbers are alike."""
    return list(chain.from_iterable(map(_masked_of if _DIGIT.search(line) else _words_of, line.lower().split())))


def strings(column: pa.Array) -> list[str]:
    """The strings of a column that has no null; several times as fast as ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Vocabulary:
    """Words by number, and those of tokens; a token is taken apart once as long as it is held."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.of_token: dict[str, list[int]] = {}
        #: words that are numbers, and those that make a line's numbers alike
        self.digits, self.decimal = np.zeros(0, bool), np.zeros(0, bool)
        self.zero = self._number("0")

    def _number(self, word: str) -> int:
        return self.numbers.setdefault(word, len(self.numbers))

    def taken(self, lines: list[str], alike: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of some texts, in order, the number of its text and of itself: words of ``_words``, or with all numbers as they are."""
        parts = pc.ascii_split_whitespace(pa.array(lines, pa.string()))
        tokens = parts.flatten().dictionary_encode()
        of_token, of_tokens = self.of_token, []
        for t in strings(tokens.dictionary):
            ws = of_token.get(t)
            if ws is None:
                small = t.lower()
                of_token[t] = ws = [self._number(small)] if small.isalpha() else list(map(self._number, _WORD.findall(small)))
            of_tokens.append(ws)
        sizes = np.array(list(map(len, of_tokens)), np.int64)
        flat = np.array(list(chain.from_iterable(of_tokens)), np.int64)
        token = tokens.indices.to_numpy()
        n = sizes[token]
        line = np.repeat(np.repeat(np.arange(len(lines)), parts.value_lengths().to_numpy()), n)
        word = flat[np.repeat((np.cumsum(sizes) - sizes)[token] - (np.cumsum(n) - n), n) + np.arange(len(line))]
        if alike:
            digits, has = self.are_digits(), np.zeros(len(lines), bool)
            has[line[self.decimal[word]]] = True
            word = np.where(digits[word] & has[line], self.zero, word)
        return line, word

    def are_digits(self) -> np.ndarray:
        new = list(islice(self.numbers, len(self.digits), None))
        self.digits, self.decimal = (np.concatenate([have, np.array([f(w) for w in new], bool)]) for have, f in ((self.digits, str.isdigit), (self.decimal, str.isdecimal)))
        return self.digits

    def bounded(self) -> Vocabulary:
        """This one, or an empty one if it holds many tokens."""
        return self if len(self.of_token) <= _TOKENS else Vocabulary()


class Told:
    """A vocabulary with what is ``told`` of its words, and their weights."""

    def __init__(self, known: frozenset[str], weights: dict | None = None):
        self.known, self.weights = known, weights or {}
        self._forget()

    def _forget(self) -> None:
        self.vocabulary, self.hashes, self.tells, self.scores = Vocabulary(), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0)

    def taken(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``Vocabulary.taken``; all is known of the words then."""
        if self.vocabulary.bounded() is not self.vocabulary:
            self._forget()
        line, word = self.vocabulary.taken(lines)
        if new := list(islice(self.vocabulary.numbers, len(self.scores), None)):
            made = *told(new, self.known), np.array([self.weights.get(w, 0.0) for w in new])
            self.hashes, self.tells, self.scores = (np.concatenate(x) for x in zip((self.hashes, self.tells, self.scores), made, strict=True))
        return line, word

    def skeletons(self, line: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        return skeletons_of(line, word, self.hashes, self.tells, n)


def worded(lines: list[str], alike: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What ``Vocabulary.taken`` says of some texts by themselves; and the words by number."""
    v = Vocabulary()
    line, word = v.taken(lines, alike)
    return line, word, list(v.numbers)


def distinct(line: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``n`` words once in each line, in order of lines."""
    bits = n.bit_length()
    both = np.sort(line << bits | word)
    both = both[np.diff(both, prepend=-1) != 0]
    return both >> bits, both & (1 << bits) - 1


def hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def told(words: Iterable[str], known: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, names alike; and which of them tell a line from one of names and numbers."""
    of_name, words = hashed(_NAME), list(words)
    return np.array([hashed(w) if w in known else of_name for w in words], np.int64).view(np.uint64), np.array([w in known and w not in (_NAME, "0") for w in words], bool)


def skeletons(line: np.ndarray, word: np.ndarray, words: list[str], known: frozenset[str], n: int) -> np.ndarray:
    """Hashes of the skeletons of ``n`` lines of these words; 0 for one of names and numbers alone."""
    return skeletons_of(line, word, *told(words, known), n)


def skeletons_of(line: np.ndarray, word: np.ndarray, of_words: np.ndarray, tells: np.ndarray, n: int) -> np.ndarray:
    """The same, by what is ``told`` of the words."""
    out = np.zeros(n, np.uint64)
    if len(line):
        first = np.flatnonzero(np.diff(line, prepend=-1))
        place = np.arange(len(line)) - np.repeat(first, np.diff(first, append=len(line)))
        powers = np.cumprod(np.full(place.max() + 1, _PLACE, np.uint64), dtype=np.uint64)
        some = np.logical_or.reduceat(tells[word], first)
        out[line[first]] = np.where(some, np.maximum(np.add.reduceat(of_words[word] * powers[place], first), np.uint64(1)), np.uint64(0))
    return out.view(np.int64)


def slices(texts: list[str | None]) -> Iterator[slice]:
    """Texts that are worked on at once."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held > _AT_ONCE:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _letters(line: str) -> str:
    return "".join(chain.from_iterable(map(_words_of, line.lower().split())))


def is_title(line: str, title: str) -> bool:
    """Whether the letters of a line that isn't blank are these, of the page's title."""
    first = line[:1]
    if first.isalpha() and first.lower()[:1] != title[:1]:  # most lines
        return False
    # equal letters have equal lengths but for what is no letter
    return title != "" and len(line) >= len(title) and title.startswith("".join(_words_of(line.split(None, 1)[0].lower()))) and _letters(line) == title


def _shape(line: str) -> str:
    """A line with each run of plain words as one sign, so that marks and tags remain."""
    return _BLANKS.sub(" ", _PLAIN.sub("x", " ".join(map(_signs_of, line.strip().split(" ")))))


def ends_sentence(line: str) -> bool:
    last = line.rstrip().rstrip(_CLOSING)[-1:]
    return last != "" and last in ".!?…"


def _is_paragraph(line: str, words: list[str] | tuple[str, ...]) -> bool:
    return len(words) >= _WORDS_OF_PARAGRAPH and ends_sentence(line) and _BULLET.match(line) is None


def _tags(line: str, n: int) -> list[tuple[str, object, str]]:
    """The tags of a line of ``n`` words, each once."""
    s = line.strip().replace("\xa0", " ")
    last = s.rstrip(_CLOSING)[-1:]
    out = [("words", bisect_left(_SIZES, n), ""), ("end", last if not last.isalnum() else "0" if last.isdigit() else "a", "")]
    if (s[:1] in "-*•–" or s[:1].isdecimal()) and (m := _BULLET.match(s)):
        out.append(("bullet", "0" if m.group(2) else m.group(1), ""))
        s = s[m.end() :]
    out += [("tag", t, "") for t in set(_TAG.findall(s))]
    if "  " in s or not s.isprintable() and _TWO_BLANKS.search(s):
        out.append(("tag", " ", ""))
    if s.isupper():
        out.append(("capitals", "", ""))
    return out


def features(line: str, words: list[str]) -> set:
    """The tokens of a line with these words: words, and tags as triples."""
    return {*words, *_tags(line, len(words))}


class Weights:
    """Weights of tokens, and which repeated lines open a list of links."""

    def __init__(self, weights: dict, bias: float, known: frozenset[str], openers: frozenset[tuple[str, ...]]):
        self.weights, self.bias, self.known, self.openers = weights, bias, known, openers
        self.sizes = frozenset(map(len, openers))
        openers_ = [(i, w) for i, k in enumerate(openers) for w in k]
        words = list({w: None for _, w in openers_})
        at = {w: i for i, w in enumerate(words)}
        line, word = (np.array(x, np.int64) for x in ([i for i, _ in openers_], [at[w] for _, w in openers_]))
        #: hashes of those skeletons with more than names and numbers
        self.openers_hashed = frozenset(skeletons(line, word, words, frozenset(words) - {_NAME}, len(openers)).tolist()) - {0}
        self._seen: dict[str, tuple[float, bool]] = {}
        self._words = Told(known, weights)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_seen", "_words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"_seen": {}, "_words": Told(state["known"], state["weights"])}

    def skeleton(self, words: list[str]) -> tuple[str, ...]:
        """The words of a line, names alike."""
        return tuple([w if w in self.known else _NAME for w in words])

    def line(self, line: str) -> tuple[float, bool]:
        """Summed weight of a line's tokens, and whether it opens a list of links."""
        known = self._seen.get(line)
        if known is None:
            words = _words(line)
            score = self.bias + sum(filter(None, map(self.weights.get, features(line, words))))
            known = max(_FLOOR, min(_CLIP, score)), len(words) in self.sizes and self.skeleton(words) in self.openers
            if len(line) <= _CACHED:  # short lines come again
                if len(self._seen) > _HELD:
                    self._seen.clear()
                self._seen[line] = known
        return known

    def look(self, texts: list[str]) -> None:
        """The same of all lines of some texts, at once: ``line`` finds them made."""
        if len(self._seen) > _HELD:
            self._seen.clear()
        new = [x for x in dict.fromkeys(chain.from_iterable(t.split("\n") for t in texts)) if x not in self._seen and x.strip()]
        at, word = self._words.taken(new)
        counts, opens = np.bincount(at, minlength=len(new)), self._words.skeletons(at, word, len(new))
        at, word = distinct(at, word, len(self._words.scores))
        get = self.weights.get
        scores = np.bincount(at, self._words.scores[word], len(new)) if len(at) else np.zeros(len(new))
        for x, n, k, score in zip(new, counts.tolist(), opens.tolist(), scores.tolist(), strict=True):
            score += self.bias + sum([get(t, 0.0) for t in _tags(x, n)])
            self._seen[x] = max(_FLOOR, min(_CLIP, score)), k in self.openers_hashed


def _host(url: str | None) -> str:
    m = re.match(r"\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#\s]+)", (url or "").lower())
    return m.group(1) if m else ""


class _Labels:
    """Labels that the lines of sampled pages ``(url, title, text)`` give each other."""

    def __init__(self, pages: list[tuple[str | None, str | None, str]]):
        sites: dict[str, set[str]] = defaultdict(set)
        self.words: dict[str, list[str]] = {}
        split = []
        for url, _, text in pages:
            host = _host(url)
            lines = [x for x in text.split("\n") if x.strip()]
            split.append(lines)
            for x in lines:
                if x not in self.words:
                    self.words[x] = [intern(w) for w in _words(x)]  # each word is held once
            for w in set().union(*(self.words[x] for x in lines)):
                if len(sites[w]) < NAME_SITES:
                    sites[w].add(host)
        self.known = frozenset(w for w, hosts in sites.items() if len(hosts) >= NAME_SITES)
        blank = Weights({}, 0.0, self.known, frozenset())
        self.pages = []
        stands: dict[tuple, set] = defaultdict(set)
        skeleton_of = {x: blank.skeleton(w) for x, w in self.words.items()}
        for (url, title, _), lines in zip(pages, split, strict=True):
            skeletons = [skeleton_of[x] for x in lines]
            own = _letters(title) if title else ""
            self.pages.append((lines, skeletons, [is_title(x, own) for x in lines]))
            for k in set(skeletons):
                stands[k].add(url)
        repeated = {k for k, urls in stands.items() if len(urls) >= REPEATED and any(w not in (_NAME, "0") for w in k)}
        self.count: Counter = Counter()
        self.kind = self._kinds(repeated)
        self.openers = frozenset(k for k, v in self.kind.items() if v == "L")
        for _, skeletons, is_own in self.pages:  # what stands before a byline is a title too
            for i in range(len(skeletons) - 1):
                is_own[i] = is_own[i] or skeletons[i] not in self.kind and self.kind.get(skeletons[i + 1]) == "B"
        self.outside = self._outside()

    def _kinds(self, repeated: set[tuple]) -> dict[tuple, str]:
        """Of each repeated line: body ``B``, furniture ``F``, or furniture that opens a list ``L``."""
        follows: Counter = Counter()
        before: dict[tuple, Counter] = defaultdict(Counter)
        for lines, skeletons, is_own in self.pages:
            for i, k in enumerate(skeletons):
                if k not in repeated:
                    continue
                self.count[k] += 1
                follows[k] += i > 0 and is_own[i - 1]
                if i + 1 < len(lines):
                    after = "own" if is_own[i + 1] else "repeated" if skeletons[i + 1] in repeated else "text" if ends_sentence(lines[i + 1]) and not _BULLET.match(lines[i + 1]) else "single"
                    before[k][after] += 1
        kind = {}
        for k in repeated:
            if follows[k] >= _BYLINE * self.count[k]:
                kind[k] = "B"
            else:
                kind[k] = "L" if before[k]["single"] >= _OPENER * max(1, before[k].total()) else "F"
        return kind

    def _outside(self) -> set[str]:
        """Shapes of lines that hardly ever stand between paragraphs, nor as a page's own title."""
        between: Counter = Counter()
        beyond: Counter = Counter()
        for lines, skeletons, is_own in self.pages:
            at = [i for i, x in enumerate(lines) if skeletons[i] not in self.kind and _is_paragraph(x, self.words[x])]
            for i, x in enumerate(lines if at else ()):
                if is_own[i]:
                    between[_shape(x)] += 1
                elif skeletons[i] not in self.kind:
                    (between if at[0] <= i <= at[-1] else beyond)[_shape(x)] += 1
        return {k for k, n in beyond.items() if n >= REPEATED and between[k] <= _OUTSIDE * n}

    def labelled(self) -> dict[str, tuple[bool, int]]:
        """Distinct lines, whether they are of the body, and how often their like stands."""
        out: dict[str, tuple[bool, int]] = {}
        for lines, skeletons, is_own in self.pages:
            at = [i for i, x in enumerate(lines) if skeletons[i] not in self.kind and _is_paragraph(x, self.words[x])]
            links = False
            for i, (x, k) in enumerate(zip(lines, skeletons, strict=True)):
                if is_own[i] and not links:
                    body: bool | None = True
                elif k in self.kind:
                    body, links = self.kind[k] == "B", self.kind[k] == "L"
                elif _shape(x) in self.outside:
                    body = False
                elif _is_paragraph(x, self.words[x]):
                    body, links = True, False
                else:
                    body = True if at and at[0] < i < at[-1] and not links else None
                if body is not None:
                    out.setdefault(x, (body, self.count.get(k, 1)))
        return out


def _by_column(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(col, kind="stable")
    return col[order], row[order]


def _sums(group: np.ndarray, item: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sums over the items of each of ``n`` groups, of values by item; ``group`` ascends."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    some, values = group[first], np.empty(len(item))

    def sums(of: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(item):
            out[some] = np.add.reduceat(np.take(of, item, out=values, mode="clip"), first)
        return out

    return sums


def _regression(lines: list[str], is_body: np.ndarray, stands: np.ndarray) -> tuple[dict, float]:
    """Weights and bias of a logistic regression over the features of lines that stand so often; both classes count alike."""
    at, word, words = worded(lines)
    counts = np.bincount(at, minlength=len(lines)).tolist()
    tags: defaultdict = defaultdict(lambda: len(words) + len(tags))
    of_tags = [[tags[t] for t in _tags(x, n)] for x, n in zip(lines, counts, strict=True)]
    row, col = distinct(at, word, len(words))
    row = np.concatenate([row, np.repeat(np.arange(len(lines)), list(map(len, of_tags)))])
    col = np.concatenate([col, np.fromiter(chain.from_iterable(of_tags), np.int64)])
    names = [*words, *tags]
    often = np.bincount(col, np.maximum(stands, 1)[row], len(names)).tolist()
    ids = {f: i for i, f in enumerate(sorted((f for f, n in zip(names, often, strict=True) if n >= _LEAST), key=repr))}
    col = np.array([ids.get(f, -1) for f in names], np.int64)[col]
    order = np.argsort(row[col >= 0], kind="stable")
    row, col = row[col >= 0][order], col[col >= 0][order]
    sum_rows, sum_columns = _sums(row, col, len(lines)), _sums(*_by_column(row, col), len(ids))
    y, weight = is_body.astype(float), np.sqrt(np.minimum(stands, 50.0))
    weight = weight * np.where(is_body, 0.5 / weight[is_body].sum(), 0.5 / weight[~is_body].sum())
    w, bias, moved, moved_bias = np.zeros(len(ids)), 0.0, np.full(len(ids), 1e-8), 1e-8
    for _ in range(_STEPS):
        error = (1 / (1 + np.exp(-np.clip(sum_rows(w) + bias, -30, 30))) - y) * weight
        slope, slope_bias = sum_columns(error) + _SHRINK * w, float(error.sum())
        moved += slope * slope
        moved_bias += slope_bias * slope_bias
        w -= _RATE * slope / np.sqrt(moved)
        bias -= _RATE * slope_bias / moved_bias**0.5
    return {f: float(w[i]) for f, i in ids.items()}, bias + _LEAN


def fitted(pages: list[tuple[str | None, str | None, str]], clean: list[str]) -> Weights:
    """Weights from sampled pages ``(url, title, text)`` and clean sentences."""
    labels = _Labels(pages)
    lines = {x: (True, 1) for x in clean} | labels.labelled()
    is_body = np.array([b for b, _ in lines.values()], bool)
    if not is_body.any() or is_body.all():
        return Weights({}, 1.0, labels.known, labels.openers)
    weights, bias = _regression(list(lines), is_body, np.array([n for _, n in lines.values()]))
    return Weights(weights, bias, labels.known, labels.openers)


def sample_of(pages: DataFrame, url: str, title: str, text: str, max_pages: int = MAX_PAGES) -> list[tuple[str | None, str | None, str]]:
    """``max_pages`` pages of a table, the least by a hash, for trials; very long ones left out. No query goes by it."""
    rows = pages.select(F.col(url).alias("u"), F.col(title).alias("t"), F.col(text).alias("x")).where(F.col("x").isNotNull() & (F.length("x") <= MAX_PAGE_CHARS))
    return [tuple(r) for r in least(rows, max_pages)]


def clean_lines(samples: DataFrame, text: str = "text", max_samples: int = MAX_SAMPLES) -> list[str]:
    """At most ``max_samples`` clean sentences of a table, the least by their hash."""
    return [r[0] for r in least(samples.select(text).where(f"{text} is not null"), max_samples)]


def best_region(scores: list[float]) -> tuple[int, int]:
    """``[from, to)`` of the contiguous run of greatest sum, empty if nothing is positive. The first of equals, and the shortest."""
    best, best_from, best_to, sum_, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += s
        if sum_ > best:
            best, best_from, best_to = sum_, start, i + 1
    return best_from, best_to


def body_lines(text: str, weights: Weights) -> list[bool | None]:
    """For each line whether it is of the body; None for blank lines."""
    lines = text.split("\n")
    scores, links = [], False
    for line in lines:
        if not line.strip():
            scores.append(0.0)
            continue
        score, opens = weights.line(line)
        if opens:
            links, score = True, min(score, -1.0)
        elif links and score >= 0:
            if _BULLET.match(line) or not ends_sentence(line):
                score = -max(score, 1.0)
            else:
                links = False
        elif links:
            links = "›" in line[:3]
        scores.append(max(score, _FLOOR))
    a, b = best_region(scores)
    return [None if not line.strip() else a <= i < b and scores[i] >= 0 for i, line in enumerate(lines)]


def body_spans(text: str, weights: Weights) -> list[tuple[int, int]]:
    """``(start, end)`` of each line of the body."""
    out, at = [], 0
    for line, keep in zip(text.split("\n"), body_lines(text, weights), strict=True):
        if keep:
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


class Bodies:
    """``body_spans`` under some weights; ``look`` gets many texts ready at once."""

    def __init__(self, weights: Weights):
        self.weights, self.look = weights, weights.look

    def __call__(self, text: str) -> list[tuple[int, int]]:
        return body_spans(text, self.weights)


def furniture(df: DataFrame, row_id: Column, text: Column, weights: Weights) -> DataFrame:
    """``row_id, line_no`` of each line outside the main body, numbered from 1."""
    shared = df.sparkSession.sparkContext.broadcast(weights)  # of bounded samples: a megabyte or so

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            ids, at = [], []
            b = b.filter(pc.greater(pc.binary_length(b.column(1)), 0))
            of, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for some in slices(texts):
                w.look(texts[some])
                for i, t in zip(of[some], texts[some], strict=True):
                    out = [n for n, body in enumerate(body_lines(t, w), 1) if body is False]
                    ids += [i] * len(out)
                    at += out
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64())], names=["row_id", "line_no"])

    return spread(df.select(row_id.cast("long").alias("row_id"), text.alias("text"))).mapInArrow(found, "row_id long, line_no long")


def main_body(df: DataFrame, row_id: Column, text: Column, weights: Weights) -> DataFrame:
    """``row_id, body``: only the lines of the main body; null for a null text."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            out, texts = [], b.column(1).to_pylist()
            for some in slices(texts):
                w.look([t for t in texts[some] if t])
                out += [t and "\n".join(x for x, keep in zip(t.split("\n"), body_lines(t, w), strict=True) if keep) for t in texts[some]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["row_id", "body"])

    return spread(df.select(row_id.cast("long").alias("row_id"), text.alias("text"))).mapInArrow(cut, "row_id long, body string")
