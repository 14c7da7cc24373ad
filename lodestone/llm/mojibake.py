"""Text that was decoded with the wrong character encoding: find it, and restore it where possible.

A noisy channel. Each channel is a way to damage text: bytes of one encoding read as another, once or twice, also
spelled as entities, or bytes lost altogether. For each token with characters beyond ASCII a lattice holds its
readings: the token as it stands, what its bytes spell under each channel, and, where bytes were lost, the words of the
corpus that fit with a wildcard in their place. A Viterbi search over a text's tokens picks the readings of greatest
probability, with word and character frequencies of the corpus as the source model and a cost for entering a channel.
A text with a token outside the clean state is affected, and the path spells its restoration.

The frequencies count every word with a character beyond ASCII in all texts; each task counts for itself, and the
``MAX_WORDS`` most frequent are held by every task. Rarer words stay in a written table: those that the readings of a
text's tokens depend on are joined to its row, by distinct tokens, so that no word is cut.

A sequence of symbols alone between clean quotation marks is an example someone quotes, not damage. U+FFFD is damage
even where nothing fits its place; it then stays. Null, empty and ASCII texts are never affected.
"""

from __future__ import annotations

import html
import pickle
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialise, spread

MAX_WORDS = 50_000
#: Encodings as which bytes of UTF-8 are read, and pairs (true encoding, read as) of one byte a character.
_READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "iso8859_15", "cp1254")
_SWAPPED = (
    ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("iso8859_5", "cp1252"), ("iso8859_5", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"),
    ("iso8859_2", "cp1252"), ("cp1250", "cp1252"), ("cp1250", "iso8859_2"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "koi8_r"), ("cp1251", "mac_roman"), ("cp1251", "cp437"),
)
_ENTER, _ENTER_SWAPPED, _LEAVE, _UNKNOWN, _MIXED, _DECODED, _UNSEEN = -6.0, -14.0, -1.0, -13.0, -6.0, 4.0, -12.0
_WORD = re.compile(r"[^\W\d_]+")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{2,6});")
_QUOTED = re.compile(r"[“”„«»\"'‘’‹›(\[`]+([^A-Za-z0-9\s]{1,12})[“”«»\"'‘’‹›)\]`]+[.,;:!?)]*$")
_LOST = "�"
#: texts whose tokens are counted at once
_ROWS = 1_000
#: a question mark inside a word stands for a lost character too, but not in addresses
_MARK = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])")
_WITH_LOST = re.compile(rf"[^\W\d_{_LOST}]*(?:{_LOST}[^\W\d_{_LOST}]*)+|[^\W\d_]+")
_ADJACENT = re.compile(r"[^\x00-\x7f][^\x00-\x7f]")
_SPLIT = re.compile(r"([ \n\t]+)")
#: tokens with a character that a damaged one has
_CANDIDATE = re.compile(r"(?<![^ \n\t])[\x00-\x08\x0b-\x1f!-%'->@-\x7f]*+[^ \n\t]++")
_OTHER_BLANKS = re.compile(r"[\x0b\x0c\r]")
#: restorers that a worker holds
_RESTORERS = 2


def _bytes_of(encoding: str) -> dict[str, int]:
    """Characters of the upper half of an encoding; undefined bytes pass as control characters."""
    table = {}
    for b in range(0x80, 0x100):
        if encoding in ("cp1252", "cp1250", "cp1251", "cp1254", "iso8859_15") and b < 0xA0:
            table[chr(b)] = b
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


class _Utf8As:
    strict = True

    def __init__(self, encoding: str):
        self.name, self.table = f"utf-8 as {encoding}", _bytes_of(encoding)
        self.runs = re.compile("[" + re.escape("".join(self.table)) + "]+")
        self.back = {}
        for c, b in self.table.items():
            self.back.setdefault(b, c)
        #: characters that come back as others where they stand alone
        self.changed = frozenset(c for c, b in self.table.items() if self.back[b] != c)

    def read(self, token: str) -> str:
        def run(m: re.Match) -> str:
            out = bytes(map(self.table.__getitem__, m.group())).decode("utf-8", "surrogateescape")
            return "".join(c if c < "\ud800" or c > "\udfff" else self.back.get(ord(c) - 0xDC00, c) for c in out)

        return self.runs.sub(run, token)


class _Swapped:
    strict = False

    def __init__(self, true: str, read_as: str):
        self.name, self.table = f"{true} as {read_as}", {}
        for c, b in _bytes_of(read_as).items():
            try:
                self.table[ord(c)] = bytes([b]).decode(true)
            except UnicodeDecodeError:
                pass

    def read(self, token: str) -> str:
        return token.translate(self.table)


class _Twice:
    strict = True

    def __init__(self, a: _Utf8As, b: _Utf8As):
        self.name, self.a, self.b = f"{a.name}, {b.name}", a, b
        self.changed = a.changed | b.changed

    def read(self, token: str) -> str:
        return self.b.read(self.a.read(token))


class _Spelled:
    """Entities in place of the characters, under another channel."""

    strict = True

    def __init__(self, inner):
        self.name, self.inner, self.changed = f"entities, {inner.name}", inner, inner.changed

    def read(self, token: str) -> str:
        return self.inner.read(html.unescape(token)) if "&" in token else token


def _channels() -> list:
    once = [_Utf8As(e) for e in _READ_AS]
    twice = [_Twice(a, a) for a in once[:3]] + [_Twice(once[0], once[1]), _Twice(once[1], once[0])]
    return [*once, *twice, *(_Swapped(*p) for p in _SWAPPED), _Spelled(once[0]), _Spelled(twice[0])]


def _script(c: str) -> int:
    return 1 if c < "ɐ" else 2 if "Ѐ" <= c < "԰" else 3


def _odd_mark(token: str) -> bool:
    return "?" in token and "/" not in token and "=" not in token and _MARK.search(token) is not None


def _marked(token: str) -> list[str]:
    """A token with wildcards for question marks inside of words, and for all of them."""
    return [_MARK.sub(_LOST, token), token.replace("?", _LOST)]


def _special(token: str) -> bool:
    """Whether a token can be damaged at all."""
    return not token.isascii() or "&" in token and _ENTITY.search(token) is not None or _odd_mark(token)


class Counts(NamedTuple):
    """Words held by every task, characters; occurrences of all words, and ``word, n, pattern`` of those that aren't held, if any."""

    words: dict[str, int]
    chars: dict[str, int]
    total: int
    rare: DataFrame | None = None


def _pattern(word: str) -> str:
    return re.sub(r"[^\x00-\x7f]", _LOST, word)


class Restorer:
    """Restores texts under word and character frequencies."""

    def __init__(self, words: dict[str, int], chars: dict[str, int], total: int | None = None):
        self.n, m = (sum(words.values()) if total is None else total) + 1, sum(chars.values()) + 1
        self.words = {w: self._log(k) for w, k in words.items()}
        #: no word beyond those held is more frequent
        self.least = min(self.words.values(), default=0.0)
        self.rare: dict[str, float] = {}
        self.rare_lost: dict[str, str] = {}
        self.chars = {c: max(log(k / m), -12.0) for c, k in chars.items()}
        self.channels = _channels()
        self.changed = frozenset().union(*(c.changed for c in self.channels if c.strict))
        self.lost: dict[str, list[str]] = {}
        for w in sorted(words, key=lambda w: -words[w]):
            self.lost.setdefault(_pattern(w), []).append(w)
        self.mark = next(iter(sorted((c for c in chars if not c.isalnum()), key=lambda c: -chars[c])), None)
        self.seen: dict[str, list[tuple[int, float, str]]] = {}
        self.clean: set[str] = set()

    def _log(self, n: int) -> float:
        return max(log(n / self.n), _UNKNOWN + 1)

    def learn(self, found: Iterable[dict]) -> None:
        """Words beyond those held that the next texts' tokens ask for: all of them that the corpus has."""
        if len(self.rare) + len(self.rare_lost) > 200_000:
            self.rare.clear()
            self.rare_lost.clear()
        for x in found:
            if x["fill"]:
                self.rare_lost[_pattern(x["word"])] = x["word"]
            else:
                self.rare[x["word"]] = self._log(x["n"])

    def asks(self, token: str) -> tuple[set[str], set[str]]:
        """Words, and patterns of words with lost characters, beyond those held on which the readings of a token depend."""
        odd = _odd_mark(token)
        patterns = {w.lower() for m in (_marked(token) if odd else [token]) for w in _WITH_LOST.findall(m) if _LOST in w} - self.lost.keys()
        if odd or self._is_quoted(token):
            return set(), patterns
        clean, spellings, alone = self._score(token), [], self._stand_alone(token)
        for channel in self.channels:
            if alone and channel.strict:
                continue
            spelled = channel.read(token)
            if spelled != token and "\x00" not in spelled and self._score(spelled, self.least) + self._bonus(channel, token, spelled) > clean + 1.0:
                spellings.append(spelled)
        words = {w.lower() for x in [token, *spellings] for w in _WORD.findall(x) if not w.isascii()} if spellings else set()
        return words - self.words.keys(), patterns

    @staticmethod
    def _is_quoted(token: str) -> bool:
        quoted = _QUOTED.match(token)
        return bool(quoted and not any("a" <= c.lower() <= "z" for c in quoted.group(1)))

    def _stand_alone(self, token: str) -> bool:
        """Whether no channel of UTF-8 changes a token: no byte beyond ASCII is a character by itself, and none comes back as another."""
        return _ADJACENT.search(token) is None and "&" not in token and self.changed.isdisjoint(token)

    def _bonus(self, channel, token: str, spelled: str) -> float:  # noqa: ANN001
        """What decodes as UTF-8 hardly does by chance, unless to what no text has."""
        return _DECODED + _UNSEEN * sum(c > "\x7f" and c not in self.chars and c not in token for c in spelled) if channel.strict else 0.0

    def _score(self, token: str, at_most: float | None = None) -> float:
        """``at_most``: what a word beyond those held counts, for a bound from above."""
        total = 0.0
        for w in _WORD.findall(token):
            if w.isascii():
                total += _UNKNOWN if w.lower() not in self.words else self.words[w.lower()]
            else:
                p = self.words.get(w.lower())
                if p is None:
                    p = self.rare.get(w.lower()) if at_most is None else at_most
                if p is None:
                    p = _UNKNOWN + sum([self.chars.get(c.lower(), -14.0) for c in w if c > "\x7f"])
                    p += _MIXED * (len({_script(c) for c in w}) - 1)
                    p += _MIXED * sum(a.islower() and b.isupper() for a, b in zip(w, w[1:], strict=False))
                total += p
        for c in token:
            if c > "\x7f" and not c.isalpha():
                total += self.chars.get(c, -14.0) if c.isprintable() or c == "\xa0" else -16.0
        return total

    def readings(self, token: str) -> list[tuple[int, float, str]]:
        """``(channel, log probability, spelling)``; -1 is the clean state, -2 lost bytes."""
        known = self.seen.get(token)
        if known is not None:
            return known
        clean = self._score(token)
        out = [(-1, clean, token)]
        if _odd_mark(token):
            # a mark at the end of the word may be a lost letter too, if that makes a word of the corpus
            filled = next((f for m in _marked(token) if (f := self._fill(m)) != m and _LOST not in f), token)
            self.seen[token] = out = [(-2, clean, filled)]
            return out
        if not self._is_quoted(token):
            if _LOST in token:
                out = [(-2, clean - 4.0, self._fill(token))]
            alone = self._stand_alone(token)
            of_token = {w.lower() for w in _WORD.findall(token)}
            for i, channel in enumerate(self.channels):
                if alone and channel.strict:
                    continue
                spelled = channel.read(token)
                if spelled != token and "\x00" not in spelled:
                    longest = 0
                    if not channel.strict:  # letters swapped for letters prove something only by the words they make
                        for w in _WORD.findall(spelled):
                            if not w.isascii() and len(w := w.lower()) > longest and (w in self.words or w in self.rare) and w not in of_token:
                                longest = len(w)
                        if longest < 2:
                            continue
                    p = self._score(spelled)
                    p += self._bonus(channel, token, spelled)
                    if not channel.strict and longest < 4:
                        p = min(p, clean + 1.5)
                    if p > clean + 1.0:
                        out.append((i, p, spelled))
        if len(self.seen) > 60_000:
            self.seen.clear()
        self.seen[token] = out
        return out

    def _fill(self, token: str) -> str:
        """Words of the corpus in the place of words with lost characters."""

        def fill(m: re.Match) -> str:
            w = m.group()
            if _LOST not in w:
                return w
            fits = self.lost.get(w.lower())
            best = fits[0] if fits else self.rare_lost.get(w.lower()) or (self.mark if w == _LOST else None)
            if not best:
                return w
            return best.upper() if w.isupper() and len(w) > 1 else best[:1].upper() + best[1:] if w[:1].isupper() else best

        return _WITH_LOST.sub(fill, token)

    def suspicious(self, text: str) -> bool:
        """Whether any token has a reading besides the clean one that is not far worse."""
        if text.isascii() and "&" not in text and ("?" not in text or not _MARK.search(text)):
            return False
        if len(self.clean) > 100_000:
            self.clean.clear()
        # most tokens of most texts are known to have no other reading
        return any(map(self._told, set(text.replace("\n", " ").replace("\t", " ").split(" ")).difference(self.clean)))

    def _told(self, token: str) -> bool:
        """Whether a token has a reading besides the clean one."""
        if token not in self.clean:
            if _special(token):
                r = self.readings(token)
                if len(r) > 1 or r[0][0] == -2:
                    return True
            self.clean.add(token)
        return False

    def _suspicious(self, texts: list[str]) -> list[bool]:
        """``suspicious`` of many texts: each distinct token is looked at once."""
        if len(self.clean) > 100_000:
            self.clean.clear()
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        tokens = parts.flatten()
        at = pc.or_(pc.invert(pc.string_is_ascii(tokens)), pc.or_(pc.match_substring(tokens, "&"), pc.match_substring(tokens, "?"))).to_numpy(zero_copy_only=False)
        some = tokens.filter(pa.array(at)).dictionary_encode()
        told = np.array(list(map(self._told, some.dictionary.to_pylist())), bool)[some.indices.to_numpy()]
        out = np.zeros(len(texts), bool)
        out[np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy())[np.flatnonzero(at)[told]]] = True
        return [self.suspicious(t) if _OTHER_BLANKS.search(t) else x for t, x in zip(texts, out.tolist(), strict=True)]

    def restore(self, text: str, rare: list[dict] | None = None) -> tuple[str, int]:
        """The restored text and the number of tokens that were damaged; the text itself and 0 if clean."""
        found = self.damage(text, rare)
        return (replaced(text, found), len(found)) if found else (text, 0)

    def damage(self, text: str, rare: list[dict] | None = None) -> list[tuple[int, int, str]]:
        """``(start, end, restored spelling)`` of each damaged token, in order; the spelling it has where nothing fits.

        ``rare``: the words that ``with_rare`` found for the text.
        """
        if rare:
            self.learn(rare)
        return self._found(text) if self.suspicious(text) else []

    def damages(self, texts: list[str | None], rare: list[list[dict] | None]) -> list[list[tuple[int, int, str]]]:
        """The same of many texts; nothing for null ones."""
        self.learn(chain.from_iterable(filter(None, rare)))
        suspicious = iter(self._suspicious([t for t in texts if t]))
        return [self._found(t) if t and next(suspicious) else [] for t in texts]

    def _found(self, text: str) -> list[tuple[int, int, str]]:
        """``damage`` of a text that is suspicious."""
        steps: list[tuple[int, int, list[tuple[int, float, str]]]] = []
        single = False
        for m in _CANDIDATE.finditer(text):
            if _special(t := m.group()):
                r = self.readings(t)
                # a clean token changes no choice, but that a state may be left before the next
                if len(r) > 1 or r[0][0] == -2:
                    steps.append((*m.span(), r))
                    single = False
                elif not single:
                    steps.append((*m.span(), [(-1, 0.0, t)]))
                    single = True
        # Viterbi over the tokens that have a choice: states are the clean one and the channels seen in this text
        states = sorted({s for *_, r in steps for s, _, _ in r if s >= 0})
        cost = {s: _ENTER if self.channels[s].strict else _ENTER_SWAPPED for s in states}
        best: dict[int, float] = {-1: 0.0} | cost
        back: list[dict[int, tuple[int, str, bool]]] = []
        for *_, readings in steps:
            here = {s: (p, spelled) for s, p, spelled in readings}
            base = here.get(-1) or here[-2]
            damaged_always = -2 in here
            top, top_state = max((best[s], s) for s in best)
            now, step = {}, {}
            for s in (-1, *states):
                if s == -1:
                    came, frm = max((best[-1], -1), (top + _LEAVE, top_state))
                    p, spelled, hurt = *base, damaged_always
                else:
                    came, frm = max((best[s], s), (best[-1] + cost[s], -1), (top + cost[s] + _LEAVE, top_state))
                    p, spelled = here.get(s, base)
                    hurt = s in here or damaged_always
                now[s], step[s] = came + p, (frm, spelled, hurt)
            best = now
            back.append(step)
        state = max(best, key=lambda s: best[s])
        found = []
        for (start, end, _), step in zip(reversed(steps), reversed(back), strict=True):
            frm, spelled, hurt = step[state]
            if hurt:
                found.append((start, end, spelled))
            state = frm
        return found[::-1]


_RESTORER_OF: dict[str, Restorer] = {}


def restorers(spark: SparkSession, counts: tuple) -> Callable[[], Restorer]:
    """A maker, for tasks to call, of the restorer under some counts; all tasks of a worker share it, so that a token is read once."""
    held = tuple(counts[:3])
    shared, key = spark.sparkContext.broadcast(held), blake2b(pickle.dumps(held), digest_size=16).hexdigest()

    def restorer() -> Restorer:
        if key not in _RESTORER_OF:
            if len(_RESTORER_OF) >= _RESTORERS:
                _RESTORER_OF.pop(next(iter(_RESTORER_OF)))
            _RESTORER_OF[key] = Restorer(*shared.value)
        return _RESTORER_OF[key]

    return restorer


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    """A text with the restored spelling of its damaged tokens."""
    parts, at = [], 0
    for a, z, spelled in found:
        parts += text[at:a], spelled
        at = z
    return "".join(parts) + text[at:]


def moves(found: list[tuple[int, int, str]]) -> list[int]:
    """For each damaged token its start and end in the restored text, then those in the text as it stood; all in one list."""
    out, shift = [], 0
    for a, z, spelled in found:
        out += a + shift, a + shift + len(spelled), a, z
        shift += len(spelled) - (z - a)
    return out


def as_stored(moved: list[int], at: int, end: bool = False) -> int:
    """Where a place of the restored text is in the text as it stood; within a token its start, or its end."""
    i = bisect_right(moved[::4], at - end) - 1
    if i < 0:
        return at
    start, stop, a, z = moved[4 * i : 4 * i + 4]
    return at - stop + z if at - end >= stop else z if end else a


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    tokens: Counter = Counter()
    chars: Counter = Counter()
    for b in batches:
        for start in range(0, b.num_rows, _ROWS):
            # no word spans a blank, so tokens may be cut at any
            split = pc.ascii_split_whitespace(b.column(0).slice(start, _ROWS)).flatten()
            found = pc.value_counts(split.filter(pc.invert(pc.string_is_ascii(split))))
            tokens.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
            if len(tokens) > 200_000:
                _spread(tokens, words, chars)
    _spread(tokens, words, chars)
    rows = [(w, n, True) for w, n in words.items()] + [(c, n, False) for c, n in chars.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], names=["item", "n", "is_word"])


def _spread(tokens: Counter, words: Counter, chars: Counter) -> None:
    for token, n in tokens.items():
        for w in _WORD.findall(token):
            if not w.isascii():
                words[w.lower()] += n
        for c in token:
            if c > "\x7f":
                chars[c] += n
    tokens.clear()


def counts_of(texts: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """The same counts of a few texts in memory."""
    words: Counter = Counter()
    chars: Counter = Counter()
    _spread(Counter(t for text in texts for t in text.split() if not t.isascii()), words, chars)
    return {w: n for w, n in words.items() if _LOST not in w}, {c: n for c, n in chars.items() if c != _LOST}


def frequencies(texts: DataFrame, max_words: int = MAX_WORDS) -> Counts:
    """Counts of words with characters beyond ASCII, and of these characters, over all rows of a one-column table.

    Of the words, the ``max_words`` most frequent are held in memory, the others stay in the written table. Characters
    are bounded by Unicode.
    """
    counted = texts.mapInArrow(_counts, "item string, n long, is_word boolean").groupBy("item", "is_word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.where("item <> '�'"), "word-counts")
    words = counted.where("is_word")
    top = words.orderBy(F.desc("n"), "item").limit(max_words + 1).collect()
    chars = {r.item: r.n for r in counted.where("not is_word").orderBy(F.desc("n"), "item").collect()}
    held = {r.item: r.n for r in top[:max_words]}
    if len(top) <= max_words:
        return Counts(held, chars, sum(held.values()))
    first = top[max_words]
    rest = words.where((F.col("n") < first.n) | (F.col("n") == first.n) & (F.col("item") >= first.item))
    rare = rest.select(F.col("item").alias("word"), "n", F.regexp_replace("item", r"[^\x00-\x7f]", _LOST).alias("pattern"))
    return Counts(held, chars, words.agg(F.sum("n")).first()[0], rare)


_RARE = "array<struct<word:string,n:bigint,fill:boolean>>"


def with_rare(df: DataFrame, text: str, counts: tuple) -> DataFrame:
    """A column ``__rare`` more: the words beyond those held on which the readings of the tokens of ``text`` depend.

    Texts meet words by their distinct tokens. Null throughout if all words are held; then nothing is shuffled.
    """
    rare, held = (counts.rare, counts[:3]) if isinstance(counts, Counts) else (None, None)
    if rare is None:
        return df.withColumn("__rare", F.lit(None).cast(_RARE))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, known = Restorer(*held), {}
        for b in batches:
            prints, tokens = [], []
            for fp, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for token in {x for x in _SPLIT.split(t) if _special(x)}:
                    if token not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[token] = any(r.asks(token))
                    if known[token]:
                        prints.append(fp)
                        tokens.append(token)
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(tokens, pa.string())], names=["fp", "token"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(*held)
        for b in batches:
            out = [(t, w, fill) for t in b.column(0).to_pylist() for fill, items in enumerate(r.asks(t)) for w in items]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32()))], names=["token", "item", "fill"])

    texts = spread(df.select(F.xxhash64(text).alias("fp"), F.col(text).alias("t")).where("t is not null"))
    tokens = materialise(texts.mapInArrow(asking, "fp long, token string"), "rare-tokens")
    items = materialise(tokens.select("token").distinct().mapInArrow(asked, "token string, item string, fill int"), "rare-asked")
    words = items.where("fill = 0").join(rare, F.col("item") == F.col("word")).select("token", "word", "n", F.lit(False).alias("fill"))
    best = rare.groupBy(F.col("pattern").alias("item")).agg(F.min(F.struct((-F.col("n")).alias("less"), "word")).alias("b"))
    fills = items.where("fill = 1").join(best, "item").select("token", F.col("b.word").alias("word"), (-F.col("b.less")).alias("n"), F.lit(True).alias("fill"))
    found = tokens.join(words.unionByName(fills), "token").groupBy("fp").agg(F.collect_set(F.struct("word", "n", "fill")).alias("__rare"))
    return df.withColumn("__fp", F.xxhash64(text)).join(found.withColumnRenamed("fp", "__fp"), "__fp", "left").drop("__fp")


def restored(df: DataFrame, keys: list[Column], text: Column, counts: tuple) -> DataFrame:
    """Key columns (strings and longs by name), ``restored`` and ``damaged`` (tokens) of each affected row."""
    rows = spread(with_rare(df.select(*keys, text.alias("__text")).where("__text is not null"), "__text", counts))
    kept, restorer = rows.schema[:-2], restorers(df.sparkSession, counts)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", restored string, damaged long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = restorer()
        for b in batches:
            at, out, n = [], [], []
            texts = b.column(b.num_columns - 2).to_pylist()
            for i, (t, found) in enumerate(zip(texts, r.damages(texts, b.column(b.num_columns - 1).to_pylist()), strict=True)):
                if found:
                    at.append(i)
                    out.append(replaced(t, found))
                    n.append(len(found))
            chosen = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns[:-2], pa.array(out, pa.string()), pa.array(n, pa.int64())], names=[*chosen.schema.names[:-2], "restored", "damaged"])

    return rows.mapInArrow(run, schema)


def repaired(df: DataFrame, text: str, counts: tuple) -> DataFrame:
    """All rows of a table, with the column ``text`` restored wherever it holds damage."""
    rows = spread(with_rare(df, text, counts))
    at, restorer = rows.columns.index(text), restorers(df.sparkSession, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = restorer()
        for b in batches:
            columns, texts = list(b.columns), b.column(at).to_pylist()
            columns[at] = pa.array([replaced(t, found) if found else t for t, found in zip(texts, r.damages(texts, columns[-1].to_pylist()), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns[:-1], names=b.schema.names[:-1])

    return rows.mapInArrow(run, rows.drop("__rare").schema)
