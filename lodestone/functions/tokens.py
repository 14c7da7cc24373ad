"""Words of a text with their places, without a shuffle: a text is taken apart in the row that holds it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import spread

#: A word is letters and digits; a hyphen before one of these and a point or comma between digits stay inside it.
#: The other alternative is the end of a sentence.
TOKEN = r"(?:-?\p{L}|-?\p{Nd}(?:[.,]\p{Nd})*)+|[.!?]"
# The shortest word, and the number of the first phrase.
SHORTEST, FIRST_PHRASE = 2, 100
#: Texts counted between two batches of words.
_ROWS = 200


def phrases(text: Column) -> Column:
    """The words of each sentence that has any, in small letters, as an array of arrays."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.isin(".", "!", "?"), F.lit("\n")).when(F.length(t) >= SHORTEST, F.lower(t)))
    sentences = F.split(F.array_join(marks, " "), "\n")
    words = F.transform(sentences, lambda s: F.filter(F.split(s, " "), lambda w: w != ""))
    return F.filter(words, lambda w: F.size(w) > 0)


_TOKEN = regex.compile(TOKEN)


def _counted(text: str) -> tuple[dict[str, list[int]], int, int]:
    """Per word ``[hits, text position, phrase, position in it]`` of its first place; words and phrases of the text."""
    found: dict[str, list[int]] = {}
    total, phrase, place = 0, FIRST_PHRASE, 1
    for t in _TOKEN.findall(text.lower()):
        if len(t) >= SHORTEST:
            seen = found.get(t)
            if seen is None:
                found[t] = [1, total, phrase, place]
            else:
                seen[0] += 1
            total += 1
            place += 1
        elif t in ".!?" and place > 1:
            phrase += 1
            place = 1
    return found, total, phrase - FIRST_PHRASE + (place > 1)


@F.pandas_udf(T.StructType([T.StructField("words", T.IntegerType()), T.StructField("phrases", T.IntegerType())]))
def statistics(text: pd.Series) -> pd.DataFrame:
    """``words`` and ``phrases`` of a text; zero for a null."""
    return pd.DataFrame([(0, 0) if t is None else _counted(t)[1:] for t in text], columns=["words", "phrases"])


def positions(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys and ``word, text_position, phrase_position, phrase_relative_position`` of every word occurrence.

    Places in the text count from 0, phrases from 100, places in a phrase from 1. Null and empty texts give no rows.
    """
    rows = df.select(*keys, phrases(F.col(text)).alias("__p")).where(F.size("__p") > 0)
    phrase = F.flatten(F.transform("__p", lambda s, i: F.array_repeat(i + FIRST_PHRASE, F.size(s))))
    place = F.flatten(F.transform("__p", lambda s: F.sequence(F.lit(1), F.size(s))))
    each = rows.select(*keys, F.posexplode(F.arrays_zip(F.flatten("__p").alias("word"), phrase.alias("phrase"), place.alias("place"))).alias("text_position", "z"))
    return each.select(*keys, F.col("z.word").alias("word"), "text_position", F.col("z.phrase").cast("int").alias("phrase_position"), F.col("z.place").cast("int").alias("phrase_relative_position"))


def occurrences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys and per word ``hits``, the places of its first occurrence, and ``text_words`` and ``phrases`` of the text.

    A text is counted where it is read, in one pass over Arrow batches: there is no shuffle, and no row per token.
    """
    rows = spread(df.select(*keys, F.col(text).alias("__text")).where("__text is not null"))
    kept = rows.schema[:-1]
    names = ["hits", "text_position", "phrase_position", "phrase_relative_position", "text_words", "phrases"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["word string"] + [f"{n} int" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                b = batch.slice(start, _ROWS)
                at, words, numbers = [], [], []
                for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    found, total, phrases = _counted(t)
                    at += [i] * len(found)
                    words += found
                    numbers += [(*x, total, phrases) for x in found.values()]
                taken = b.take(pa.array(at, pa.int64()))
                columns = [pa.array(c, pa.int32()) for c in (zip(*numbers, strict=True) if numbers else [[]] * len(names))]
                yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(words, pa.string()), *columns], names=[*[f.name for f in kept], "word", *names])

    return rows.mapInArrow(run, schema)


#: Characters that part the words of a title.
TITLE_SEPARATORS = r"[ /()\-:_.,?!'\"]+"
# Words that say nothing about a title.
COMMON_TITLE_WORDS = (
    "http", "html", "php", "ftp", "www", "com", "org", "net", "gov", "edu", "index", "home", "page", "for", "usage",
    "the", "and", "zum", "der", "die", "das", "und", "zur", "bzw", "mit", "blog", "wiki", "aus", "bei", "off",
)


def title_words(title: Column) -> Column:
    """Words of a title of at least three letters a to z, in small letters."""
    return F.filter(F.split(F.lower(title), TITLE_SEPARATORS), lambda w: w.rlike("^[a-z]{3,}$"))
