"""Formats of a page derived from one another: a catalogue of derivations, planned on the driver, run as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import html


@dataclass(frozen=True)
class Derivation:
    source: str
    target: str
    derive: Callable[[Column], Column]


#: In the order in which they are tried: the readable form of a page before the full one.
CATALOGUE = (
    Derivation("html", "full_text", lambda c: html.flatten(c)),
    Derivation("html", "readable_html", lambda c: html.to_readable(c)),
    Derivation("readable_html", "readable_text", lambda c: html.flatten(c)),
    Derivation("full_text", "readable_text", lambda c: c),
    Derivation("readable_html", "markdown", lambda c: html.to_markdown(c)),
    Derivation("html", "markdown", lambda c: html.to_markdown(c)),
)


def derivable(source: str, target: str, catalogue: tuple[Derivation, ...] = CATALOGUE) -> bool:
    """Whether a format can be made from another, in any number of steps."""
    reached, open_ = {source}, [source]
    while open_:
        here = open_.pop()
        for d in catalogue:
            if d.source == here and d.target not in reached:
                reached.add(d.target)
                open_.append(d.target)
    return target in reached


def check(sources: set[str], targets: set[str], catalogue: tuple[Derivation, ...] = CATALOGUE) -> None:
    """Refuses a catalogue in which a wanted format can't be made, or a derivation never runs."""
    for t in targets:
        if not any(derivable(s, t, catalogue) for s in sources):
            raise ValueError(f"nothing leads to {t}")
    for d in catalogue:
        if not any(derivable(s, d.source, catalogue) for s in sources):
            raise ValueError(f"nothing leads to {d.source}")


def formats(pages: DataFrame, source: str, column: str, targets: list[str], catalogue: tuple[Derivation, ...] = CATALOGUE) -> DataFrame:
    """Pages with a column for each wanted format; each format is made once, the first derivation that isn't null counts.

    A later derivation is given only the pages for which those before it made nothing. Formats that no wanted one needs
    aren't made.
    """
    wanted, open_ = set(), list(targets)
    while open_:
        t = open_.pop()
        if t not in wanted:
            wanted.add(t)
            open_ += [d.source for d in catalogue if d.target == t and derivable(source, d.source, catalogue)]
    known, rows = {source: column}, pages
    changed = True
    while changed:
        changed = False
        for target in dict.fromkeys(d.target for d in catalogue):
            ways = [o for o in catalogue if o.target == target and derivable(source, o.source, catalogue)]
            if target in known or target not in wanted or not ways or any(o.source not in known for o in ways):
                continue
            name = f"__{target}"
            for n, o in enumerate(ways):
                given = F.col(known[o.source])
                rows = rows.withColumn(name, o.derive(given) if n == 0 else F.coalesce(name, o.derive(F.when(F.col(name).isNull(), given))))
            known[target], changed = name, True
    missing = [t for t in targets if t not in known]
    if missing:
        raise ValueError(f"nothing leads to {missing}")
    return rows.select(*[c for c in pages.columns if c not in targets], *[F.col(known[t]).alias(t) for t in targets])


def published(pages: DataFrame, targets: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A row ``keys, kind, body`` for each format that could be made of a page; and per page what couldn't.

    ``underivable`` counts them; ``failed`` says that none could, which is an error of the page.
    """
    kinds = F.array(*[F.struct(F.lit(t).alias("kind"), F.col(t).alias("body")) for t in targets])
    made = pages.select(*keys, F.explode(F.filter(kinds, lambda k: k["body"].isNotNull())).alias("k")).select(*keys, "k.kind", "k.body")
    n = F.size(F.filter(kinds, lambda k: k["body"].isNull()))
    return made, pages.select(*keys, n.alias("underivable"), (n == len(targets)).alias("failed"))
