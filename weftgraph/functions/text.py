"""Column expressions for tokens, names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``(?U)`` makes word boundaries and blanks those of Unicode.
POSSESSIVE = r"(?U)['’‘]s\b"
APOSTROPHE = r"['’‘]"
INFIX = r"[“”?!:;,.…\-–—~/•]"
#: A possessive ending or an apostrophe, and what parts tokens: ``INFIX`` or a blank.
_DROPPED = r"(?U)['’‘](?:s\b)?"
_PARTING = r"(?U)[\s“”?!:;,.…\-–—~/•]+"


def stripped(text: Column) -> Column:
    """Without possessive endings and apostrophes."""
    return F.regexp_replace(F.regexp_replace(text, POSSESSIVE, ""), APOSTROPHE, "")


def tokens(text: Column) -> Column:
    """The tokens of a text; case is kept, empty ones are not."""
    return F.array_remove(F.split(F.regexp_replace(text, _DROPPED, ""), _PARTING), "")


def moniker_forms(moniker: Column) -> Column:
    """The forms under which a moniker is looked up: stripped, and verbatim if it has a possessive ending."""
    return F.array_distinct(F.when(moniker.rlike(POSSESSIVE), F.array(moniker, stripped(moniker))).otherwise(F.array(stripped(moniker))))


def key_normal(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(key), r"[^a-z\-]", ""), "-raw$", "")


def without_parenthesis(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\s\([\w\s]+\)", "")


def split_name(title: Column, titles: list[str]) -> tuple[Column, Column]:
    """(common name, surname) of an unsanitised page title."""
    words = F.filter(F.split(title, r"(?U)\s+"), lambda w: w != "")
    first, last = F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.element_at(words, -1), F.lit(""))
    titled, whole = first.isin(titles), title.contains("'s")
    common = F.when(titled, "").when(whole, title).otherwise(first)
    surname = F.when(titled, last).when(whole, "").otherwise(F.when(F.size(words) > 1, last).otherwise(""))
    return common, surname


def monikers(name: Column, common: Column, surname: Column, aliases: Column, titles: Column) -> Column:
    parts = F.concat(F.array(name, common, surname), F.coalesce(aliases, F.array().cast("array<string>")), F.coalesce(titles, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(parts, lambda m: m.isNotNull() & (m != "")))


def details(name: Column, residence: Column, nation: Column, world: Column, ethnicity: Column, species: Column, subspecies: Column, living: Column) -> Column:
    """"name -- place (kind, deceased)": the place from residence, nation and world, whichever are known."""
    place = F.concat_ws(", ", residence, nation, F.coalesce(world, F.lit("Unknown")))
    kind = F.concat_ws(" ", ethnicity, F.when(species.isNotNull(), F.coalesce(subspecies, species)))
    body = F.concat_ws(", ", F.when(kind != "", kind), F.when(~living, F.lit("deceased")))
    return F.concat(name, F.lit(" -- "), place, F.when(body != "", F.concat(F.lit(" ("), body, F.lit(")"))).otherwise(""))


def href(base: str, ident: Column) -> Column:
    return F.concat(F.lit(base), ident.cast("string"))


def highlighted(words: Column, at: Column, width: Column, before: str = "«", after: str = "»") -> Column:
    """The words of a run as a line, with ``width`` of them from ``at`` (from 0) marked."""
    n = F.size(words)
    mid = F.concat(F.lit(before), F.array_join(F.slice(words, at + 1, width), " "), F.lit(after))
    head = F.when(at > 0, F.array_join(F.slice(words, F.lit(1), at), " "))
    tail = F.when(at + width < n, F.array_join(F.slice(words, at + width + 1, n), " "))
    return F.concat_ws(" ", head, mid, tail)
