"""Schemas of the engine's tables, and tunables."""

from __future__ import annotations

PAGE = "pageid bigint, title string, revisions array<struct<timestamp:string,slots:struct<main:struct<content:string>>>>"
TOKENS = "key string, chapter string, pos int, token string"
RUNS = "key string, chapter string, idx int, members array<bigint>"

#: Fields read from an infobox.
FIELDS = (
    "name", "aliases", "titles", "books", "world", "abilities", "universe", "family", "parents", "siblings", "relatives", "spouse", "children", "bonded",
    "descendants", "ancestors", "residence", "groups", "nation", "nationality", "profession", "ethnicity", "species", "occupation", "unnamed", "died",
)
#: Other spellings of fields.
SPELLINGS = {
    "residnece": "residence", "residency": "residence", "nantion": "nationality", "nation": "nationality", "group": "groups", "nickname": "aliases",
    "powers": "abilities", "title": "titles", "occupation": "profession", "dead": "died", "death": "died",
}
RELATIVES = ("parents", "siblings", "spouse", "children", "bonded", "descendants", "ancestors", "relatives")
#: The relations of which kinship graphs are made.
KIN = ("parents", "siblings", "spouse", "children", "bonded")

RUN_SIZE, LINES_BEFORE, LINES_AFTER = 25, 4, 3
MIN_WEIGHT, MIN_COMPONENT = 2, 3
