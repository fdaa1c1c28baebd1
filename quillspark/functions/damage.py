"""Deterministic damage: literal replacements that give any text French typographic defects, alike in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAMAGE = [
    (" de ", " d'un coeur ! "),
    (" la ", " l’Etat... de la "),
    (" le ", " le le "),
    (" les ", " « les » "),
    (" en ", " ex- em "),
    (" of ", " oeuvre; "),
    (" by ", " «by» "),
    (" and ", " A la fois "),
    (" und ", " État — dÃ©jà “un” "),
    (" der ", " cœur … – "),
    (" que ", "\u00a0: que\u202f! "),
    (" is ", ' "is" '),
    (" in ", " M Durand, Elle .,  l'or , "),
    (" die ", " un , mot.... Eglise "),
    (" el ", " manoeuvre: \u00adEtoile "),
    (" on ", " Evenement A quoi? "),
    (" with ", " ab.cd nous nous "),
    (" est ", " À «\u202fest\u00a0» . "),
    (" du ", " « du "),
]


#: damage of markup for the fixer: paragraphs that begin with a hyphen, both kinds of broken encoding, words that the guard refuses
MARKUP = [
    ("<p>A", "<p>- l'A"),
    (" of ", " coeur! "),
    (" with ", " Oeuvre "),
    (" the ", " dÃ©jÃ\u00a0vu... "),
    (" que ", " A la «fin» ? Etat; A demain : "),
    (" y ", " \u2009: oeil ! Evenement "),
]
CAPITAL_A = [(" the ", " A quoi "), (" le ", " A la "), (" und ", " l'A zut "), (" el ", " Aa A b ")]


def damaged(text: Column | str, pairs: list[tuple[str, str]] = DAMAGE) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, t)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def damaged_sql(text: str = "text", pairs: list[tuple[str, str]] = DAMAGE) -> str:
    return reduce(lambda c, p: f"replace({c}, {quoted(p[0])}, {quoted(p[1])})", pairs, text)
