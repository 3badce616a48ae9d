"""Rule tables as ordered CASE expressions, quality flags, and completeness reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions.text import ascii_key, bound, is_set

#: Categories and the words that mean them; the first rule with a word in the text wins.
CATEGORY_RULES = (
    ("Endodontie", ("endodont", "canalaire", "gutta", "lime", "apex", "endo")),
    ("Restauration", ("restauration", "composite", "adhes", "bond", "ciment", "matrice", "coffrage", "fond de cavite")),
    ("Empreinte & Prothèse", ("empreinte", "silicone", "alginate", "retraction", "prothese", "resine", "platre", "laboratoire")),
    ("Chirurgie & Implantologie", ("implant", "chirurg", "suture", "greffe", "osteot", "elevation", "bistouri")),
    ("Anesthésie", ("anesth", "aiguille dentaire", "carpule")),
    ("Prophylaxie", ("prophyl", "polissage", "aeropol", "fluor", "brossette")),
    ("Hygiène & Stérilisation", ("desinfection", "steril", "autoclave", "thermodesinfect", "hygiene", "nettoy", "lingette")),
    ("Instrumentation", ("instrument", "fraise", "contre-angle", "turbine", "insert", "detartreur", "ultrason")),
    ("Radiologie & Numérique", ("radiograph", "rvg", "scanner", "cbct", "camera", "numerique", "cfao", "imprimante 3d")),
    ("Équipement", ("equipement", "fauteuil", "aspiration", "compresseur", "mobilier", "lampe", "moteur")),
    ("Consommables", ("gant", "masque", "champ", "canule", "gobelet", "rouleau", "sachet")),
    ("Blanchiment", ("blanch", "opalescence", "white class")),
)
OTHER = "Autres"
#: Base categories by pattern of the folded text; the first that matches wins, else the default.
BASE_RULES = (
    ("anesthesie", "anesth|aiguille|seringue carpule|carpule"),
    ("empreintes", "empreinte|silicone|alginate|porte empreinte|prothese|platre|laboratoire"),
    ("rotatifs", "rotatif|fraise|poliss|disque abras|contre angle|turbine"),
    ("endodontie", "endodont|endocanalaire|canal|lime|gutta|apex|obturation canalaire"),
    ("hygiene", "hygiene|steril|desinfect|nettoy|autoclave|sachet de steril|thermodesinfect"),
)
BASE_DEFAULT = "usage-unique"


def by_keyword(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Column | None = None) -> Column:
    """The label of the first rule with a word that the text contains."""
    return _first_rule(text, [(label, lambda t, words=words: reduce(or_, [t.contains(word) for word in words])) for label, words in rules], F.lit(None) if default is None else default)


def by_pattern(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    return _first_rule(text, [(label, lambda t, pattern=pattern: t.rlike(pattern)) for label, pattern in rules], F.lit(default))


def _first_rule(text: Column, rules: Sequence[tuple[str, Callable[[Column], Column]]], default: Column) -> Column:
    """The label of the first rule that holds of the text, which is worked out once."""

    def label_of(t: Column) -> Column:
        out = F
        for label, holds in rules:
            out = out.when(holds(t), label)
        return out.otherwise(F.lit(None).cast("string"))

    return F.coalesce(bound(text, label_of), default)


def category(*texts: str, breadcrumb: str | None = None) -> Column:
    """Category of an offer by keywords, else the first part of its breadcrumb, else the rest."""
    first = F.trim(F.split_part(F.coalesce(F.col(breadcrumb), F.lit("")), F.lit(">"), F.lit(1))) if breadcrumb else F.lit("")
    return by_keyword(ascii_key(F.concat_ws(" ", *texts)), CATEGORY_RULES, F.coalesce(F.nullif(first, F.lit("")), F.lit(OTHER)))


def quality_flags(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in order."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in flags.items()]))


def completeness_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of rows, and of rows with each column set."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(is_set(c)).alias(f"with_{c}") for c in columns])


def histogram(df: DataFrame, column: str, seq: str) -> DataFrame:
    """Values with their number, most frequent first, equals by first appearance."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seq")).orderBy(F.desc("n"), "first_seq")
