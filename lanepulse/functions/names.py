"""Street-name folding, tokens and the pairwise token score."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that name the kind of road rather than the road.
GENERIC_WORDS = """
avenida av avda bulevar bulevard bv boulevard camino cno calle ruta pasaje
continuacion acceso nacional brigadier general gral doctor dr ingeniero ing
arquitecto arq teniente tte coronel cnel capitan presidente profesor prof
maestro don de del la el los las y
""".split()


@cache
def _ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII: one letter, several."""
    single, several = {}, {}
    # The planes above hold no character that decomposes to ASCII.
    for code in range(0x80, 0x20000):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if ord(c) < 128)
        if len(plain) == 1:
            single[char] = plain
        elif plain:
            several[char] = plain
    return single, several


def ascii_fold(name: Column) -> Column:
    """Drop accents and any character without an ASCII form."""
    single, several = _ascii_folds()
    pairs = "\n".join(f"{char}\t{plain}" for char, plain in several.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))
    letters = F.regexp_extract_all(name, F.lit("(?s)(.)"), 1)
    spelled = F.array_join(
        F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    # Ligatures and the like are rare, so the per-character path is conditional.
    folded = F.when(name.rlike("[" + "".join(several) + "]"), spelled).otherwise(name)
    folded = F.translate(folded, "".join(single), "".join(single.values()))
    folded = F.regexp_replace(folded, "[^\\x00-\\x7F]", "")
    return F.when(name.rlike("[^\\x00-\\x7F]"), folded).otherwise(name)


def tokens(name: Column) -> Column:
    parts = F.split(F.lower(ascii_fold(name)), "[^a-z0-9]+")
    return F.filter(parts, lambda t: t != "")


def name_key(name: Column) -> Column:
    """Identifying tokens in order; a name made only of generic words keeps them all."""

    def telling_or_all(words: Column) -> Column:
        telling = F.filter(words, lambda t: ~t.isin(GENERIC_WORDS))
        return F.when(F.size(telling) > 0, telling).otherwise(words)

    # Through a one-element array, so that the tokens are worked out once.
    return F.transform(F.array(tokens(name)), telling_or_all)[0]


def token_similarity(left: Column, right: Column) -> Column:
    """Matching-blocks ratio of two tokens; the argument order matters."""

    # Local, so that it travels to executors that do not have this package.
    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left, right)
        return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in pairs], dtype=float)

    return ratio(left, right)


def may_be_similar(left: Column, right: Column, floor: float) -> Column:
    """False only where the ratio cannot reach `floor` because of the lengths alone."""
    shorter = F.least(F.length(left), F.length(right))
    return shorter * 200 >= (F.length(left) + F.length(right)) * int(floor * 100)
