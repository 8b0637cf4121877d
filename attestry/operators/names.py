"""Nearest known names by index: candidates come from an equi-join on keys, never from all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: from this distance on a known name is no suggestion.
FAR = 3
#: Names of up to so many characters are found by deletions, longer ones by pieces.
SHORT = 24


def shortened(names: Column, times: int) -> Column:
    """All names that an array of names leaves when up to `times` characters are deleted, each once."""
    for _ in range(times):
        fewer = F.transform(names, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s)))))
        names = F.array_distinct(F.concat(names, F.flatten(fewer)))
    return names


def _piece(length: Column, k: Column, parts: int) -> tuple[Column, Column]:
    """Where piece k of a name of that length starts (from 0), and its length."""
    at = lambda j: F.floor(length * j / parts).cast("int")
    return at(k), at(k + 1) - at(k)


def _key(kind: Column, text: Column) -> Column:
    return F.concat_ws(":", kind, text)


def _pieces_held(name: Column, most: int) -> Column:
    """Keys of the most + 1 pieces of a known name: most changes leave one of them whole."""
    n, parts = F.length(name), most + 1
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: _key(F.concat_ws(".", n, k), F.substring(name, _piece(n, k, parts)[0] + 1, _piece(n, k, parts)[1])))


def _pieces_sought(name: Column, most: int) -> Column:
    """Keys under which a known name within reach holds a piece: lengths and places differ by most at most."""
    shifts, parts = F.sequence(F.lit(-most), F.lit(most)), most + 1
    n = lambda d: F.length(name) + d

    def at(d: Column, k: Column, s: Column) -> Column:
        start, size = _piece(n(d), k, parts)
        return F.when((start + s >= 0) & (start + s + size <= F.length(name)), _key(F.concat_ws(".", n(d), k), F.substring(name, start + s + 1, size)))

    every = F.flatten(F.flatten(F.transform(shifts, lambda d: F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.transform(shifts, lambda s: at(d, k, s))))))
    return F.array_distinct(F.array_compact(every))


def near(names: DataFrame, known: DataFrame, name_col: str = "name", known_col: str = "known", most: int = FAR - 1) -> DataFrame:
    """name, known, distance: every pair of names within `most` changes of a character, each pair once.

    Names of up to SHORT characters meet at what is left when up to `most` characters are deleted on both sides; longer ones
    at one of the most + 1 pieces of the known name that the changes leave whole.  Both find every pair; what meets is verified.
    The keys of a name are a few hundred at most, however long it is, and none of either side is broadcast or collected.

    Null names match nothing; an empty name is a name; repeated names count once; empty tables give an empty result.
    """
    a = names.select(F.col(f"`{name_col}`").alias("name")).filter("name IS NOT NULL").distinct()
    b = known.select(F.col(f"`{known_col}`").alias("known")).filter("known IS NOT NULL").distinct()
    few = lambda c: F.transform(shortened(F.array(c), most), lambda s: _key(F.lit("d"), s))

    def keyed(df: DataFrame, c: str, pieces) -> DataFrame:
        # a pair that straddles SHORT has deletions on both sides; any other pair of long names has pieces on both
        n = F.length(c)
        short = df.filter(n <= SHORT + most).select(c, F.explode(few(F.col(c))).alias("key"))
        return short.unionByName(df.filter(n > SHORT).select(c, F.explode(pieces(F.col(c), most)).alias("key")))

    met = keyed(a, "name", _pieces_sought).join(keyed(b, "known", _pieces_held), "key").select("name", "known").distinct()
    return met.withColumn("distance", F.levenshtein("name", "known", most)).filter("distance >= 0")


def suggestions(names: DataFrame, known: DataFrame, name_col: str = "name", known_col: str = "known", far: int = FAR) -> DataFrame:
    """name, known, distance: for each name that is not known, the nearest known ones, all that tie; none from `far` on."""
    pairs = near(names, known, name_col, known_col, far - 1)
    least = F.min("distance").over(Window.partitionBy("name"))  # a name's rows are the known names near it
    return pairs.withColumn("least", least).filter("distance = least AND least > 0").drop("least")
