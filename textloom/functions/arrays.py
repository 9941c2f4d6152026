"""Array and number expressions shared by the text and vector operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    An expression used inside a lambda is evaluated again for every element, so
    sorting an array and then indexing it would sort once per element. Binding it
    as a lambda variable keeps the work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_runs(items: Column, name: str) -> Column:
    """Distinct items with their number of occurrences: ``array<struct<name, n>>``.

    Counting happens inside the row, by sorting and measuring run lengths, so the
    counts of a document need no shuffle. Empty or null input gives an empty array.
    """

    def runs(s: Column) -> Column:
        """Runs of equal items of a sorted array."""
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda begin, j: F.struct(
                    F.get(s, begin).alias(name),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - begin).cast("long").alias("n"),
                ),
            ),
        )

    empty = F.array().cast(f"array<struct<{name}:string,n:bigint>>")
    return let(F.sort_array(items), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def gather_runs(items: Column) -> Column:
    """``array<struct<word, at>>`` grouped by word: ``array<struct<word, n, at array>>``.

    The counterpart of ``count_runs`` that also keeps where each item occurs.
    """

    def word(s: Column, i: Column) -> Column:
        return F.get(s, i)["word"]

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (word(s, i) != word(s, i - 1))
        )

        def entry(st: Column, begin: Column, j: Column) -> Column:
            length = F.coalesce(F.get(st, j + 1), F.size(s)) - begin
            return F.struct(
                word(s, begin).alias("word"),
                length.cast("long").alias("n"),
                F.transform(F.slice(s, begin + 1, length), lambda x: x["at"]).alias("at"),
            )

        return let(starts, lambda st: F.transform(st, lambda begin, j: entry(st, begin, j)))

    empty = F.array().cast("array<struct<word:string,n:bigint,at:array<int>>>")
    return let(F.sort_array(items), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles, summed in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def millionths(x: Column) -> Column:
    """A double rounded to six digits, as a whole number of millionths.

    Sums of them are exact, as those of decimals are, and cost no object per row.
    """
    return F.rint(F.round(x, 6) * 1_000_000).cast("long")


def unit(vec: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    return let(
        F.transform(vec, lambda x: x.cast("double")),
        lambda v: let(
            F.sqrt(dot(v, v)),
            lambda length: F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v),
        ),
    )
