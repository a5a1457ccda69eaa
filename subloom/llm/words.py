"""Words and word shingles as column expressions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 5
# White space that separates words, beside the blank; each becomes a blank.
BREAKS = "\t\n\x0b\x0c\r"


def word_list(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case; none for null."""
    plain = F.translate(
        F.coalesce(text, F.lit("")),
        string.ascii_uppercase + BREAKS,
        string.ascii_lowercase + " " * len(BREAKS),
    )
    return F.array_remove(F.split(plain, " "), "")


def as_text(key: Column) -> Column:
    """A key on its way through pandas, where integers beside a null would become floats. Cast it
    back to its own type behind that."""
    return key.cast("string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words in order; none if there are fewer words."""
    return let(words, lambda w: _runs(w, length))


def _runs(words: Column, length: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)
    runs = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(length))))
    return F.when(F.size(words) >= length, runs).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(words: Column, length: int = SHINGLE) -> Column:
    """Hashes of the shingles in order, repeats included. Fewer words make one shingle together,
    no words none."""

    def shingles(w: Column) -> Column:
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(w)))
        return F.when(F.size(w) >= length, _runs(w, length)).otherwise(
            F.coalesce(few, F.array().cast("array<bigint>"))
        )

    return let(words, shingles)
