"""Column expressions shared by the operators of this folder."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space and U+0009 to U+000D part words.
GAPS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text, in order; none for an empty one."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def total(values: Column) -> Column:
    """Sum of an array of doubles, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
