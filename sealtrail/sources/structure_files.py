"""Fixed-width structure text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: record name, shortest line, number columns.
_RECORD = "ATOM"
_MIN_CHARS = 66
_NUMBER_AT, _NUMBER_CHARS = 61, 6
_ATOM_AT, _ATOM_CHARS = 13, 4

# The leading number of a text, as JavaScript's parseFloat takes it.
_LEADING_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under a path: file, value."""
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), "value")


def parse_float(text: Column) -> Column:
    """The number at the start of a text, null if there is none.

    Text that is a number as a whole is cast; only the rest needs the pattern.
    """
    text = F.btrim(text)
    whole = text.try_cast("double")
    start = F.regexp_extract(text, _LEADING_NUMBER, 1)
    return F.when(F.abs(whole) < float("inf"), whole).otherwise(
        F.when(start != "", start.try_cast("double"))
    )


def fixed_width_atoms(
    lines: DataFrame, keep: tuple[str, ...], line: str = "value", atom_name: str | None = None
) -> DataFrame:
    """The number in columns 61-66 of each atom line; other lines are dropped.

    Every atom line counts unless ``atom_name`` picks one kind.
    """
    text = F.col(line)
    atoms = lines.where(F.startswith(text, F.lit(_RECORD)) & (F.length(text) >= _MIN_CHARS))
    if atom_name is not None:
        atoms = atoms.where(F.btrim(F.substring(text, _ATOM_AT, _ATOM_CHARS)) == atom_name)
    number = parse_float(F.substring(text, _NUMBER_AT, _NUMBER_CHARS))
    return atoms.select(*keep, number.alias("confidence")).where(F.col("confidence").isNotNull())
