"""Residue sequences: cleaning, peptide statistics, confidence scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealtrail.functions.json_text import js_number
from sealtrail.functions.text import clamp, js_trim, round_half_up

# Residue letters kept by cleaning.
RESIDUE_ALPHABET = "ACDEFGHIKLMNPQRSTVWYXBJOUZ"

# Published residue scales (hydropathy, helix, sheet).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5,
    "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8,
    "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
HELIX = {
    "A": 1.42, "R": 0.98, "N": 0.67, "D": 1.01, "C": 0.70, "Q": 1.11, "E": 1.51,
    "G": 0.57, "H": 1.00, "I": 1.08, "L": 1.21, "K": 1.16, "M": 1.45, "F": 1.13,
    "P": 0.57, "S": 0.77, "T": 0.83, "W": 1.08, "Y": 0.69, "V": 1.06,
}
SHEET = {
    "A": 0.83, "R": 0.93, "N": 0.89, "D": 0.54, "C": 1.19, "Q": 1.10, "E": 0.37,
    "G": 0.75, "H": 0.87, "I": 1.60, "L": 1.30, "K": 0.74, "M": 1.05, "F": 1.38,
    "P": 0.55, "S": 0.75, "T": 1.19, "W": 1.37, "Y": 1.47, "V": 1.70,
}

SCALES = {"hydropathy": HYDROPATHY, "helix": HELIX, "sheet": SHEET}

# Residue charges.
CHARGES = {"KR": 1, "DE": -1}

# Confidence classes, their scores, and the score of the rest.
CONFIDENCE_CLASSES = (("VILFM", 92.0), ("ACWGSTY", 80.0), ("KRDEHNPQ", 70.0))
CONFIDENCE_OTHER = 60.0
CONFIDENCE_RANGE = (50.0, 98.0)

# Mass per residue and of one water, in daltons.
RESIDUE_MASS = 110
WATER_MASS = 18


def hundredths(scale: dict[str, float]) -> dict[str, int]:
    """A residue scale in whole hundredths, so that sums are exact."""
    return {letter: round(value * 100) for letter, value in scale.items()}


def sanitize_sequence(text: Column) -> Column:
    return F.regexp_replace(F.upper(js_trim(text)), f"[^{RESIDUE_ALPHABET}]", "")


def residues(sequence: Column) -> Column:
    """Array of single letters; empty for an empty sequence."""
    return F.when(sequence == "", F.array().cast("array<string>")).otherwise(F.split(sequence, ""))


def peptide_stats(length: Column, sums: Column) -> Column:
    """Statistics struct from a sequence's length and its ``residue_sums``.

    Mass is the rough 110 per residue less one water.  Hydropathy, helix and
    sheet are per-residue means of integer hundredths, so order and float
    error cannot move a rounding tie.
    """

    def per_residue(name: str) -> Column:
        return round_half_up(sums[name] / length)

    stats = {
        "mass": length * RESIDUE_MASS - WATER_MASS,
        "pi": round_half_up(clamp(sums["charge"] * F.lit(0.5) + 7, 2.0, 12.0), 1),
        "gravy": per_residue("hydropathy") / 100,
        "helix": per_residue("helix").cast("long"),
        "sheet": per_residue("sheet").cast("long"),
    }
    empty = {"mass": 0, "pi": 7.0, "gravy": 0.0, "helix": 0, "sheet": 0}
    return F.struct(
        length.alias("length"),
        *[F.when(length > 0, v).otherwise(F.lit(empty[k])).alias(k) for k, v in stats.items()],
    )


def sequential_mean(values: str) -> Column:
    """Mean of an array column, summed in array order; 0 for an empty array."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def prediction_statement(accession: Column, length: Column, mean_text: Column) -> Column:
    """Claim sentence of a confidence prediction; the mean comes with two decimals.

    The sentence is a fixed value.
    """
    return F.concat(
        F.lit("AlphaFold DB pLDDT for "),
        F.when(F.coalesce(F.length(accession), F.lit(0)) > 0, accession).otherwise(
            F.lit("unmapped sequence")
        ),
        F.lit(" ("),
        length.cast("string"),
        F.lit(" residues, mean "),
        mean_text,
        F.lit(")."),
    )


def peptide_statement(assessment: Column) -> Column:
    """Spoken report of a row with the peptide statistics columns.

    The sentence is a fixed value.
    """
    return F.concat(
        F.lit("Peptide analysis. Length: "), F.col("length").cast("string"),
        F.lit(" residues. Molecular weight: approximately "), F.col("mass").cast("string"),
        F.lit(" daltons. Isoelectric point: "), js_number(F.col("pi")),
        F.lit(". GRAVY hydropathy: "), js_number(F.col("gravy")),
        F.lit(". Predicted helix propensity: "), F.col("helix").cast("string"),
        F.lit(" percent. Predicted sheet propensity: "), F.col("sheet").cast("string"),
        F.lit(" percent. Biosecurity assessment: "), assessment, F.lit("."),
    )
