"""Risk rules over sequences and replies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reply screen's terms and its warning.
THREAT_PATTERN = "(ricin|ribosome.inactivating|toxin|high.risk|biothreat|bioweapon)"
THREAT_WARNING = "HIGH-RISK sequence detected. Biosecurity containment recommended."


@dataclass(frozen=True)
class RiskRules:
    """Default values are the fixed ones; rules and texts can be replaced."""

    name_pattern: str = "ricin|toxin"
    max_length: int = 250
    signatures: tuple[str, ...] = ("MIFPKQYPIINFTTAGATVQSY",)
    red_text: str = (
        "HIGH RISK. Bio-threat classification: Ribosome-Inactivating Protein (RIP). "
        "Potent toxin. Immediate biosecurity containment recommended."
    )
    green_text: str = "Standard Fluorescent Marker. Low risk. Safe for biosafety level 1 research."


def threat_warning(
    text: Column, pattern: str = THREAT_PATTERN, warning: str = THREAT_WARNING
) -> Column:
    """Warning text if the case-folded text matches, else null."""
    return F.when(F.lower(text).rlike(pattern), F.lit(warning))


def is_high_risk(sequence: Column, rules: RiskRules = RiskRules()) -> Column:
    tests = [
        F.length(sequence) > rules.max_length,
        *[F.startswith(sequence, F.lit(s)) for s in rules.signatures],
        sequence.rlike(f"(?i){rules.name_pattern}"),
    ]
    return reduce(or_, tests)


def risk_level(sequence: Column, rules: RiskRules = RiskRules()) -> Column:
    return F.when(is_high_risk(sequence, rules), F.lit("red")).otherwise(F.lit("green"))


def risk_assessment(sequence: Column, rules: RiskRules = RiskRules()) -> Column:
    return F.when(is_high_risk(sequence, rules), F.lit(rules.red_text)).otherwise(
        F.lit(rules.green_text)
    )
