"""Who seals, and with which key."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SealProfile:
    """Settings bound into every envelope.

    ``key_sha256`` is the hex fingerprint of the sealing key and is hashed as
    text; ``author`` is written to the envelope and is the default custodian.
    """

    key_sha256: str
    author: str
