"""Content-addressed custody ledgers as Spark DataFrames.

Rows are sealed with a SHA-256 hash chain, appended once per object id and
summarised by an order-dependent Merkle Mountain Range root.  Everything is a
``DataFrame -> DataFrame`` operator or a ``Column -> Column`` function.
"""

from sealtrail.profile import SealProfile
from sealtrail.sources.ledger_table import LedgerTable

__all__ = ["LedgerTable", "SealProfile"]
