"""Hash chain.  Hashes of hashes take the lower-case hex text, not raw bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealtrail.schema import OBJECT_ID_PREFIX

# U+0000 and U+0001 are the single bytes 00 and 01 in UTF-8.
_LEAF_MARK = "\x00"
_NODE_MARK = "\x01"


def payload_hash(payload: Column) -> Column:
    """Lower-case hex SHA-256 of text (as UTF-8) or of bytes."""
    return F.sha2(payload, 256)


def object_key(content_leaf: Column) -> Column:
    return F.concat(F.lit(OBJECT_ID_PREFIX), content_leaf)


def key_bound_root(content_leaf: Column, key_sha256: Column) -> Column:
    """sha256(00, content hash, 00, key fingerprint)."""
    mark = F.lit(_LEAF_MARK)
    return F.sha2(F.concat(mark, content_leaf, mark, key_sha256), 256)


def leaf_hash(node_id: Column, fco_root: Column) -> Column:
    """sha256(00, node id, '|', root)."""
    return F.sha2(F.concat(F.lit(_LEAF_MARK), node_id, F.lit("|"), fco_root), 256)


def merkle_parent(left: Column, right: Column) -> Column:
    """sha256(01, left hash, right hash)."""
    return F.sha2(F.concat(F.lit(_NODE_MARK), left, right), 256)


def hash_prefix(digest: Column, chars: int) -> Column:
    """First characters of a hash followed by an ellipsis."""
    return F.concat(F.substring(digest, 1, chars), F.lit("…"))
