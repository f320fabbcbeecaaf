"""Expected values worked out in plain Python, one row at a time."""

from __future__ import annotations

import hashlib
import json


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(left: str, right: str) -> str:
    return sha("\x01" + left + right)


def root(leaves: list[str]) -> str:
    """Root by splitting off the largest perfect tree, from the left."""
    if not leaves:
        return "0" * 64
    size = 1 << (len(leaves).bit_length() - 1)
    tree = leaves[:size]
    while len(tree) > 1:
        tree = [parent(a, b) for a, b in zip(tree[::2], tree[1::2])]
    rest = leaves[size:]
    return parent(tree[0], root(rest)) if rest else tree[0]


def compact(value) -> str:
    """JSON text as JSON.stringify writes it."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def envelope(payload: str, *, object_type, created, parents, authorization, claim) -> dict:
    return {
        "fco_version": "v3",
        "object_type": object_type,
        "parents": parents,
        "payload": {
            "media_type": "application/json",
            "bytes_sha256": sha(payload),
            "byte_length": len(payload.encode()),
        },
        "authorization": authorization,
        "claim": claim,
        "created_at_utc": created,
    }


def chain(text: str, key: str, node_id: str | None = None) -> dict:
    content = sha(text)
    bound = sha("\x00" + content + "\x00" + key)
    return {
        "envelope_json": text,
        "content_leaf": content,
        "object_id": "sha256:" + content,
        "fco_root": bound,
        "leaf_hash": bound if node_id is None else sha("\x00" + node_id + "|" + bound),
    }
