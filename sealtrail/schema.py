"""Ledger, envelope and state schemas, and the fixed values of the format."""

from __future__ import annotations

from pyspark.sql import types as T

LEDGER_TEXT_COLUMNS = (
    "object_id",
    "object_type",
    "content_leaf",
    "fco_root",
    "leaf_hash",
    "node_id",
    "parents_json",
    "envelope_json",
    "payload_preview",
    "claim_ceiling",
    "device_id",
    "device_type",
    "created_locally_at_utc",
    "synced_at_utc",
)

LEDGER_COLUMNS = ("ingest_seq", *LEDGER_TEXT_COLUMNS)

# The ledger's total order.  Creation time is compared as text; the ingest
# number is unique and breaks ties.
LEDGER_ORDER = ("created_locally_at_utc", "ingest_seq")

LEDGER_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LEDGER_TEXT_COLUMNS])
LEDGER_SCHEMA = T.StructType([T.StructField("ingest_seq", T.LongType()), *LEDGER_TEXT_SCHEMA])

# Fields are in sorted order, so ``to_json`` of this struct is canonical.
ENVELOPE_SCHEMA = (
    "authorization struct<author:string,device_id:string,device_type:string,release_class:string>,"
    "claim struct<claim_ceiling:string,statement:string,type:string>,"
    "created_at_utc string,"
    "fco_version string,"
    "object_type string,"
    "parents array<string>,"
    "payload struct<byte_length:bigint,bytes_sha256:string,media_type:string>"
)

# A run is one folder of Parquet files.  ``rows`` counts what it holds.
RUNS = "array<struct<folder:string,rows:bigint>>"

# What is kept of every snapshot.  ``peaks`` holds the range's perfect-tree roots,
# largest first; their heights are the set bits of ``leaf_count``.
SNAPSHOT_FIELDS = (
    "batch_no long, merkle_root string, leaf_count long, updated_at_utc string, peaks array<string>, rows_added long, "
    "min_created string, last_created string, last_seq long, next_seq long, batch_key string"
)

# A state row is a snapshot and what the next append needs: the live runs, the
# snapshots that are still prefixes, and where the nodes of whole blocks are.
#
# ``open_created`` and ``open_seq`` are the order of the first leaf of the last, unfinished block.
# A segment says that a folder has the nodes of blocks [first, last); ``node`` is that of
# the first block if the folder lacks it, ``created`` and ``seq`` the order of its first leaf.
STATE_SCHEMA = (
    SNAPSHOT_FIELDS
    + f", row_runs {RUNS}, id_runs {RUNS}, history_runs {RUNS}, dropped array<string>"
    + ", open_created string, open_seq long"
    + ", prefixes array<struct<batch_no:bigint,leaf_count:bigint,last_created:string,last_seq:bigint,"
    "peaks:array<string>,open_created:string,open_seq:bigint>>"
    + ", segments array<struct<folder:string,first:bigint,last:bigint,created:string,seq:bigint,node:string>>"
)

# Fixed values of the ledger format.
STRUCTURE_SOURCE = "alphafold-db"
FALLBACK_SOURCE = "fallback"
ENVELOPE_VERSION = "v3"
OBJECT_ID_PREFIX = "sha256:"
EMPTY_ROOT = "0" * 64
JSON_MEDIA_TYPE = "application/json"
TURN_TYPE = "conversation_turn"
SAMPLE_TYPE = "field_sample_sealed"
PREDICTION_TYPE = "plddt_prediction"
SYNCED_TYPE = "synced_fco"

# Fixed default values for fields a request leaves out.
WEB_DEVICE_ID = "web-demo"
WEB_DEVICE_TYPE = "web"
AGENT_DEVICE_ID = "sauna-agent"
AGENT_DEVICE_TYPE = "agent"
PREDICTION_DEVICE_ID = "web-demo-plddt"
SYNC_DEVICE_ID = "unknown-device"
SYNC_DEVICE_TYPE = "cloud"
SYNC_CLAIM_CEILING = "Synced FCO; verification pending."
UNKNOWN_DEVICE = "unknown"
UNMAPPED_ACCESSION = "unmapped"

# Fixed claim texts, hashed into envelopes or stored on rows.
SEED_TURN_ENVELOPE_CEILING = (
    "This turn is content-addressed and public-key-bound; "
    "it does not establish truth of the content."
)
TURN_ENVELOPE_CEILING = "Conversation turn bound to public key; content not validated by FCG."
TURN_ROW_CEILING = "Conversation turn bound to public key."
CHAT_CEILING = "Chat turn bound to public key."
SAMPLE_ENVELOPE_CEILING = (
    "Field sample is content-addressed and public-key-bound; "
    "biological interpretation requires separate analysis."
)
SAMPLE_ROW_CEILING = "Field sample bound to public key; biological interpretation not validated by FCG."
PREDICTION_CEILING = (
    "Per-residue confidence from AlphaFold DB; biological interpretation requires separate analysis."
)

# Fixed sizes.
PREVIEW_CHARS = 160
SYNC_PREVIEW_CHARS = 200
TOUCH_PREVIEW_CHARS = 100
RECENT_ROWS = 12
CHUNK_CHARS = 4500
HEAD_LINES = 400
TAIL_LINES = 12
HEATMAP_ITEMS = 64
