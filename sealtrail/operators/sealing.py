"""Sealing: rows in, ledger rows out.

All sealers are row-wise projections, so they run unchanged on streams and add
no shuffle (``seal_exchanges`` needs one, to find each reply's parent).  Times
are input columns: nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealtrail import schema as S
from sealtrail.functions import hashing as H
from sealtrail.functions import json_text as J
from sealtrail.functions import residue_arrays as A
from sealtrail.functions import sequence as Q
from sealtrail.functions import text as X
from sealtrail.operators.required import REQUIRED_FIELDS, all_filled
from sealtrail.profile import SealProfile


def no_parents() -> Column:
    return F.array().cast("array<string>")


def optional(df: DataFrame, name: str, default: Column) -> Column:
    """A column if the input has it, with a default for null."""
    return F.coalesce(F.col(name), default) if name in df.columns else default


def with_envelope(
    df: DataFrame,
    profile: SealProfile,
    *,
    payload: Column,
    object_type: str,
    release_class: str,
    claim_type: str,
    statement: Column,
    claim_ceiling: str,
    created_at_utc: Column,
    parents: Column | None = None,
    author: Column | None = None,
    device_id: Column | None = None,
    device_type: Column | None = None,
    media_type: str = S.JSON_MEDIA_TYPE,
) -> DataFrame:
    """Add payload hash, envelope text, content hash, object id and root.

    ``leaf_hash`` is the root; sealers with a node form replace it.
    """
    null_text = F.lit(None).cast("string")
    parents = no_parents() if parents is None else parents
    return (
        df.withColumn("payload", payload)
        .withColumns(
            {
                "bytes_sha256": H.payload_hash(F.col("payload")),
                "byte_length": F.octet_length("payload").cast("long"),
            }
        )
        .withColumn(
            "envelope_json",
            J.canonical_envelope(
                object_type=F.lit(object_type),
                parents=parents,
                media_type=F.lit(media_type),
                bytes_sha256=F.col("bytes_sha256"),
                byte_length=F.col("byte_length"),
                author=F.lit(profile.author) if author is None else author,
                release_class=F.lit(release_class),
                device_id=null_text if device_id is None else device_id,
                device_type=null_text if device_type is None else device_type,
                claim_type=F.lit(claim_type),
                statement=statement,
                claim_ceiling=F.lit(claim_ceiling),
                created_at_utc=created_at_utc,
            ),
        )
        .withColumn("content_leaf", H.payload_hash(F.col("envelope_json")))
        .withColumns(
            {
                "object_type": F.lit(object_type),
                "object_id": H.object_key(F.col("content_leaf")),
                "fco_root": H.key_bound_root(F.col("content_leaf"), F.lit(profile.key_sha256)),
                "parents_json": J.json_string_array(parents),
            }
        )
        .withColumn("leaf_hash", F.col("fco_root"))
    )


def _with_node_leaf(df: DataFrame) -> DataFrame:
    return df.withColumn("leaf_hash", H.leaf_hash(F.col("node_id"), F.col("fco_root")))


def _ledger_rows(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return df.select(*keep, *S.LEDGER_TEXT_COLUMNS)


def device_defaults(role: Column, device_id: Column, device_type: Column) -> tuple[Column, Column]:
    """Device id and type, defaulted by role."""
    agent = role == "agent"
    return (
        F.coalesce(
            device_id, F.when(agent, F.lit(S.AGENT_DEVICE_ID)).otherwise(F.lit(S.WEB_DEVICE_ID))
        ),
        F.coalesce(
            device_type,
            F.when(agent, F.lit(S.AGENT_DEVICE_TYPE)).otherwise(F.lit(S.WEB_DEVICE_TYPE)),
        ),
    )


def turn_payload(role: Column, content: Column, timestamp: Column) -> Column:
    return J.json_object(
        role.alias("role"), content.alias("content"), timestamp.alias("timestamp")
    )


def seal_turns(turns: DataFrame, profile: SealProfile, keep: tuple[str, ...] = ()) -> DataFrame:
    """Seal conversation turns.

    Input: role (human or agent), content, created_at_utc; device_id and
    device_type are optional.  ``keep`` names input columns to carry along.
    Turns without a role or content are not sealed; ``split_required`` names why.
    """
    turns = turns.where(all_filled(REQUIRED_FIELDS["turn"]))
    null_text = F.lit(None).cast("string")
    device_id, device_type = device_defaults(
        F.col("role"),
        optional(turns, "device_id", null_text),
        optional(turns, "device_type", null_text),
    )
    rows = turns.withColumns({"device_id": device_id, "device_type": device_type}).withColumn(
        "node_id", X.node_key(F.col("device_id"), F.lit("turn"), F.col("created_at_utc"))
    )
    sealed = with_envelope(
        rows,
        profile,
        payload=turn_payload(F.col("role"), F.col("content"), F.col("created_at_utc")),
        object_type=S.TURN_TYPE,
        release_class="public-safe",
        claim_type=S.TURN_TYPE,
        statement=F.concat("role", F.lit(" turn via "), "device_id", F.lit(".")),
        claim_ceiling=S.TURN_ENVELOPE_CEILING,
        created_at_utc=F.col("created_at_utc"),
        device_id=F.col("device_id"),
        device_type=F.col("device_type"),
    )
    sealed = _with_node_leaf(sealed).withColumns(
        {
            "payload_preview": X.turn_preview(F.col("role"), F.col("device_id"), F.col("content")),
            "claim_ceiling": F.lit(S.TURN_ROW_CEILING),
            "created_locally_at_utc": F.col("created_at_utc"),
            "synced_at_utc": F.col("created_at_utc"),
        }
    )
    return _ledger_rows(sealed, keep)


def _with_place(samples: DataFrame) -> DataFrame:
    """Texts of the place; null and what is no number print as null, as in JSON."""

    def printed(name: str) -> Column:
        value = F.col(name).cast("double")
        finite = F.abs(value) < float("inf")
        return F.coalesce(F.when(finite, J.js_number(value)), F.lit("null"))

    return samples.withColumns({"lat": printed("gps_lat"), "lng": printed("gps_lng")})


def sample_payload(custodian: Column, assessment: Column | None = None) -> Column:
    """Payload of a row with name, sequence, created_at_utc and place texts lat, lng."""
    parts = [
        F.lit('{"name":'), J.json_string(F.col("name")),
        F.lit(',"sequence":'), J.json_string(F.col("sequence")),
        F.lit(',"gps":{"lat":'), F.col("lat"),
        F.lit(',"lng":'), F.col("lng"),
        F.lit('},"custodian":'), J.json_string(custodian),
        F.lit(',"timestamp":'), J.json_string(F.col("created_at_utc")),
    ]
    if assessment is not None:
        parts += [F.lit(',"assessment":'), J.json_string(assessment)]
    return J.js_escapes(F.concat(*parts, F.lit("}")))


def seal_samples(samples: DataFrame, profile: SealProfile, keep: tuple[str, ...] = ()) -> DataFrame:
    """Seal field samples.

    Input: name, sequence, gps_lat, gps_lng, created_at_utc; custodian,
    device_id and device_type are optional.  Samples without a name or sequence
    are not sealed; ``split_required`` names why.
    """
    samples = samples.where(all_filled(REQUIRED_FIELDS["seal"]))
    rows = _with_place(samples).withColumns(
        {
            "custodian": optional(samples, "custodian", F.lit(profile.author)),
            "device_id": optional(samples, "device_id", F.lit(S.WEB_DEVICE_ID)),
            "device_type": optional(samples, "device_type", F.lit(S.WEB_DEVICE_TYPE)),
        }
    ).withColumn(
        "node_id", X.node_key(F.col("device_id"), F.lit("sample"), F.col("created_at_utc"))
    )
    sealed = with_envelope(
        rows,
        profile,
        payload=sample_payload(F.col("custodian")),
        object_type=S.SAMPLE_TYPE,
        release_class="field-private",
        claim_type=S.SAMPLE_TYPE,
        statement=F.concat(
            F.lit("Field sample "), "name", F.lit(" sealed at "), "lat", F.lit(","), "lng",
            F.lit(" by "), "custodian", F.lit("."),
        ),
        claim_ceiling=S.SAMPLE_ENVELOPE_CEILING,
        created_at_utc=F.col("created_at_utc"),
        author=F.col("custodian"),
        device_id=F.col("device_id"),
        device_type=F.col("device_type"),
    )
    sealed = _with_node_leaf(sealed).withColumns(
        {
            "payload_preview": X.sample_preview(
                F.col("name"), F.col("device_id"), F.col("sequence")
            ),
            "claim_ceiling": F.lit(S.SAMPLE_ROW_CEILING),
            "created_locally_at_utc": F.col("created_at_utc"),
            "synced_at_utc": F.col("created_at_utc"),
        }
    )
    return _ledger_rows(sealed, keep)


def _chat_rows(turns: DataFrame, profile: SealProfile, role: str, parents: Column, keep) -> DataFrame:
    device_id, device_type = device_defaults(
        F.lit(role), F.lit(None).cast("string"), F.lit(None).cast("string")
    )
    fields = [F.lit(role).alias("role"), F.col("content").alias("content"),
              F.col("created_at_utc").alias("timestamp")]
    if role == "agent" and "source" in turns.columns:
        fields.append(F.col("source").alias("source"))
    rows = turns.withColumns({"device_id": device_id, "device_type": device_type}).withColumn(
        "node_id",
        X.node_key(
            F.col("device_id"), F.lit("turn"), F.concat("created_at_utc", F.lit(f"-{role}"))
        ),
    )
    sealed = with_envelope(
        rows,
        profile,
        payload=J.json_object(*fields),
        object_type=S.TURN_TYPE,
        release_class="public-safe",
        claim_type=S.TURN_TYPE,
        statement=F.lit(f"{role} chat turn"),
        claim_ceiling=S.CHAT_CEILING,
        created_at_utc=F.col("created_at_utc"),
        parents=parents,
        device_id=F.col("device_id"),
        device_type=F.col("device_type"),
    )
    sealed = _with_node_leaf(sealed).withColumns(
        {
            "payload_preview": X.turn_preview(F.lit(role), F.col("device_id"), F.col("content")),
            "claim_ceiling": F.lit(S.CHAT_CEILING),
            "created_locally_at_utc": F.col("created_at_utc"),
            "synced_at_utc": F.col("created_at_utc"),
        }
    )
    return _ledger_rows(sealed, keep)


def seal_exchanges(
    turns: DataFrame,
    profile: SealProfile,
    conversation: str = "conv_id",
    turn: str = "turn",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Seal chats: each reply names the human turn right before it as parent.

    The parent is found by an equi-join on (conversation, turn number), which
    is unique, so a very long conversation spreads over all tasks; a window
    over the conversation would put it into one.
    """
    carried = tuple(dict.fromkeys((*keep, conversation, turn)))
    human = turns.where(F.col("role") == "human")
    agent = turns.where(F.col("role") == "agent")
    sealed_human = _chat_rows(human, profile, "human", no_parents(), carried)
    asked = sealed_human.select(
        F.col(conversation), (F.col(turn) + 1).alias(turn), F.col("object_id").alias("parent_id")
    )
    parents = F.when(F.col("parent_id").isNull(), no_parents()).otherwise(F.array("parent_id"))
    sealed_agent = _chat_rows(
        agent.join(asked, [conversation, turn], "left"), profile, "agent", parents, carried
    )
    return sealed_human.unionByName(sealed_agent).select(*keep, *S.LEDGER_TEXT_COLUMNS)


def prediction_payload() -> Column:
    """Payload of a row with accession, source, n_values, mean and confidence."""
    values = F.array_join(F.transform("confidence", J.js_number), ",")
    text = F.concat(
        F.lit('{"uniprot":'), F.coalesce(J.json_string(F.col("accession")), F.lit("null")),
        F.lit(',"source":'), J.json_string(F.col("source")),
        F.lit(',"length":'), F.col("n_values").cast("string"),
        F.lit(',"mean":'), J.js_number(X.round_half_up(F.col("mean"), 1)),
        F.lit(',"plddt":['), values, F.lit("]}"),
    )
    return J.js_escapes(text)


def choose_predictions(requests: DataFrame, structures: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Confidences for requests with an accession or a sequence, and their source.

    ``structures`` has one row (accession, confidence) per structure read.  Its
    numbers count if there are any; else the residues' stand-in does.  Requests
    with neither are dropped.
    """
    known = structures.where(F.size("confidence") > 0).select("accession", F.col("confidence").alias("_read"))
    found = F.col("_read").isNotNull()
    return (
        requests.join(known, "accession", "left")
        .withColumn("_made", A.confidence_array(F.when(~found, F.col("sequence"))))
        .select(
            *keep,
            "accession",
            F.when(found, F.lit(S.STRUCTURE_SOURCE)).otherwise(F.lit(S.FALLBACK_SOURCE)).alias("source"),
            F.when(found, F.col("_read")).otherwise(F.col("_made")).alias("confidence"),
        )
        .where(F.size("confidence") > 0)
    )


def seal_predictions(
    predictions: DataFrame, profile: SealProfile, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Seal per-sequence confidence results.

    Input: accession (may be null), source, confidence (array of double),
    created_at_utc.  Rows with an empty array are not sealed.
    """
    rows = (
        predictions.where(F.size("confidence") > 0)
        .withColumns(
            {
                "accession": F.nullif(F.col("accession"), F.lit("")),
                "n_values": F.size("confidence"),
                "mean": Q.sequential_mean("confidence"),
                "device_id": F.lit(S.PREDICTION_DEVICE_ID),
                "device_type": F.lit(S.WEB_DEVICE_TYPE),
            }
        )
        .withColumn("mean_text", X.fixed_two(F.col("mean")))
        .withColumn(
            "node_id",
            X.node_key(
                F.lit("plddt"),
                F.coalesce("accession", F.lit(S.UNMAPPED_ACCESSION)),
                F.col("created_at_utc"),
            ),
        )
    )
    sealed = with_envelope(
        rows,
        profile,
        payload=prediction_payload(),
        object_type=S.PREDICTION_TYPE,
        release_class="public-safe",
        claim_type=S.PREDICTION_TYPE,
        statement=Q.prediction_statement(
            F.col("accession"), F.col("n_values"), F.col("mean_text")
        ),
        claim_ceiling=S.PREDICTION_CEILING,
        created_at_utc=F.col("created_at_utc"),
        device_id=F.col("device_id"),
        device_type=F.col("device_type"),
    )
    sealed = _with_node_leaf(sealed).withColumns(
        {
            "payload_preview": F.concat(
                F.lit("AlphaFold DB pLDDT ("), "source", F.lit(") for "),
                F.coalesce("accession", F.lit("sequence")), F.lit(": mean "), "mean_text",
                F.lit(", "), F.col("n_values").cast("string"), F.lit(" residues"),
            ),
            "claim_ceiling": F.lit(S.PREDICTION_CEILING),
            "created_locally_at_utc": F.col("created_at_utc"),
            "synced_at_utc": F.col("created_at_utc"),
        }
    )
    return _ledger_rows(sealed, keep)


def seal_seed_turns(turns: DataFrame, profile: SealProfile, keep: tuple[str, ...] = ()) -> DataFrame:
    """Seal initial turns that already have a node id and a device.

    Input: node_id, role, content, device_id, device_type, created_at_utc.
    """
    sealed = with_envelope(
        turns,
        profile,
        payload=J.json_object(
            *[F.col(c) for c in ("node_id", "role", "content", "device_id", "device_type")]
        ),
        object_type=S.TURN_TYPE,
        release_class="public-safe",
        claim_type=S.TURN_TYPE,
        statement=F.concat(
            F.lit("Conversation turn: "), "role", F.lit(" via "), "device_id", F.lit(".")
        ),
        claim_ceiling=S.SEED_TURN_ENVELOPE_CEILING,
        created_at_utc=F.col("created_at_utc"),
        device_id=F.col("device_id"),
        device_type=F.col("device_type"),
    )
    sealed = _with_node_leaf(sealed).withColumns(
        {
            "payload_preview": X.turn_preview(F.col("role"), F.col("device_id"), F.col("content")),
            "claim_ceiling": F.lit(S.TURN_ENVELOPE_CEILING),
            "created_locally_at_utc": F.col("created_at_utc"),
            "synced_at_utc": F.col("created_at_utc"),
        }
    )
    return _ledger_rows(sealed, keep)


def seal_seed_samples(
    samples: DataFrame, profile: SealProfile, synced_at_utc: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Seal initial samples that come with a node id and an assessment.

    Input: node_id, name, sequence, gps_lat, gps_lng, assessment,
    created_at_utc.  The device is the first part of the node id.
    """
    rows = _with_place(samples).withColumns(
        {"device_id": X.node_device(F.col("node_id")), "device_type": F.lit("android")}
    )
    sealed = with_envelope(
        rows,
        profile,
        payload=sample_payload(F.lit(profile.author), F.col("assessment")),
        object_type=S.SAMPLE_TYPE,
        release_class="field-private",
        claim_type=S.SAMPLE_TYPE,
        statement=F.concat(
            F.lit("Field sample "), "name", F.lit(" sealed at "), "lat", F.lit(","), "lng",
            F.lit("."),
        ),
        claim_ceiling=S.SAMPLE_ENVELOPE_CEILING,
        created_at_utc=F.col("created_at_utc"),
        device_id=F.col("device_id"),
        device_type=F.col("device_type"),
    )
    sealed = _with_node_leaf(sealed).withColumns(
        {
            "payload_preview": X.assessed_preview(F.col("name"), F.col("assessment")),
            "claim_ceiling": F.lit(S.SAMPLE_ROW_CEILING),
            "created_locally_at_utc": F.col("created_at_utc"),
            "synced_at_utc": F.lit(synced_at_utc),
        }
    )
    return _ledger_rows(sealed, keep)
