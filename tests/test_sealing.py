"""Sealed rows against rows worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from sealtrail.operators import sealing
from tests import by_hand
from tests.test_functions import TEXTS

AT = "2024-05-06T07:08:09.010Z"


def test_turns(spark, profile):
    rows = [(i, ("human", "agent")[i % 2], t, AT, None, None) for i, t in enumerate(TEXTS)]
    rows.append((99, "agent", "y" * 200, AT, "phone-1", "android"))
    turns = spark.createDataFrame(
        rows, "i int, role string, content string, created_at_utc string, device_id string, device_type string"
    )
    got = {r.i: r.asDict() for r in sealing.seal_turns(turns, profile, ("i",)).collect()}
    defaults = {"human": ("web-demo", "web"), "agent": ("sauna-agent", "agent")}
    for i, role, content, _, device, kind in rows:
        if not content:
            assert i not in got
            continue
        device, kind = device or defaults[role][0], kind or defaults[role][1]
        node = f"{device}/turn/{AT}"
        text = by_hand.canonical(
            by_hand.envelope(
                by_hand.compact({"role": role, "content": content, "timestamp": AT}),
                object_type="conversation_turn",
                created=AT,
                parents=[],
                authorization={
                    "author": profile.author, "release_class": "public-safe",
                    "device_id": device, "device_type": kind,
                },
                claim={
                    "type": "conversation_turn",
                    "statement": f"{role} turn via {device}.",
                    "claim_ceiling": "Conversation turn bound to public key; content not validated by FCG.",
                },
            )
        )
        expected = by_hand.chain(text, profile.key_sha256, node)
        row = got[i]
        assert {k: row[k] for k in expected} == expected
        assert row["node_id"] == node
        cut = content[:160] + ("..." if len(content) > 160 else "")
        assert row["payload_preview"] == f"{role} via {device}: {cut}"
        assert row["parents_json"] == "[]"


def test_samples(spark, profile):
    rows = [
        ("s1", "MSKGEEL", 37.4275, -122.1697, None, None),
        ("s\"2", "MIF\n", 5.0, 1e-7, "Other", "phone"),
        ("s3", "A", -0.0, 1e21, None, None),
        ("s4", "A", None, float("nan"), None, None),
        ("", "A", 1.0, 1.0, None, None),
        ("s5", "", 1.0, 1.0, None, None),
        ("s6", None, 1.0, 1.0, None, None),
    ]
    shown = {"s1": ("37.4275", "-122.1697"), 's"2': ("5", "1e-7"), "s3": ("0", "1e+21"), "s4": ("null", "null")}
    samples = spark.createDataFrame(
        [(*r, AT) for r in rows],
        "name string, sequence string, gps_lat double, gps_lng double, custodian string, device_id string, created_at_utc string",
    )
    got = {r.name: r for r in sealing.seal_samples(samples, profile, ("name",)).collect()}
    assert set(got) == set(shown)
    for name, sequence, _, _, custodian, device in rows[:4]:
        custodian, device = custodian or profile.author, device or "web-demo"
        lat, lng = shown[name]
        payload = (
            '{"name":%s,"sequence":%s,"gps":{"lat":%s,"lng":%s},"custodian":%s,"timestamp":"%s"}'
            % (by_hand.compact(name), by_hand.compact(sequence), lat, lng, by_hand.compact(custodian), AT)
        )
        text = by_hand.canonical(
            by_hand.envelope(
                payload,
                object_type="field_sample_sealed",
                created=AT,
                parents=[],
                authorization={
                    "author": custodian, "release_class": "field-private",
                    "device_id": device, "device_type": "web",
                },
                claim={
                    "type": "field_sample_sealed",
                    "statement": f"Field sample {name} sealed at {lat},{lng} by {custodian}.",
                    "claim_ceiling": "Field sample is content-addressed and public-key-bound; biological interpretation requires separate analysis.",
                },
            )
        )
        expected = by_hand.chain(text, profile.key_sha256, f"{device}/sample/{AT}")
        row = got[name].asDict()
        assert {k: row[k] for k in expected} == expected
        assert row["payload_preview"] == f"{name} via {device}: {len(sequence)} aa"


def test_exchanges_link_replies_to_the_turn_before(spark, profile):
    rows = [
        (1, 0, "human", "q0"), (1, 1, "agent", "a0"), (1, 2, "human", "q1"), (1, 4, "agent", "late"),
        (2, 0, "human", "system"), (2, 1, "human", "q"), (2, 2, "agent", "a"), (2, 3, "agent", "more"),
    ]
    turns = spark.createDataFrame(
        [(*r, f"2024-01-01T00:00:0{r[1]}.000Z") for r in rows],
        "conv_id long, turn long, role string, content string, created_at_utc string",
    )
    sealed = sealing.seal_exchanges(turns, profile, keep=("conv_id", "turn")).collect()
    ids = {(r.conv_id, r.turn): r.object_id for r in sealed}
    parents = {(r.conv_id, r.turn): r.parents_json for r in sealed}
    assert len(sealed) == len(rows)
    assert parents[1, 1] == f'["{ids[1, 0]}"]'
    assert parents[2, 2] == f'["{ids[2, 1]}"]'
    for key in ((1, 0), (1, 2), (1, 4), (2, 0), (2, 1), (2, 3)):
        assert parents[key] == "[]"
    reply = next(r for r in sealed if (r.conv_id, r.turn) == (1, 1))
    at = "2024-01-01T00:00:01.000Z"
    text = by_hand.canonical(
        by_hand.envelope(
            by_hand.compact({"role": "agent", "content": "a0", "timestamp": at}),
            object_type="conversation_turn",
            created=at,
            parents=[ids[1, 0]],
            authorization={
                "author": profile.author, "release_class": "public-safe",
                "device_id": "sauna-agent", "device_type": "agent",
            },
            claim={
                "type": "conversation_turn", "statement": "agent chat turn",
                "claim_ceiling": "Chat turn bound to public key.",
            },
        )
    )
    assert reply.object_id == by_hand.chain(text, profile.key_sha256)["object_id"]


def test_predictions(spark, profile):
    rows = [("P1", "alphafold-db", [90.0, 80.5, 70.25], AT), (None, "fallback", [50.0], AT), ("E", "x", [], AT)]
    predictions = spark.createDataFrame(
        rows, "accession string, source string, confidence array<double>, created_at_utc string"
    )
    sealed = {r.node_id: r for r in sealing.seal_predictions(predictions, profile).collect()}
    assert set(sealed) == {f"plddt/P1/{AT}", f"plddt/unmapped/{AT}"}
    payload = '{"uniprot":"P1","source":"alphafold-db","length":3,"mean":80.3,"plddt":[90,80.5,70.25]}'
    row = sealed[f"plddt/P1/{AT}"]
    assert by_hand.sha(payload) in row.envelope_json
    assert "AlphaFold DB pLDDT for P1 (3 residues, mean 80.25)." in row.envelope_json
    assert row.payload_preview == "AlphaFold DB pLDDT (alphafold-db) for P1: mean 80.25, 3 residues"
    other = sealed[f"plddt/unmapped/{AT}"]
    payload = '{"uniprot":null,"source":"fallback","length":1,"mean":50,"plddt":[50]}'
    assert by_hand.sha(payload) in other.envelope_json
    assert "for unmapped sequence (1 residues, mean 50.00)." in other.envelope_json
    assert other.payload_preview == "AlphaFold DB pLDDT (fallback) for sequence: mean 50.00, 1 residues"


def test_seed_rows(spark, profile):
    turn = spark.createDataFrame(
        [("turns/t1.json", "human", "hi", "dev-1", "mac", AT)],
        "node_id string, role string, content string, device_id string, device_type string, created_at_utc string",
    )
    sealed = sealing.seal_seed_turns(turn, profile).first()
    payload = by_hand.compact(
        {"node_id": "turns/t1.json", "role": "human", "content": "hi", "device_id": "dev-1", "device_type": "mac"}
    )
    assert by_hand.sha(payload) in sealed.envelope_json
    assert sealed.leaf_hash == by_hand.sha("\x00turns/t1.json|" + sealed.fco_root)
    sample = spark.createDataFrame(
        [("android-9/field-sample/x", "n", "MSK", 1.5, 2.0, "ok", AT)],
        "node_id string, name string, sequence string, gps_lat double, gps_lng double, assessment string, created_at_utc string",
    )
    sealed = sealing.seal_seed_samples(sample, profile, "later").first()
    payload = (
        '{"name":"n","sequence":"MSK","gps":{"lat":1.5,"lng":2},"custodian":"Test Keeper","timestamp":"%s","assessment":"ok"}'
        % AT
    )
    assert by_hand.sha(payload) in sealed.envelope_json
    assert (sealed.device_id, sealed.synced_at_utc) == ("android-9", "later")
    assert sealed.payload_preview == "n via android: ok"


def test_predictions_fall_back_to_residues(spark, profile):
    asked = spark.createDataFrame(
        [("P1", "ACD"), ("P2", "VK"), (None, "A"), ("P3", ""), ("P4", None)], "accession string, sequence string"
    )
    read = spark.createDataFrame([("P1", [90.5, 80.0]), ("P2", [])], "accession string, confidence array<double>")
    chosen = sealing.choose_predictions(asked, read)
    got = {r.accession: (r.source, [round(x, 6) for x in r.confidence]) for r in chosen.collect()}
    assert got == {
        "P1": ("alphafold-db", [90.5, 80.0]),
        "P2": ("fallback", [92.0, 73.076871]),
        None: ("fallback", [80.0]),
    }
    sealed = sealing.seal_predictions(chosen.withColumn("created_at_utc", F.lit(AT)), profile)
    assert sealed.where("content_leaf is not null").count() == 3
