"""DuckDB SQL that gives the same rows as each query."""

from __future__ import annotations

import re

from sealtrail.functions import rules as R
from sealtrail.functions import sequence as Q
from sealtrail.operators.required import REQUIRED_FIELDS
from sealtrail.plans.inputs import PROFILE, SYNCED_AT
from sealtrail.plans.queries import SAMPLE_RULES, SAMPLE_THREATS
from sealtrail.sources.runs import FAN

AUTHOR = PROFILE.author
KEY = PROFILE.key_sha256

COLUMNS = (
    "object_id, object_type, content_leaf, fco_root, leaf_hash, node_id, parents_json, "
    "envelope_json, payload_preview, claim_ceiling, device_id, device_type, "
    "created_locally_at_utc, synced_at_utc"
)
SEALED = "object_id, content_leaf, fco_root, leaf_hash, payload_preview"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def js(text: str) -> str:
    return f"to_json({text})::varchar"


def number(value: str) -> str:
    return f"regexp_replace(({value})::varchar, '\\.0$', '')"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def after_base(seconds: str) -> str:
    return iso(f"(timestamp '2024-01-01' + to_seconds({seconds}))")


def key_root(content: str) -> str:
    return f"sha256('\\x00'::blob || encode({content}) || '\\x00'::blob || encode('{KEY}'))"


def node_leaf(node: str, root: str) -> str:
    return f"sha256('\\x00'::blob || encode({node} || '|' || {root}))"


def cut(text: str, chars: int, marker: str) -> str:
    return f"left({text}, {chars}) || CASE WHEN length({text}) > {chars} THEN '{marker}' ELSE '' END"


def joined_halves(text: str) -> str:
    """Wide characters from their halves; half of one becomes U+FFFD."""
    text = f"replace({text}, chr(57344) || chr(57345), chr(128512))"
    text = f"replace({text}, chr(57346) || chr(57347), chr(66376))"
    return f"replace(replace({text}, chr(57344), chr(65533)), chr(57346), chr(65533))"


def sealed_cte(
    name: str,
    source: str,
    *,
    payload: str,
    object_type: str,
    release: str,
    claim_type: str,
    statement: str,
    ceiling: str,
    created: str = "created",
    parents: str = "'[]'",
    author: str | None = None,
    device: bool = True,
    media_type: str = "application/json",
) -> str:
    """CTEs adding payload, envelope and hashes to a source."""
    by = js(author) if author else f"'\"{AUTHOR}\"'"
    fields = f"""'"author":' || {by} || """
    if device:
        fields += f"""',"device_id":' || {js('device_id')} || ',"device_type":' || {js('device_type')} || """
    fields += f"""',"release_class":"{release}"'"""
    return f"""
{name}_p AS (SELECT *, {payload} AS payload, {parents} AS parents_json FROM {source}),
{name}_e AS (SELECT *, sha256(payload) AS bytes_sha256, strlen(payload) AS byte_length,
  '{{"authorization":{{' || {fields} || '}},"claim":{{"claim_ceiling":"{ceiling}","statement":' ||
  to_json({statement})::varchar || ',"type":"{claim_type}"}},"created_at_utc":"' || {created} ||
  '","fco_version":"v3","object_type":"{object_type}","parents":' || parents_json ||
  ',"payload":{{"byte_length":' || strlen(payload)::varchar || ',"bytes_sha256":"' || sha256(payload) ||
  '","media_type":"{media_type}"}}}}' AS envelope_json FROM {name}_p),
{name}_c AS (SELECT *, sha256(envelope_json) AS content_leaf FROM {name}_e),
{name} AS (SELECT *, '{object_type}' AS object_type, 'sha256:' || content_leaf AS object_id,
  {key_root('content_leaf')} AS fco_root FROM {name}_c)"""


TURNS = f"""turns AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' ELSE 'human' END AS role,
  text AS content, {after_base('conv_id * 60 + turn')} AS created, (conv_id << 20) + turn AS ingest_seq
  FROM conversations)"""

DEVICES = """devices AS (SELECT *, CASE role WHEN 'agent' THEN 'sauna-agent' ELSE 'web-demo' END AS device_id,
  CASE role WHEN 'agent' THEN 'agent' ELSE 'web' END AS device_type FROM turns)"""

TURN_PAYLOAD = (
    f"""'{{"role":' || {js('role')} || ',"content":' || {js('content')} || ',"timestamp":"' || created || '"}}'"""
)

TURN_LEDGER = f"""{TURNS}, {DEVICES},
{sealed_cte('sealed', 'devices', payload=TURN_PAYLOAD, object_type='conversation_turn',
            release='public-safe', claim_type='conversation_turn',
            statement="role || ' turn via ' || device_id || '.'",
            ceiling='Conversation turn bound to public key; content not validated by FCG.')},
led AS (SELECT *, device_id || '/turn/' || created AS node_id,
  {node_leaf("device_id || '/turn/' || created", 'fco_root')} AS leaf_hash,
  role || ' via ' || device_id || ': ' || {cut('content', 160, '...')} AS payload_preview,
  'Conversation turn bound to public key.' AS claim_ceiling,
  created AS created_locally_at_utc, created AS synced_at_utc FROM sealed)"""


def _chat(role: str, device: str, kind: str, source: str, parents: str) -> str:
    replied = """ || '","source":"' || CASE WHEN turn % 4 = 1 THEN 'model' ELSE 'mock' END""" if role == "agent" else ""
    payload = f"""'{{"role":"{role}","content":' || {js('content')} || ',"timestamp":"' || created{replied} || '"}}'"""
    return f"""{role}_in AS (SELECT * REPLACE ('{device}' AS device_id, '{kind}' AS device_type) FROM {source}),
{sealed_cte(role + '_s', role + '_in', payload=payload, object_type='conversation_turn',
            release='public-safe', claim_type='conversation_turn',
            statement=quote(role + ' chat turn'), ceiling='Chat turn bound to public key.',
            parents=parents)},
{role}_led AS (SELECT *, '{device}/turn/' || created || '-{role}' AS node_id,
  {node_leaf(f"'{device}/turn/' || created || '-{role}'", 'fco_root')} AS leaf_hash,
  '{role} via {device}: ' || {cut('content', 160, '...')} AS payload_preview,
  'Chat turn bound to public key.' AS claim_ceiling,
  created AS created_locally_at_utc, created AS synced_at_utc FROM {role}_s)"""


EXCHANGES = f"""{TURNS}, {DEVICES},
human_src AS (SELECT *, NULL::varchar AS parent_id FROM devices WHERE role = 'human'),
{_chat('human', 'web-demo', 'web', 'human_src', "'[]'")},
agent_src AS (SELECT d.*, h.object_id AS parent_id FROM devices d
  LEFT JOIN human_led h ON h.conv_id = d.conv_id AND h.turn = d.turn - 1 WHERE d.role = 'agent'),
{_chat('agent', 'sauna-agent', 'agent', 'agent_src',
       "CASE WHEN parent_id IS NULL THEN '[]' ELSE '[\"' || parent_id || '\"]' END")},
led AS (SELECT ingest_seq, role, turn, parent_id, bytes_sha256, byte_length, {COLUMNS} FROM human_led
  UNION ALL SELECT ingest_seq, role, turn, parent_id, bytes_sha256, byte_length, {COLUMNS} FROM agent_led)"""

EVENT_PAYLOAD = (
    f"""'{{"event_id":' || event_id::varchar || ',"value":' || {number('value')} || ',"props":' || {js('props')} || '}}'"""
)

EVENT_LEDGER = f"""events_in AS (SELECT *, event_id AS ingest_seq, {iso('ts')} AS created,
  'dev-' || user_id::varchar AS device_id,
  CASE event_type WHEN 'purchase' THEN 'android' WHEN 'error' THEN 'cloud' ELSE 'web' END AS device_type
  FROM events),
{sealed_cte('sealed', 'events_in', payload=EVENT_PAYLOAD, object_type='device_event',
            release='public-safe', claim_type='device_event',
            statement="event_type || ' on ' || device_id || '.'",
            ceiling='Device event bound to public key.')},
led AS (SELECT *, fco_root AS leaf_hash, device_id || '/event/' || event_id::varchar AS node_id,
  event_type || ': ' || repeat(props, 30) AS payload_preview, 'Device event.' AS claim_ceiling,
  created AS created_locally_at_utc, '{SYNCED_AT}' AS synced_at_utc FROM sealed)"""

SYNCED = f"""{EVENT_LEDGER},
sent AS (SELECT CASE event_type WHEN 'signup' THEN '' ELSE object_id END AS object_id,
  coalesce(CASE event_type WHEN 'view' THEN NULL ELSE object_type END, 'synced_fco') AS object_type,
  CASE event_type WHEN 'error' THEN NULL ELSE content_leaf END AS content_leaf,
  fco_root, leaf_hash,
  CASE event_type WHEN 'view' THEN object_id ELSE node_id END AS node_id,
  parents_json,
  CASE event_type WHEN 'purchase' THEN '{{}}' ELSE envelope_json END AS envelope_json,
  left(payload_preview, 200) AS payload_preview,
  CASE event_type WHEN 'click' THEN 'Synced FCO; verification pending.' ELSE claim_ceiling END AS claim_ceiling,
  CASE event_type WHEN 'view' THEN 'unknown-device' ELSE device_id END AS device_id,
  CASE event_type WHEN 'click' THEN 'cloud' ELSE device_type END AS device_type,
  CASE event_type WHEN 'purchase' THEN synced_at_utc ELSE created_locally_at_utc END AS created_locally_at_utc,
  synced_at_utc FROM led),
kept AS (SELECT * FROM sent WHERE object_id <> '' AND content_leaf IS NOT NULL)"""


def root_ctes(ledger: str, order: str = "created_locally_at_utc, ingest_seq") -> str:
    """CTEs up to ``root(leaf_count, merkle_root)``; needs WITH RECURSIVE."""
    return f"""
leaves AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS i, leaf_hash AS h FROM {ledger}),
cnt AS (SELECT count(*) AS n FROM leaves),
tree AS (SELECT 0 AS lvl, i, h FROM leaves UNION ALL
  SELECT lvl + 1, i // 2, sha256('\\x01'::blob || encode(min_by(h, i)) || encode(max_by(h, i)))
  FROM tree GROUP BY lvl, i // 2 HAVING count(*) = 2),
peaks AS (SELECT lvl, h FROM tree, cnt WHERE (n >> lvl) & 1 = 1 AND i = (n >> lvl) - 1),
root AS (SELECT (SELECT n FROM cnt) AS leaf_count, coalesce(
  list_reduce(list(h ORDER BY lvl), lambda acc, x: sha256('\\x01'::blob || encode(x) || encode(acc))),
  repeat('0', 64)) AS merkle_root FROM peaks)"""


def second_root(ledger: str, order: str) -> str:
    """The same CTEs with other names, up to ``second_root``."""
    text = root_ctes(ledger, order)
    for name in ("leaves", "cnt", "tree", "peaks", "root"):
        text = re.sub(rf"\b{name}\b", f"second_{name}", text)
    return text


# The stored ledger of the append query: human turns, then what the batch adds.
STORED = f"""{TURN_LEDGER},
first_led AS (SELECT *, row_number() OVER (ORDER BY created, object_id) - 1 AS seq FROM led WHERE role = 'human'),
added AS (SELECT *, (SELECT count(*) FROM first_led) + row_number() OVER (ORDER BY created, object_id) - 1 AS seq
  FROM led WHERE role = 'agent' AND turn <> 3),
stored AS (SELECT * REPLACE (seq AS ingest_seq) FROM first_led UNION ALL SELECT * REPLACE (seq AS ingest_seq) FROM added)"""

SEQUENCES = f"""seqs AS (SELECT doc_id, regexp_replace(upper(replace(text, 'ß', 'ss')),
  '[^{Q.RESIDUE_ALPHABET}]', '', 'g') AS sequence FROM documents)"""

LAT = "((doc_id % 18000 - 9000) / 100.0)::double"
LNG = "((doc_id % 36000 - 18000) / 1000.0)::double"

SAMPLES = f"""{SEQUENCES},
samples AS (SELECT doc_id, 'doc-' || doc_id::varchar AS name, sequence, {LAT} AS lat, {LNG} AS lng,
  {after_base('doc_id')} AS created FROM seqs)"""

RED = (
    f"regexp_matches(sequence, '{SAMPLE_RULES.name_pattern}', 'i') OR length(sequence) > {SAMPLE_RULES.max_length}"
    + "".join(f" OR starts_with(sequence, '{s}')" for s in SAMPLE_RULES.signatures)
)
ASSESSMENT = (
    f"CASE WHEN {RED} THEN {quote(SAMPLE_RULES.red_text)} ELSE {quote(SAMPLE_RULES.green_text)} END"
)

SAMPLE_BODY = (
    f"""'{{"name":' || {js('name')} || ',"sequence":' || {js('sequence')} || ',"gps":{{"lat":' || """
    f"""{number('lat')} || ',"lng":' || {number('lng')} || '}},"custodian":"{AUTHOR}","timestamp":"' || created || '"'"""
)

SEED_TURNS = f"""{TURNS}, {DEVICES},
seed_in AS (SELECT *, 'turns/turn_' || conv_id || '_' || turn || '_' || role || '.json' AS node_id FROM devices),
{sealed_cte('sealed', 'seed_in',
            payload=f'''\'{{"node_id":\' || {js('node_id')} || \',"role":\' || {js('role')} || \',"content":\' || {js('content')} || \',"device_id":\' || {js('device_id')} || \',"device_type":\' || {js('device_type')} || \'}}\'''',
            object_type='conversation_turn', release='public-safe', claim_type='conversation_turn',
            statement="'Conversation turn: ' || role || ' via ' || device_id || '.'",
            ceiling='This turn is content-addressed and public-key-bound; it does not establish truth of the content.')},
led AS (SELECT *, {node_leaf('node_id', 'fco_root')} AS leaf_hash,
  role || ' via ' || device_id || ': ' || {cut('content', 160, '...')} AS payload_preview FROM sealed)"""

SAMPLE_CEILING = (
    "Field sample is content-addressed and public-key-bound; "
    "biological interpretation requires separate analysis."
)

LINES = """num AS (SELECT *, l_quantity::int::varchar || '.' || lpad(round(l_discount * 100)::int::varchar, 2, '0') AS txt
  FROM lineitem),
atoms AS (SELECT l_orderkey, l_linenumber, txt::double AS confidence FROM num
  WHERE l_returnflag <> 'R' AND NOT (l_linestatus = 'F' AND l_tax = 0) AND NOT (l_linestatus = 'O' AND l_tax = 0))"""

FIXED_MEAN = """CASE WHEN mean * 8 = floor(mean * 8) AND (mean * 8) % 2 = 1
  THEN printf('%.2f', floor(mean * 100 + 0.5) / 100) ELSE printf('%.2f', mean) END"""

PREDICTIONS = f"""{LINES},
lists AS (SELECT l_orderkey, list(confidence ORDER BY l_linenumber, confidence) AS vals FROM atoms GROUP BY l_orderkey),
preds AS (SELECT 'P' || l_orderkey::varchar AS acc, vals, len(vals) AS n,
  list_reduce(vals, lambda a, b: a + b) / len(vals) AS mean, {after_base('l_orderkey')} AS created,
  'web-demo-plddt' AS device_id, 'web' AS device_type FROM lists),
fixed AS (SELECT *, {FIXED_MEAN} AS mean_2, floor(mean * 10 + 0.5) / 10 AS mean_1 FROM preds)"""

STATEMENT = "'AlphaFold DB pLDDT for ' || acc || ' (' || n || ' residues, mean ' || mean_2 || ').'"

PREDICTION_PAYLOAD = (
    f"""'{{"uniprot":"' || acc || '","source":"alphafold-db","length":' || n || ',"mean":' || {number('mean_1')} || """
    """',"plddt":[' || array_to_string(list_transform(vals, lambda v: regexp_replace(v::varchar, '\\.0$', '')), ',') || ']}'"""
)


def weighted(scale: dict[str, float]) -> str:
    return " + ".join(
        f"({w}) * (length(sequence) - length(replace(sequence, '{a}', '')))"
        for a, w in Q.hundredths(scale).items()
    )


def letters(group: str) -> str:
    return f"(length(sequence) - length(regexp_replace(sequence, '[{group}]', '', 'g')))"


STATS = f"""{SEQUENCES},
sums AS (SELECT *, length(sequence) AS n, {letters('KR')} - {letters('DE')} AS charge,
  {weighted(Q.HYDROPATHY)} AS gsum, {weighted(Q.HELIX)} AS hsum, {weighted(Q.SHEET)} AS ssum FROM seqs),
stats AS (SELECT doc_id, sequence, n AS length, CASE WHEN n = 0 THEN 0 ELSE n * 110 - 18 END AS mass,
  CASE WHEN n = 0 THEN 7.0::double ELSE floor(greatest(2.0, least(12.0, 7 + charge * 0.5))::double * 10 + 0.5) / 10 END AS pi,
  CASE WHEN n = 0 THEN 0.0::double ELSE floor(gsum::double / n + 0.5) / 100 END AS gravy,
  CASE WHEN n = 0 THEN 0 ELSE floor(hsum::double / n + 0.5)::bigint END AS helix,
  CASE WHEN n = 0 THEN 0 ELSE floor(ssum::double / n + 0.5)::bigint END AS sheet FROM sums)"""

RESIDUES = f"""{SEQUENCES},
res AS (SELECT doc_id, unnest(range(length(sequence))) AS pos, unnest(string_split(sequence, '')) AS residue
  FROM seqs WHERE sequence <> '')"""

CONFIDENCE = f"""{RESIDUES},
conf AS (SELECT doc_id, pos, greatest(50.0::double, least(98.0::double,
  CASE WHEN residue IN ('V','I','L','F','M') THEN 92.0 WHEN residue IN ('A','C','W','G','S','T','Y') THEN 80.0
    WHEN residue IN ('K','R','D','E','H','N','P','Q') THEN 70.0 ELSE 60.0 END::double
  + sin(pos * 0.7::double) * 4 + (pos % 7) * 0.5::double)) AS value FROM res)"""

SIMILARITY = """few AS MATERIALIZED (SELECT place // 64 AS sequence, place % 64 AS i, v FROM (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS place, embedding::double[] AS v FROM embeddings)),
pairs AS (SELECT a.sequence, a.i, b.i AS j, list_dot_product(a.v, b.v) /
  (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9) AS value
  FROM few a JOIN few b ON a.sequence = b.sequence)"""

HISTORY = f"""{TURNS},
hist AS (SELECT conv_id, turn, role, content AS message, coalesce(string_agg(
  CASE role WHEN 'human' THEN 'Human: ' ELSE 'AI: ' END || content, chr(10))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
  FROM turns)"""

PAYLOADS = f"{TURNS}, payloads AS (SELECT conv_id, turn, {TURN_PAYLOAD} AS payload FROM turns)"

SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(8239) || chr(12288) || chr(65279)"

CHUNKS = f"""bodies AS (SELECT doc_id, trim(text, {SPACE}) AS body FROM documents),
folded AS (SELECT doc_id, body, CASE WHEN length(body) <= 4500 THEN {{'done': []::varchar[], 'cur': body}} ELSE
  list_reduce(list_transform(regexp_split_to_array(body, '\\n+'), lambda p: {{'done': []::varchar[], 'cur': p}}),
   lambda acc, x: CASE WHEN acc.cur <> '' AND length(acc.cur) + 2 + length(x.cur) > 4500
     THEN {{'done': list_append(acc.done, trim(acc.cur, {SPACE})), 'cur': x.cur}}
     WHEN acc.cur = '' THEN {{'done': acc.done, 'cur': x.cur}}
     ELSE {{'done': acc.done, 'cur': acc.cur || chr(10) || chr(10) || x.cur}} END) END AS f FROM bodies WHERE body <> ''),
parts AS (SELECT doc_id, length(body) AS chars, CASE WHEN trim(f.cur, {SPACE}) <> ''
  THEN list_append(f.done, trim(f.cur, {SPACE})) ELSE f.done END AS parts FROM folded)"""

def _required_sets() -> str:
    names = sorted({f for fields in REQUIRED_FIELDS.values() for f in fields})
    blank = {f: f"CASE WHEN doc_id % {i + 2} < 2 THEN '{f}' END" for i, f in enumerate(names)}
    parts = []
    for kind, fields in sorted(REQUIRED_FIELDS.items()):
        missing = f"concat_ws(',', {', '.join(blank[f] for f in fields)})"
        reason = f"CASE WHEN {missing} = '' THEN '' ELSE {missing} || ' required' END"
        parts.append(f"SELECT '{kind}' AS kind, {reason} AS reason, count(*) AS n FROM documents GROUP BY ALL")
    return " UNION ALL ".join(parts)


REQUIRED_SETS = _required_sets()

ORACLES: dict[str, str] = {
    "ledger_scan": f"""WITH {TURN_LEDGER}
SELECT row_number() OVER (ORDER BY created, object_id) - 1 AS ingest_seq, {COLUMNS} FROM led""",
    "ledger_lookup": f"""WITH {EXCHANGES}
SELECT object_id, object_type, node_id, fco_root FROM led
WHERE object_id IN (SELECT parent_id FROM led WHERE parent_id IS NOT NULL)""",
    "lookup_one": f"""WITH {EXCHANGES} SELECT object_id, object_type, node_id, fco_root FROM led
ORDER BY object_id LIMIT 1""",
    "ledger_append": f"WITH {STORED} SELECT ingest_seq, object_id, synced_at_utc FROM stored",
    "lookup_stored": f"""WITH {EXCHANGES}
SELECT object_id, object_type, node_id, fco_root FROM led
WHERE object_id IN (SELECT parent_id FROM led WHERE parent_id IS NOT NULL)""",
    "merged_batches": f"""WITH RECURSIVE {TURN_LEDGER}, placed AS (SELECT *,
  row_number() OVER (ORDER BY conv_id % {FAN + 1}, created, object_id) - 1 AS seq FROM led),
{root_ctes('placed', 'created, seq')}
SELECT seq AS ingest_seq, object_id, leaf_count, merkle_root FROM placed CROSS JOIN root""",
    "late_root": f"""WITH RECURSIVE {EVENT_LEDGER}, {root_ctes(
        'led', 'created, CASE WHEN event_id % 50 > 0 THEN 0 WHEN event_id % 100 > 0 THEN 1 ELSE 2 END, object_id')}
SELECT leaf_count, merkle_root FROM root""",
    "state_upsert": f"WITH RECURSIVE {STORED}, {root_ctes('stored')} SELECT merkle_root, leaf_count FROM root",
    "state_read": f"""WITH RECURSIVE {EVENT_LEDGER}, {root_ctes('led', 'created, object_id')}
SELECT leaf_count, merkle_root FROM root""",
    "damaged_state": f"""WITH RECURSIVE {TURN_LEDGER},
half AS (SELECT * FROM led WHERE ingest_seq % 2 = 0), {second_root('half', 'created, object_id')},
{root_ctes('led', 'created, ingest_seq % 2, object_id')}
SELECT leaf_count, merkle_root, 'appended' AS moment FROM root
UNION ALL SELECT leaf_count, merkle_root, 'damaged' FROM second_root""",
    "missing_state": f"""WITH RECURSIVE {TURN_LEDGER}, {root_ctes('led')} SELECT merkle_root, leaf_count FROM root""",
    "sync_ingest": f"WITH {SYNCED} SELECT {COLUMNS} FROM kept",
    "required_fields": """SELECT reason, count(*) AS n FROM (SELECT CASE turn WHEN 1 THEN 'content required'
  WHEN 2 THEN 'content required' WHEN 3 THEN 'role,content required' ELSE '' END AS reason
  FROM conversations) GROUP BY reason""",
    "required_sets": REQUIRED_SETS,
    "seal_incomplete": f"""WITH {SAMPLES},
samples_in AS (SELECT * REPLACE ('ACDE' AS sequence), 'web-demo' AS device_id, 'web' AS device_type,
  CASE doc_id % 6 WHEN 4 THEN 'null' ELSE {number('lat')} END AS lat_text FROM samples WHERE doc_id % 6 > 3),
{sealed_cte('whole', 'samples_in', payload=SAMPLE_BODY.replace(number('lat'), 'lat_text') + " || '}'",
            object_type='field_sample_sealed', release='field-private', claim_type='field_sample_sealed',
            statement=f"'Field sample ' || name || ' sealed at ' || lat_text || ',' || {number('lng')} || ' by {AUTHOR}.'",
            ceiling=SAMPLE_CEILING)},
{TURN_LEDGER}
SELECT object_id, object_type, content_leaf, name || ' via web-demo: 4 aa' AS payload_preview FROM whole
UNION ALL SELECT object_id, object_type, content_leaf, payload_preview FROM led WHERE turn NOT IN (1, 2)""",
    "union_ledgers": f"""WITH {EVENT_LEDGER} SELECT object_id, device_id,
  CASE WHEN event_type IN ('click', 'view') THEN synced_at_utc ELSE '2024-02-01T00:00:00.000Z' END AS synced_at_utc
  FROM led""",
    "seed_if_empty": """SELECT 'empty' AS ledger, 0 AS rows_before, count(*) AS rows_after FROM conversations
UNION ALL SELECT 'full', count(*), count(*) FROM conversations""",
    "seed_counts": f"""WITH {SEED_TURNS}
SELECT count(*) AS seeded, count(DISTINCT object_id) AS leaf_count FROM led""",
    "seal_turns": f"WITH {TURN_LEDGER} SELECT {SEALED} FROM led",
    "seal_samples": f"""WITH {SAMPLES},
samples_in AS (SELECT *, 'web-demo' AS device_id, 'web' AS device_type FROM samples),
{sealed_cte('sealed', 'samples_in', payload=SAMPLE_BODY + " || '}'", object_type='field_sample_sealed',
            release='field-private', claim_type='field_sample_sealed',
            statement=f"'Field sample ' || name || ' sealed at ' || {number('lat')} || ',' || {number('lng')} || ' by {AUTHOR}.'",
            ceiling=SAMPLE_CEILING)}
SELECT object_id, content_leaf, fco_root, {node_leaf("'web-demo/sample/' || created", 'fco_root')} AS leaf_hash,
  name || ' via web-demo: ' || length(sequence)::varchar || ' aa' AS payload_preview FROM sealed""",
    "seal_exchanges": f"WITH {EXCHANGES} SELECT object_id, parent_id, role, leaf_hash FROM led",
    "seed_turns": f"WITH {SEED_TURNS} SELECT {SEALED} FROM led",
    "seed_samples": f"""WITH {SAMPLES},
samples_in AS (SELECT *, 'android-001' AS device_id, 'android' AS device_type, {ASSESSMENT} AS assessment,
  'android-001/field-sample/' || created AS node_id FROM samples),
{sealed_cte('sealed', 'samples_in', payload=SAMPLE_BODY + " || ',\"assessment\":' || " + js('assessment') + " || '}'",
            object_type='field_sample_sealed', release='field-private', claim_type='field_sample_sealed',
            statement=f"'Field sample ' || name || ' sealed at ' || {number('lat')} || ',' || {number('lng')} || '.'",
            ceiling=SAMPLE_CEILING)}
SELECT object_id, content_leaf, fco_root, {node_leaf('node_id', 'fco_root')} AS leaf_hash,
  name || ' via android: ' || assessment AS payload_preview, device_id FROM sealed""",
    "seal_predictions": f"""WITH {PREDICTIONS},
{sealed_cte('sealed', 'fixed', payload=PREDICTION_PAYLOAD, object_type='plddt_prediction', release='public-safe',
            claim_type='plddt_prediction', statement=STATEMENT,
            ceiling='Per-residue confidence from AlphaFold DB; biological interpretation requires separate analysis.')}
SELECT object_id, content_leaf, fco_root, {node_leaf("'plddt/' || acc || '/' || created", 'fco_root')} AS leaf_hash,
  'AlphaFold DB pLDDT (alphafold-db) for ' || acc || ': mean ' || mean_2 || ', ' || n || ' residues' AS payload_preview
  FROM sealed""",
    "predict_with_fallback": f"""WITH {PREDICTIONS}, {CONFIDENCE},
made AS (SELECT doc_id, count(*) AS n_values, avg(value) AS mean FROM conf GROUP BY doc_id),
read AS (SELECT acc, count(*) AS n_values, avg(confidence) AS mean FROM (SELECT 'P' || l_orderkey::varchar AS acc, confidence FROM atoms)
  GROUP BY acc)
SELECT s.doc_id, 'P' || s.doc_id::varchar AS accession, CASE WHEN r.acc IS NULL THEN 'fallback' ELSE 'alphafold-db' END AS source,
  coalesce(r.n_values, m.n_values) AS n_values, round(coalesce(r.mean, m.mean), 5) + 0.0 AS mean
FROM seqs s LEFT JOIN made m ON m.doc_id = s.doc_id LEFT JOIN read r ON r.acc = 'P' || s.doc_id::varchar
WHERE coalesce(r.n_values, m.n_values) > 0""",
    "fixed_width_atoms": f"WITH {LINES} SELECT * FROM atoms",
    "head_lines": """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 400), chr(10)) AS head
  FROM documents""",
    "head_two_lines": """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) AS head
  FROM documents""",
    "tail_lines": """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), -12, -1), chr(10)) AS tail
  FROM documents""",
    "live_rows": f"""WITH {TURN_LEDGER} SELECT object_id, object_type, fco_root, device_id, device_type,
  created_locally_at_utc, payload_preview FROM led ORDER BY created_locally_at_utc DESC, ingest_seq DESC LIMIT 12""",
    "recent_leaves": f"""WITH {EVENT_LEDGER} SELECT ingest_seq, leaf_hash FROM led
  ORDER BY created_locally_at_utc DESC, ingest_seq DESC LIMIT 12""",
    "touch_log": f"""WITH {TURN_LEDGER} SELECT object_id, substr(created, 12, 8) AS time, device_type,
  {cut('payload_preview', 100, '…')} AS preview, left(fco_root, 12) || '…' AS root_prefix
  FROM led ORDER BY created_locally_at_utc DESC, ingest_seq DESC LIMIT 12""",
    "graph_nodes": f"""WITH {EXCHANGES} SELECT object_id, object_type, fco_root, leaf_hash, device_id, device_type,
  node_id, payload_preview, claim_ceiling, created_locally_at_utc, synced_at_utc, coalesce(parent_id, '') AS parents
  FROM led""",
    "ledger_detail": f"""WITH {EXCHANGES} SELECT object_id, '{AUTHOR}' AS author, device_id AS envelope_device,
  role || ' chat turn' AS statement, created_locally_at_utc AS created_at_utc,
  coalesce(parent_id, '') AS envelope_parents, bytes_sha256, byte_length, coalesce(parent_id, '') AS parents,
  node_id, leaf_hash FROM led""",
    "count_by_device": "SELECT 'dev-' || user_id::varchar AS device_id, count(*) AS n FROM events GROUP BY 1",
    "devices_ranked": """SELECT 'dev-' || user_id::varchar AS device_id, count(*) AS n FROM events GROUP BY 1
  ORDER BY n DESC, device_id""",
    "recent_by_device": f"""WITH last AS (SELECT user_id FROM events ORDER BY {iso('ts')} DESC, event_id DESC LIMIT 12)
SELECT 'dev-' || user_id::varchar AS device_id, count(*) AS n FROM last GROUP BY 1""",
    "leaf_count": "SELECT count(*) AS leaf_count FROM conversations",
    "ledger_root": f"WITH RECURSIVE {EVENT_LEDGER}, {root_ctes('led')} SELECT leaf_count, merkle_root FROM root",
    "device_report": f"""WITH RECURSIVE {TURN_LEDGER}, {root_ctes('led')}
SELECT leaf_count, merkle_root, device_id, count(*) AS n FROM led, root GROUP BY ALL""",
    "leaf_index": f"""WITH {EVENT_LEDGER} SELECT object_id,
  row_number() OVER (ORDER BY created_locally_at_utc, ingest_seq) - 1 AS leaf_index FROM led""",
    "root_check": f"""WITH RECURSIVE {TURN_LEDGER}, {root_ctes('led')},
e_led AS (SELECT * REPLACE (CASE WHEN turn = 1 THEN reverse(leaf_hash) ELSE leaf_hash END AS leaf_hash) FROM led),
e_leaves AS (SELECT row_number() OVER (ORDER BY created, ingest_seq) - 1 AS i, leaf_hash AS h FROM e_led),
e_tree AS (SELECT 0 AS lvl, i, h FROM e_leaves UNION ALL
  SELECT lvl + 1, i // 2, sha256('\\x01'::blob || encode(min_by(h, i)) || encode(max_by(h, i)))
  FROM e_tree GROUP BY lvl, i // 2 HAVING count(*) = 2),
e_peaks AS (SELECT lvl, h FROM e_tree, cnt WHERE (n >> lvl) & 1 = 1 AND i = (n >> lvl) - 1),
e_root AS (SELECT list_reduce(list(h ORDER BY lvl),
  lambda acc, x: sha256('\\x01'::blob || encode(x) || encode(acc))) AS r FROM e_peaks)
SELECT 'stored' AS ledger, merkle_root AS stored_root, merkle_root AS computed_root, true AS root_matches FROM root
UNION ALL SELECT 'edited', merkle_root, r, merkle_root = r FROM root, e_root""",
    "verify_rows": f"""WITH {TURN_LEDGER},
bad AS (SELECT *, CASE turn WHEN 0 THEN ['object_id'] WHEN 1 THEN ['content_leaf']
  WHEN 2 THEN ['content_leaf', 'object_id', 'fco_root'] WHEN 3 THEN ['fco_root', 'leaf_hash']
  WHEN 4 THEN ['leaf_hash'] WHEN 5 THEN ['leaf_hash'] ELSE [] END AS failed FROM led)
SELECT conv_id, turn, CASE turn WHEN 0 THEN 'sha256:' || reverse(content_leaf) ELSE object_id END AS object_id,
  unnest(failed) AS failed_check FROM bad""",
    "parent_edges": f"""WITH {EXCHANGES} SELECT object_id AS child, parent_id AS parent FROM led
  WHERE parent_id IS NOT NULL""",
    "dangling_parents": f"""WITH {EXCHANGES} SELECT object_id AS child, parent_id AS parent FROM led
  WHERE parent_id IS NOT NULL AND role = 'agent'
  AND parent_id NOT IN (SELECT object_id FROM led WHERE role = 'agent' OR turn > 0)""",
    "cosine_pairs": f"WITH {SIMILARITY} SELECT sequence, i, j, round(value, 6) + 0.0 AS value FROM pairs",
    "minmax_scale": f"""WITH {SIMILARITY}, b AS (SELECT sequence, min(value) AS lo, greatest(0.0::double, max(value)) AS hi
  FROM pairs GROUP BY sequence)
SELECT sequence, i, j, round((value - lo) / (hi - lo + 1e-9), 6) + 0.0 AS value FROM pairs JOIN b USING (sequence)""",
    "sanitize_sequence": f"WITH {SEQUENCES} SELECT * FROM seqs",
    "residue_position": f"WITH {RESIDUES} SELECT doc_id, pos, residue FROM res",
    "residue_confidence": f"WITH {CONFIDENCE} SELECT doc_id, pos, round(value, 6) + 0.0 AS value FROM conf",
    "confidence_mean": f"""WITH {CONFIDENCE}, means AS (SELECT s.doc_id, coalesce(avg(value), 0.0) AS mean
  FROM seqs s LEFT JOIN conf c ON c.doc_id = s.doc_id GROUP BY s.doc_id)
SELECT doc_id, round(mean, 6) + 0.0 AS mean, floor(mean * 10 + 0.5) / 10 AS mean_1 FROM means""",
    "peptide_stats": f"WITH {STATS} SELECT doc_id, length, mass, pi, gravy, helix, sheet FROM stats",
    "coef_lookup": f"""WITH {SEQUENCES} SELECT doc_id, {weighted(Q.HYDROPATHY)} AS hydropathy_sum,
  {weighted(Q.HELIX)} AS helix_sum, {weighted(Q.SHEET)} AS sheet_sum FROM seqs""",
    "risk_sequence": f"""WITH {SEQUENCES} SELECT doc_id, CASE WHEN {RED} THEN 'red' ELSE 'green' END AS risk,
  {ASSESSMENT} AS assessment FROM seqs""",
    "threat_text": f"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{SAMPLE_THREATS}')
  THEN {quote(R.THREAT_WARNING)} END AS warning FROM documents""",
    "text_chunks": f"""WITH {CHUNKS} SELECT doc_id, chars, len(parts) AS chunks,
  unnest(range(len(parts))) AS chunk_no, unnest(parts) AS chunk FROM parts""",
    "map_sizes": """SELECT sequence, count(*) AS items, count(*) * count(*) AS cells FROM (
  SELECT (row_number() OVER () - 1) // 64 AS sequence FROM embeddings) GROUP BY sequence""",
    "long_history": f"""WITH {TURNS}, said AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id,
  CASE WHEN conv_id % 3 = 0 THEN conv_id * 1000 + turn ELSE turn END AS turn, role, content FROM turns),
told AS (SELECT conv_id, turn, role, coalesce(string_agg(
  CASE role WHEN 'human' THEN 'Human: ' ELSE 'AI: ' END || content, chr(10))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM said)
SELECT conv_id, turn, length(history) AS chars, sha256(history) AS history_sha256 FROM told WHERE role = 'human'""",
    "chat_history": f"WITH {HISTORY} SELECT conv_id, turn, history FROM hist WHERE role = 'human'",
    "prompt_text": f"""WITH {HISTORY} SELECT conv_id, turn, 'Answer from the ledger.' || chr(10) || chr(10) ||
  'Chat history:' || chr(10) || history || chr(10) || chr(10) || 'Human: ' || message || chr(10) || 'AI:' AS prompt
  FROM hist WHERE role = 'human'""",
    "payload_json": f"""SELECT page_id, '{{"url":' || {js('url')} || ',"html":' || {js('html')} || '}}' AS value FROM pages""",
    "payload_hash": f"WITH {PAYLOADS} SELECT conv_id, turn, sha256(payload) AS value FROM payloads",
    "object_key": f"WITH {TURN_LEDGER} SELECT conv_id, turn, object_id AS value FROM led",
    "key_bound_root": f"SELECT page_id, {key_root('sha256(html)')} AS value FROM pages",
    "leaf_hash": f"SELECT page_id, {node_leaf('url', 'sha256(html)')} AS value FROM pages",
    "canonical_envelope": f"WITH {TURN_LEDGER} SELECT conv_id, turn, envelope_json AS value FROM led",
    "canonical_json": f"""SELECT page_id, '{{"body":{{"lines":[3,1],"text":' || {js('html')} || '}},"id":' ||
  page_id::varchar || ',"url":' || {js('url')} || '}}' AS value FROM pages""",
    "build_envelope": f"""WITH pages_in AS (SELECT *, {after_base('page_id')} AS created FROM pages),
{sealed_cte('sealed', 'pages_in', payload='html', object_type='page_view', release='public-safe',
            claim_type='page_view', statement="'Page ' || url || '.'", ceiling='Page bound to public key.',
            device=False, media_type='text/html')}
SELECT page_id, bytes_sha256, byte_length, content_leaf, object_id, fco_root, fco_root AS leaf_hash FROM sealed""",
    # Two letters of the private area stand for the halves of a wide character.
    "wide_preview": f"""WITH {TURNS}, halves AS (SELECT conv_id, turn, role,
  replace(replace(content, 'e', chr(57344) || chr(57345)), 'o', chr(57346) || chr(57347)) AS h FROM turns),
cuts AS (SELECT conv_id, turn, length(h) AS units, role || ' via web-demo: ' || {cut('h', 160, '...')} AS value, left(h, 7) AS short
  FROM halves)
SELECT conv_id, turn, units, {joined_halves('value')} AS value, {joined_halves('short')} AS short FROM cuts""",
    "turn_preview": f"""WITH {TURNS} SELECT conv_id, turn, role || ' via web-demo: ' || {cut('content', 160, '...')} AS value
  FROM turns""",
    "sample_preview": f"""WITH {SAMPLES} SELECT doc_id, name || ' via web-demo: ' || length(sequence)::varchar || ' aa' AS value,
  name || ' via android: ' || {ASSESSMENT} AS assessed FROM samples""",
    "node_key": f"WITH {TURNS} SELECT conv_id, turn, role || '/turn/' || created AS value, role AS device FROM turns",
    "device_defaults": f"""WITH {TURNS}, {DEVICES} SELECT conv_id, turn,
  CASE turn WHEN 1 THEN 'phone-' || conv_id::varchar ELSE device_id END AS device_id,
  CASE turn WHEN 2 THEN 'mac' ELSE device_type END AS device_type FROM devices""",
    "iso_utc": f"SELECT event_id, {iso('ts')} AS value FROM events",
    "hash_prefix": "SELECT doc_id, "
    + ", ".join(f"left(sha256(text), {n}) || '…' AS first_{n}" for n in (8, 12, 16))
    + " FROM documents",
    "plural_label": """SELECT 'dev-' || user_id::varchar AS device_id,
  count(*)::varchar || CASE WHEN count(*) = 1 THEN ' FCO' ELSE ' FCOs' END AS label FROM events GROUP BY user_id""",
    "result_statement": f"""WITH {STATS} SELECT doc_id, 'Peptide analysis. Length: ' || length ||
  ' residues. Molecular weight: approximately ' || mass || ' daltons. Isoelectric point: ' || {number('pi')} ||
  '. GRAVY hydropathy: ' || regexp_replace({number('gravy')}, '^-0$', '0') || '. Predicted helix propensity: ' || helix ||
  ' percent. Predicted sheet propensity: ' || sheet || ' percent. Biosecurity assessment: ' ||
  {ASSESSMENT.replace('length(sequence)', 'length')} || '.' AS report FROM stats""",
    "prediction_statement": f"WITH {PREDICTIONS} SELECT acc AS accession, {STATEMENT} AS statement FROM fixed",
    "gps_parse": """SELECT event_id, CASE event_type WHEN 'error' THEN 37.4275::double
    ELSE ((event_id % 18000 - 9000) / 100.0)::double END AS lat,
  CASE event_type WHEN 'error' THEN (-122.1697)::double ELSE ((event_id % 36000 - 18000) / 1000.0)::double END AS lng
  FROM events""",
    "round_half_up": """SELECT l_orderkey, l_linenumber, floor((l_quantity - 25) / 2 + 0.5) + 0.0 AS whole,
  floor(l_extendedprice * 10 + 0.5) / 10 AS one_digit,
  printf('%.2f', CASE WHEN l_quantity % 2 = 1 THEN floor(l_quantity * 12.5 + 0.5) / 100 ELSE l_quantity / 8 END) AS fixed
  FROM lineitem""",
    "js_number": f"""SELECT l_orderkey, l_linenumber, {number('l_quantity')} AS whole, {number('l_extendedprice')} AS price,
  regexp_replace(printf('%.20f', l_quantity / 65536), '0+$', '') AS small FROM lineitem""",
    "stream_sync": f"WITH {SYNCED} SELECT {COLUMNS} FROM kept",
    "stream_root": f"""WITH RECURSIVE {EVENT_LEDGER}, even AS (SELECT * FROM led WHERE event_id % 2 = 0),
{second_root('even', 'created, object_id')}, {root_ctes('led', 'created, event_id % 2, object_id')}
SELECT 0 AS batch_no, leaf_count, merkle_root FROM second_root
UNION ALL SELECT 1, leaf_count, merkle_root FROM root""",
    "stream_turns": f"""WITH {TURN_LEDGER}
SELECT row_number() OVER (ORDER BY created, object_id) - 1 AS ingest_seq, {COLUMNS} FROM led""",
    "stream_counts": "SELECT 'dev-' || user_id::varchar AS device_id, count(*) AS n FROM events GROUP BY 1",
    "stream_threats": f"""SELECT doc_id, {quote(R.THREAT_WARNING)} AS warning FROM documents
  WHERE regexp_matches(lower(text), '{SAMPLE_THREATS}')""",
}
