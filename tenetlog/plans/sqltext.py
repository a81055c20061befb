"""SQL forms of the derived logs, for comparing results in another engine."""

from __future__ import annotations


def quoted(expr: str) -> str:
    return f"""('"'||replace(replace({expr},'\\','\\\\'),'"','\\"')||'"')"""


def second_text(expr: str) -> str:
    return f"strftime(TIMESTAMP '2024-02-01 00:00:00' + to_seconds({expr}), '%Y-%m-%dT%H:%M:%SZ')"


# Positions and columns of the value requests; {correction}, {label} and {origin} vary.
_VALUE = """
src AS (SELECT event_id AS n, event_id+1 AS log_position, user_id, 'u'||user_id AS actor,
  'user:'||user_id||'/property:'||event_type AS belief_id,
  CAST(CAST(floor(value*100) AS BIGINT) AS VARCHAR) AS value,
  {label} AS verifiability, {origin} AS origin_type,
  CASE WHEN {correction} THEN 'correction_appended' ELSE 'observation_recorded' END AS event_type,
  date_trunc('second', ts - to_hours(CAST(event_id % 7 AS INTEGER))) AS occ FROM events),
rows_ AS (SELECT *, 'e-'||n AS event_id, '0' AS schema_version, 'class'||(n%3) AS source_class,
  CASE n%4 WHEN 0 THEN strftime(occ,'%Y-%m-%dT%H:%M:%S')||'Z' WHEN 1 THEN strftime(occ,'%Y-%m-%dT%H:%M:%S')||'+00:00'
    WHEN 2 THEN strftime(occ + INTERVAL 345 MINUTE,'%Y-%m-%dT%H:%M:%S')||'+05:45'
    ELSE strftime(occ - INTERVAL 330 MINUTE,'%Y-%m-%dT%H:%M:%S')||'-05:30' END AS occurred_at,
  epoch_us(occ) AS occurred_us, """ + second_text("n//2") + """ AS recorded_at,
  epoch_us(TIMESTAMP '2024-02-01 00:00:00') + (n//2)*1000000 AS recorded_us,
  '{{"actor_id":"'||actor||'","config":{{}}}}' AS source, CAST(NULL AS VARCHAR) AS entity_refs,
  '{{"belief_id":"'||belief_id||'","value":"'||value||'","verifiability":"'||verifiability||'"}}' AS ciphertext FROM src)"""

_LABEL = "(['externally_checkable','locally_checkable','subjective','structurally_unverifiable'])[event_id%4+1]"
VALUE_ROWS = _VALUE.format(correction="event_id%14=0", label=_LABEL, origin="'observed'")
SUBMITTED_ROWS = _VALUE.format(
    correction="event_id%5=4", label=f"CASE WHEN event_id%97=13 THEN 'unknowable' ELSE {_LABEL} END",
    origin="CASE WHEN event_id%89=7 THEN 'user_stated' ELSE 'observed' END")

# From rows_ to log: hashes, keys and links in chains of 64 positions.
HASHED = """,
keyed AS (SELECT *, sha256(ciphertext) AS payload_hash, sha256(actor||chr(31)||occurred_at||chr(31)||ciphertext) AS idempotency_key,
  (log_position-1)//64 AS chain_id FROM rows_),
mat AS (SELECT *, '{"entity_refs":'||coalesce(""" + quoted("entity_refs") + """,'null')||',"event_id":"'||event_id||'","event_type":"'||event_type
  ||'","idempotency_key":"'||idempotency_key||'","occurred_at":"'||occurred_at||'","origin_type":"'||origin_type
  ||'","payload_hash":"'||payload_hash||'","recorded_at":"'||recorded_at||'","schema_version":"0","source":'||""" + quoted("source") + """
  ||',"source_class":"'||source_class||'"}' AS material FROM keyed),
chains AS (SELECT chain_id, list_reduce(list(material ORDER BY log_position), lambda a,x: a||sha256(x||right(a,64)), '') AS links
  FROM mat GROUP BY chain_id),
log AS (SELECT mat.*, substr(links, CAST((log_position-1)%64*64+1 AS BIGINT), 64) AS event_hash,
  CASE WHEN (log_position-1)%64>0 THEN substr(links, CAST((log_position-1)%64*64-63 AS BIGINT), 64) END AS prev_event_hash
  FROM mat JOIN chains USING (chain_id))"""
VALUE_LOG = VALUE_ROWS + HASHED

_MENTIONS = """
SELECT c_custkey+1 AS log_position, 'em-'||c_custkey AS event_id, 'nation-'||c_nationkey AS actor, 'entity_mention_recorded' AS event_type,
  'register' AS source_class, '["s-'||c_custkey||'"]' AS entity_refs,
  '{"link_state":"constitutive","mention_id":"m-'||c_custkey||'","subject_id":"s-'||c_custkey||'","text":'||""" + quoted("c_name") + """||'}' AS ciphertext
FROM customer"""

ORDERS = """
ord AS (SELECT (SELECT count(*) FROM customer)+o_orderkey+1 AS log_position, o_orderkey AS n, o_custkey AS cust, o_orderpriority AS prio,
  CAST(CAST(floor(o_totalprice*100) AS BIGINT) AS VARCHAR) AS cents, 'eo-'||o_orderkey AS event_id,
  CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '3' END AS status_code FROM orders)"""


def _claim(ordinal, prop, suffix, value, extra=""):
    return (f"""'{{"belief_id":"b-'||cust||'-'||{suffix}||'","claim_candidate_id":"c-'||n||'-{ordinal}","mention_id":"m-'||cust"""
            f"""||'","property_id":"'||{prop}||'","subject_id":"s-'||cust||'","value":'||{value}||',"verifiability":"externally_checkable"}}'{extra}""")


_PRICE = _claim(1, "prio", "prio", "'\"'||cents||'\"'")
_STATUS = _claim(2, "'status'", "'status'", "status_code")


def _events(select_orders: str) -> str:
    return f"""
base_ AS ({_MENTIONS} UNION ALL {select_orders}),
rows_ AS (SELECT *, '0' AS schema_version, 'observed' AS origin_type, {second_text('log_position')} AS occurred_at,
  {second_text('log_position')} AS recorded_at, '{{"actor_id":"'||actor||'","config":{{}}}}' AS source FROM base_)"""


IDENTITY_ROWS = ORDERS + "," + _events(f"""
SELECT log_position, event_id, 'desk-'||prio[1], 'observation_recorded', 'order_book', CAST(NULL AS VARCHAR),
  '{{"claims":['||{_PRICE}||CASE WHEN n%3=0 THEN ','||{_STATUS} ELSE '' END||']}}' FROM ord""")
IDENTITY_LOG = IDENTITY_ROWS + HASHED
# One row per claim of the identity log.
CLAIMS = """,
claims AS (SELECT log_position, event_id, 0 AS ordinal, n, cust, 'c-'||n||'-1' AS claim_candidate_id, 'b-'||cust||'-'||prio AS belief_id,
    prio AS property_id, '"'||cents||'"' AS value_json, 'm-'||cust AS mention_id, 's-'||cust AS subject_id, prio FROM ord
  UNION ALL SELECT log_position, event_id, 1, n, cust, 'c-'||n||'-2', 'b-'||cust||'-status', 'status', status_code,
    'm-'||cust, 's-'||cust, prio FROM ord WHERE n%3=0)"""
MENTIONS = """,
men AS (SELECT 'm-'||c_custkey AS mention_id, 's-'||c_custkey AS subject_id, c_name AS text, 'em-'||c_custkey AS event_id,
  c_custkey+1 AS log_position FROM customer)"""

# Sequence rules of the transition log. {follow} turns what follows an expiry
# into a plain observation (valid log) or leaves the rule in force (submissions).
_SEQ = ORDERS + """,
seqd AS (SELECT *, row_number() OVER w AS seq, lag(n) OVER w AS prior FROM ord WINDOW w AS (PARTITION BY cust, prio ORDER BY n)),
kinds AS (SELECT *, CASE WHEN seq=1 {follow} THEN 'observation_recorded' WHEN seq%7=0 THEN 'candidate_expired'
  WHEN seq%4=0 THEN 'candidate_replaced' WHEN seq%5=0 THEN 'correction_appended' ELSE 'observation_recorded' END AS kind FROM seqd)"""
TRANSITION_KINDS = _SEQ.replace("{follow}", "OR (seq>7 AND (seq-1)%7=0)")
SUBMITTED_KINDS = _SEQ.replace("{follow}", "")
_BODY = f"""CASE kind WHEN 'observation_recorded' THEN '{{"claims":['||{_PRICE}||']}}'
  WHEN 'candidate_expired' THEN '{{"basis":{{"kind":"stated","statement":"superseded by a later order"}},"belief_id":"b-'||cust||'-'||prio||'","targets":["c-'||prior||'-1"]}}'
  WHEN 'candidate_replaced' THEN '{{"basis":{{"kind":"stated","statement":"superseded by a later order"}},"claim":'||{_PRICE}||',"targets":["c-'||prior||'-1"]}}'
  ELSE '{{"basis":{{"kind":"stated_error","statement":"entry error"}},"claim":'||{_PRICE}||',"targets":["c-'||prior||'-1"]}}' END"""
TRANSITION_ROWS = TRANSITION_KINDS + "," + _events(f"""
SELECT log_position, event_id, 'desk-'||prio[1], kind, 'order_book', CAST(NULL AS VARCHAR), {_BODY} FROM kinds""")
TRANSITION_LOG = TRANSITION_ROWS + HASHED
# Candidates and their endings.
ENDINGS = """,
cands AS (SELECT 'c-'||n||'-1' AS claim_candidate_id, 'b-'||cust||'-'||prio AS belief_id, log_position, event_id, cust, prio FROM kinds
  WHERE kind<>'candidate_expired'),
rel AS (SELECT 'c-'||prior||'-1' AS target_candidate_id, event_id, CASE kind WHEN 'correction_appended' THEN 'corrected_by'
  WHEN 'candidate_replaced' THEN 'replaced_by' ELSE 'expired_at' END AS relation, log_position FROM kinds WHERE kind<>'observation_recorded')"""


def with_(*parts: str) -> str:
    return "WITH " + "".join(parts).lstrip()
