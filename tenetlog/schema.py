"""Column sets and closed vocabularies of a belief log."""

from __future__ import annotations

from pyspark.sql import types as T

ENVELOPE_FIELDS = (
    "event_id", "idempotency_key", "schema_version", "event_type", "occurred_at",
    "recorded_at", "source", "source_class", "origin_type", "payload_hash",
    "entity_refs", "prev_event_hash", "event_hash",
)
# Fields covered by the event hash, in canonical (alphabetical) order.
HASHED_FIELDS = tuple(sorted(set(ENVELOPE_FIELDS) - {"event_hash", "prev_event_hash"}))
REQUEST_FIELDS = (
    "event_id", "schema_version", "event_type", "occurred_at", "source",
    "source_class", "origin_type", "entity_refs",
)
POSITION_DERIVED = ("recorded_at", "prev_event_hash", "event_hash", "payload_hash", "idempotency_key")

EVENTS_SCHEMA = T.StructType(
    [T.StructField("log_position", T.LongType(), False), T.StructField("chain_id", T.LongType(), False)]
    + [T.StructField(name, T.StringType(), True) for name in ENVELOPE_FIELDS])
PAYLOADS_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("payload_hash", T.StringType(), True),
    T.StructField("canonical_entity_id", T.StringType(), True),
    T.StructField("ciphertext", T.StringType(), True),
    T.StructField("redacted", T.BooleanType(), False),
])

# Event schema version, event types, origins, states and labels.
EVENT_SCHEMA_VERSION = "0"
MENTION = "entity_mention_recorded"
OBSERVATION = "observation_recorded"
CORRECTION = "correction_appended"
REPLACEMENT = "candidate_replaced"
EXPIRY = "candidate_expired"
EVENT_TYPES = (
    "claim_asserted", "observation_recorded", "correction_appended", "candidate_replaced",
    "candidate_expired", "claim_questioned", "claim_quarantined", "claim_restored",
    "gap_recorded", "scope_mutated", "verification_requested", "verification_completed",
    "entity_mention_recorded", "entity_link_proposed", "entity_link_accepted",
    "entity_merge_accepted", "entity_split_asserted", "redaction_applied",
)
ORIGINS = ("observed", "user_stated", "verified_external", "derived", "personal")
VERIFIABILITY = ("externally_checkable", "locally_checkable", "subjective", "structurally_unverifiable")
STATES = ("unverified", "verified", "questioned", "quarantined", "superseded", "redacted")
RESOLUTION_BASIS = {
    OBSERVATION: "direct observation (world-oracle class, Inv. 4)",
    CORRECTION: "correction supersedes prior value (Inv. 6 superseding event)",
}
# Transition event -> (status of the ended candidate, relation name).
TRANSITIONS = {
    CORRECTION: ("corrected", "corrected_by"),
    REPLACEMENT: ("replaced", "replaced_by"),
    EXPIRY: ("expired", "expired_at"),
}
PROJECTORS = ("0", "1", "2", "3")
COLLECTIONS = ("claim_candidates", "event_dependencies", "identity_records")
RECORD_KINDS = ("beliefs", "entities", "mentions", "entity_links", "claim_candidates", "events")
INDEX_KINDS = RECORD_KINDS + ("current_beliefs",)
MAX_CLOCK_SKEW_SECONDS = 120

VIOLATION_COLUMNS = ("check", "location", "message")


class LogError(ValueError):
    """A log, request or view breaks the contract; carries example violations."""


class UnsupportedError(NotImplementedError):
    """The contract leaves the case undecided and refuses it."""


def require_projector(version, allowed=PROJECTORS):
    if not isinstance(version, str) or version not in allowed:
        raise ValueError(f"unsupported projector version: {version!r}")
    return version
