"""Queries over identity and transition logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenetlog.operators import admission, audit, freshness, identity, integrity, reads, signals, transitions
from tenetlog.plans import sqltext as S
from tenetlog.plans.registry import END, LATE, registry
from tenetlog.session import cut_lineage, scratch_path
from tenetlog.sources import adapt, log as L, store

W = S.with_
IR, CL, ME = S.IDENTITY_ROWS, S.IDENTITY_ROWS + S.CLAIMS, "men AS (" + S.MENTIONS.split("men AS (", 1)[1]
TK, TE = S.TRANSITION_KINDS, S.TRANSITION_KINDS + S.ENDINGS


def _rows(spark, d):
    return adapt.identity_requests(spark, d).withColumn("event_hash", F.lit(""))


def _transitions(spark, d, **kw):
    return adapt.transition_requests(spark, d, **kw).withColumn("event_hash", F.lit(""))


@registry.add("mention_requests", W(IR, " SELECT event_id, entity_refs, ciphertext FROM rows_ WHERE event_type='entity_mention_recorded'"))
def mention_requests(spark, d):
    """Mention requests prepared from a register of names."""
    rows = adapt.table(spark, d, "customer").select(
        F.concat(F.lit("m-"), F.col("c_custkey").cast("string")).alias("mention_id"),
        F.concat(F.lit("s-"), F.col("c_custkey").cast("string")).alias("subject_id"), F.col("c_name").alias("text"))
    made = L.prepare_mentions(rows, actor_id=F.lit("register"), source_class=F.lit("register"), occurred_at=F.lit(LATE),
                              event_id=F.concat(F.lit("e"), "mention_id"))
    return made.select("event_id", "entity_refs", "ciphertext")


@registry.add("observation_requests", W(CL, """ SELECT claim_candidate_id, CASE WHEN n%5=0 THEN CASE WHEN n%3=0 THEN NULL ELSE 'own-'||n END ELSE belief_id END AS belief_id,
 CASE WHEN n%5=0 THEN CASE WHEN n%3=0 THEN 'new belief requires a retained recorded belief_id' END
 WHEN n%3=1 THEN 'submitted belief_id differs from current belief' END AS problem FROM claims WHERE ordinal=0"""))
def observation_requests(spark, d):
    """Claims completed with the current belief of their pair, or refused."""
    log = _rows(spark, d)
    n = F.split(F.col("event_id"), "-")[1].cast("long")
    claims = identity.claims(log).where("ordinal = 0").select(
        "claim_candidate_id", "subject_id", F.when(n % 5 == 0, "unheard of").otherwise(F.col("property_id")).alias("property_id"),
        F.when(n % 3 == 0, F.lit(None)).when(n % 5 == 0, F.concat(F.lit("own-"), n.cast("string")))
        .when(n % 3 == 1, F.concat(F.lit("own-"), n.cast("string"))).otherwise(F.col("belief_id")).alias("belief_id"))
    return L.prepare_observations(claims, identity.current_beliefs(log)).select("claim_candidate_id", "belief_id", "problem")


@registry.add("entities_and_links", W(ME, """ SELECT subject_id, mention_id, text, event_id, 'current' AS lifecycle_status, 'constitutive' AS link_state
 FROM men"""))
def entities_and_links(spark, d):
    """Entities, mentions and constitutive links of mention events."""
    log = _rows(spark, d)
    e = identity.entity_table(log).select("subject_id", "lifecycle_status", F.col("constituting_mention_id").alias("mention_id"))
    m = identity.mention_table(log).select("mention_id", "text", "event_id")
    k = identity.link_table(log).select("mention_id", "link_state")
    return e.join(m, "mention_id").join(k, "mention_id")


@registry.add("claim_candidates", W(CL, """ SELECT claim_candidate_id, belief_id, mention_id, subject_id, property_id, value_json, event_id AS supporting,
 'em-'||cust AS link_event_id, 'verified' AS verification_state, log_position, ordinal FROM claims"""))
def claim_candidates(spark, d):
    """Every claim candidate with its value, support and provenance."""
    return identity.candidates(_rows(spark, d)).select(
        "claim_candidate_id", "belief_id", "mention_id", "subject_id", "property_id", "value_json",
        F.array_join("supporting_events", " ").alias("supporting"), "link_event_id", "verification_state", "log_position", "ordinal")


@registry.add("belief_containers", W(CL, """ SELECT belief_id, min(subject_id) AS subject_id, min(property_id) AS property_id, count(*) AS candidate_count,
 count(DISTINCT event_id) AS evidence_count, count(DISTINCT mention_id) AS identity_count, max(log_position) AS last_position FROM claims GROUP BY belief_id"""))
def belief_containers(spark, d):
    """Belief headers: container, counts of candidates, evidence and identities."""
    log = _rows(spark, d)
    last = identity.claims(log).groupBy("belief_id").agg(F.max("log_position").alias("last_position"))
    return identity.beliefs(log, LATE).select(
        "belief_id", "subject_id", "property_id", "candidate_count", "evidence_count", "identity_count").join(last, "belief_id")


@registry.add("transition_beliefs", W(TK, """, t AS (SELECT 'b-'||cust||'-'||prio AS belief_id, cust, prio, n, kind, log_position FROM kinds)
 SELECT belief_id, 's-'||min(cust) AS subject_id, min(prio) AS property_id, count(*) FILTER (kind<>'candidate_expired') AS candidate_count,
 max(log_position) AS last_position FROM t GROUP BY belief_id"""))
def transition_beliefs(spark, d):
    """Headers of a log with transitions; an expiry moves their time too."""
    log = _transitions(spark, d)
    at = log.select("recorded_at", F.col("log_position").alias("last_position"))     # one recorded time for each position
    return identity.beliefs(log, LATE, "3").join(at, F.col("updated_at") == F.col("recorded_at")).select(
        "belief_id", "subject_id", "property_id", "candidate_count", "last_position")


@registry.add("transition_dependencies", W(TK, """ SELECT 'b-'||cust||'-'||prio AS belief_id, event_id FROM kinds
 UNION SELECT 'b-'||cust||'-'||prio, 'em-'||cust FROM kinds WHERE kind<>'candidate_expired'"""))
def transition_dependencies(spark, d):
    """Events each belief depends on, expiries among them."""
    return identity.dependencies(_transitions(spark, d), "3")


@registry.add("unsupported_publication", W(TK, """ SELECT '0' AS projector, CAST(0 AS BIGINT) AS reached, (SELECT count(*) FROM customer)
 +(SELECT count(*) FROM kinds WHERE kind IN ('candidate_replaced','candidate_expired')) AS refused
 UNION ALL SELECT '1', (SELECT min(log_position)-1 FROM kinds WHERE kind<>'observation_recorded'),
 (SELECT count(*) FROM kinds WHERE kind<>'observation_recorded')"""))
def unsupported_publication(spark, d):
    """A log with transitions under projectors that do not support all its types: publication stops before the first."""
    kept, found = store.LogStore(spark, scratch_path(spark, "store")), []
    kept.write_log(adapt.transition_log(spark, d))      # one log for both: each projector publishes for itself
    for projector in ("0", "1"):
        reached = kept.publish(END, projector)
        refused = integrity.unsupported_events(kept.log(), reads.SUPPORTED[projector], projector)
        found.append(refused.agg(F.lit(projector).alias("projector"), F.lit(reached).cast("long").alias("reached"), F.count(F.lit(1)).alias("refused")))
    return found[0].unionByName(found[1])


@registry.add("long_text_mentions", """SELECT 'm-'||doc_id AS event_id, 'accepted' AS status, 0 AS problems FROM documents""")
def long_text_mentions(spark, d):
    """Mentions with whole document texts pass admission."""
    docs = adapt.table(spark, d, "documents").select(
        F.concat(F.lit("m-"), F.col("doc_id").cast("string")).alias("mention_id"),
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("subject_id"), "text", "doc_id")
    made = L.prepare_mentions(docs, actor_id=F.lit("reader"), source_class=F.lit("corpus"), occurred_at=F.lit(LATE),
                              event_id=F.col("mention_id")).withColumn("log_position", F.col("doc_id") + 1)
    verdicts = admission.admit(made.select("log_position", *L.REQUEST_FIELDS, "canonical_entity_id", "ciphertext", "redacted"), "1")
    return verdicts.select("event_id", "status", F.size("problems").alias("problems"))


@registry.add("evidence_sets", W(CL, " SELECT belief_id, count(DISTINCT event_id) AS evidence_count FROM claims GROUP BY belief_id"))
def evidence_sets(spark, d):
    """Distinct supporting events per belief."""
    return identity.evidence(identity.candidates(_rows(spark, d)))


@registry.add("event_dependencies", W(CL, " SELECT belief_id, event_id FROM claims UNION SELECT belief_id, 'em-'||cust FROM claims"))
def event_dependencies(spark, d):
    """Events each belief depends on."""
    return identity.dependencies(_rows(spark, d))


@registry.add("current_beliefs", W(CL, " SELECT subject_id, property_id, arg_min(belief_id, log_position) AS belief_id FROM claims GROUP BY subject_id, property_id"))
def current_beliefs(spark, d):
    """Current belief of each subject and property."""
    return identity.current_beliefs(_rows(spark, d))


@registry.add("container_conflicts", W(CL, """ SELECT '["'||subject_id||'","'||property_id||'"]' AS location FROM claims WHERE cust%7=2
 GROUP BY subject_id, property_id"""))
def container_conflicts(spark, d):
    """Pairs with two current beliefs in a damaged view."""
    view = identity.beliefs(_rows(spark, d), LATE)
    twin = view.where(F.substring("subject_id", 3, 20).cast("long") % 7 == 2).withColumn("belief_id", F.concat("belief_id", F.lit("x")))
    return identity.container_conflicts(view.unionByName(twin)).select("location")


@registry.add("unequal_candidate_records", W(CL, " SELECT claim_candidate_id AS location FROM claims WHERE n%41=3"))
def unequal_candidate_records(spark, d):
    """Records of one candidate that differ in more than provenance."""
    c = identity.candidates(_rows(spark, d))
    n = F.split("claim_candidate_id", "-")[1].cast("long")
    base = c.select("claim_candidate_id", F.col("value_json").alias("content"), F.col("event_id").alias("path"), n.alias("n"))
    again = base.where("n % 3 = 0 or n % 41 = 3").withColumn("path", F.lit("other")).withColumn(
        "content", F.when(F.col("n") % 41 == 3, "changed").otherwise(F.col("content")))
    return identity.merge_candidates(base.unionByName(again))[1].select("location")


@registry.add("identity_ceiling_problems", W(ME, """ SELECT mention_id AS location, CASE WHEN log_position%43=4 THEN 'non-constitutive confidence treatment is not decided'
 ELSE 'constitutive links have no epistemic confidence' END AS message FROM men WHERE log_position%43=4 OR log_position%47=5 AND log_position%43<>4
 UNION ALL SELECT mention_id, 'constitutive links have no epistemic confidence' FROM men WHERE log_position%43=4 AND log_position%47=5"""))
def identity_ceiling_problems(spark, d):
    """Links whose confidence treatment is undecided or inconsistent."""
    p = F.col("log_position")
    links = identity.link_table(_rows(spark, d)).withColumn("link_state", F.when(p % 43 == 4, "proposed").otherwise(F.col("link_state"))).withColumn(
        "entity_link_confidence", F.when(p % 47 == 5, 0.5))
    return identity.identity_ceiling(links).select("location", "message")


@registry.add("subject_reference_mismatch", W(CL, " SELECT event_id AS location FROM claims WHERE ordinal=0 AND n%53=6"))
def subject_reference_mismatch(spark, d):
    """Events whose entity_refs differ from the subjects they touch."""
    rows = _rows(spark, d)
    n = F.split("event_id", "-")[1].cast("long")
    own = F.concat(F.lit('["s-'), F.get_json_object("ciphertext", "$.claims[0].mention_id").substr(3, 20), F.lit('"]'))
    refs = F.when(F.col("event_type") != "observation_recorded", F.col("entity_refs")).when(n % 53 == 6, '["s-none"]').when(n % 2 == 0, own)
    return identity.refs_match(rows.withColumn("entity_refs", refs)).select("location")




@registry.add("identity_admission")
def identity_admission(spark, d):
    """Admission of identity requests with wrong associations, reused candidates and
    rebound containers; verdicts depend on earlier verdicts."""
    rows = adapt.identity_requests(spark, d)
    return admission.admit(_damaged(rows), "1").select("log_position", "event_id", "status")


def _damaged(rows):
    n = F.split("event_id", "-")[1].cast("long")
    order = F.col("event_type") == "observation_recorded"
    text = F.col("ciphertext")
    text = F.when(order & (n % 59 == 7), F.regexp_replace(text, r'"belief_id":"b-(\d+)-[^"]*"', r'"belief_id":"x-$1"')).otherwise(text)
    text = F.when(order & (n % 61 == 8), F.regexp_replace(text, r'"claim_candidate_id":"c-\d+-1"', F.concat(
        F.lit('"claim_candidate_id":"c-'), (n - 1).cast("string"), F.lit('-1"')))).otherwise(text)
    text = F.when(order & (n % 67 == 9), F.replace(text, F.lit('"mention_id":"m-'), F.lit('"mention_id":"m-none-'))).otherwise(text)
    text = F.when(order & (n % 71 == 10), F.replace(text, F.lit("externally_checkable"), F.lit("unknowable"))).otherwise(text)
    return rows.withColumn("ciphertext", text)


@registry.add("association_refusals", W(S.ORDERS, " SELECT 'eo-'||n AS event_id FROM ord WHERE n%67=9 OR n%71=10"))
def association_refusals(spark, d):
    """Requests refused for an unknown mention or label."""
    rows = adapt.identity_requests(spark, d)
    n = F.split("event_id", "-")[1].cast("long")
    damaged = rows.withColumn("ciphertext", F.when((F.col("event_type") == "observation_recorded") & (n % 67 == 9), F.replace(
        "ciphertext", F.lit('"mention_id":"m-'), F.lit('"mention_id":"m-none-'))).when(
        (F.col("event_type") == "observation_recorded") & (n % 71 == 10),
        F.replace("ciphertext", F.lit("externally_checkable"), F.lit("unknowable"))).otherwise(F.col("ciphertext")))
    return admission.admit(damaged, "1").where("status = 'refused'").select("event_id")


@registry.add("transition_admission", "WITH RECURSIVE " + (S.SUBMITTED_KINDS + """,
r AS (SELECT cust, prio, seq, event_id, kind, true AS ok, true AS made FROM kinds WHERE seq=1
 UNION ALL SELECT k.cust, k.prio, k.seq, k.event_id, k.kind, k.kind='observation_recorded' OR r.made,
  k.kind='observation_recorded' OR (k.kind<>'candidate_expired' AND r.made) FROM kinds k JOIN r ON k.cust=r.cust AND k.prio=r.prio
  AND k.seq=r.seq+1)
 SELECT event_id, CASE WHEN ok THEN 'accepted' ELSE 'refused' END AS status FROM r""").lstrip())
def transition_admission(spark, d):
    """Admission of transitions: a refused event's candidate cannot be targeted later."""
    rows = adapt.transition_requests(spark, d, submitted=True)
    return admission.admit(rows, "3").where("event_id like 'eo-%'").select("event_id", "status")


@registry.add("candidate_relations", W(TE, " SELECT target_candidate_id, event_id, relation, log_position FROM rel"))
def candidate_relations(spark, d):
    """Ending of each ended candidate: event, relation and position."""
    return transitions.relations(_transitions(spark, d))


@registry.add("candidate_endings", W(TE, """ SELECT claim_candidate_id, c.belief_id, coalesce(CASE relation WHEN 'corrected_by' THEN 'corrected' WHEN 'replaced_by' THEN 'replaced'
 WHEN 'expired_at' THEN 'expired' END,'live') AS live_status, r.event_id AS ending_event_id, r.log_position AS ending_position FROM cands c
 LEFT JOIN rel r ON r.target_candidate_id=c.claim_candidate_id"""))
def candidate_endings(spark, d):
    """Candidates with live status and ending event."""
    return transitions.candidates_with_endings(_transitions(spark, d)).select(
        "claim_candidate_id", "belief_id", "live_status", "ending_event_id", "ending_position")


@registry.add("live_and_retained", W(TE, """ SELECT c.belief_id, count(*) FILTER (relation IS NULL) AS live, count(*) FILTER (relation IS NOT NULL) AS retained
 FROM cands c LEFT JOIN rel r ON r.target_candidate_id=c.claim_candidate_id GROUP BY c.belief_id"""))
def live_and_retained(spark, d):
    """Sizes of the live and retained sets of every belief."""
    return transitions.set_sizes(transitions.candidates_with_endings(_transitions(spark, d)))


@registry.add("transition_targets", W(TK, " SELECT event_id, 'c-'||prior||'-1' AS target_candidate_id, kind AS event_type FROM kinds WHERE kind<>'observation_recorded'"))
def transition_targets(spark, d):
    """Targets of every transition, with eligibility judged at its position."""
    return transitions.target_verdicts(_transitions(spark, d)).where(F.size("problems") == 0).select(
        "event_id", "target_candidate_id", "event_type")


@registry.add("dependency_refusals", W(TE, " SELECT DISTINCT target_candidate_id FROM rel WHERE CAST(split_part(target_candidate_id,'-',2) AS BIGINT)%5=1"))
def dependency_refusals(spark, d):
    """Targets that another candidate names as predecessor: their ending is undecided."""
    log = _transitions(spark, d)
    own = F.split("claim_candidate_id", "-")[1].cast("long") % 5 == 1
    named = identity.candidates(log, "3").withColumn("predecessors", F.when(own, F.array("claim_candidate_id")).otherwise(F.col("predecessors")))
    return transitions.reverse_dependencies(named, transitions.relations(log).select("target_candidate_id"))


@registry.add("ending_violations", W(TE, """ SELECT claim_candidate_id AS location FROM cands c JOIN rel r ON r.target_candidate_id=c.claim_candidate_id WHERE r.log_position%6=0"""))
def ending_violations(spark, d):
    """Candidates that a damaged relation table contradicts."""
    cands = transitions.candidates_with_endings(_transitions(spark, d))
    stored = transitions.relations(_transitions(spark, d)).where("log_position % 6 <> 0")
    return transitions.ending_violations(cands, stored).select("location")


@registry.add("relation_audit", W(TE, """ SELECT target_candidate_id AS location, 'recorded transition has no stored relation' AS message FROM rel WHERE log_position%6=0
 UNION ALL SELECT claim_candidate_id, 'candidate ending relation is missing' FROM cands c JOIN rel r ON r.target_candidate_id=c.claim_candidate_id WHERE r.log_position%6=0"""))
def relation_audit(spark, d):
    """Stored relations against recorded transitions."""
    log = cut_lineage(_transitions(spark, d))
    return audit.relation_audit(log, transitions.relations(log).where("log_position % 6 <> 0")).select("location", "message")


_SUBJECT = """, t AS (SELECT 's-'||c_custkey AS subject_id, c_custkey+1 AS p FROM customer UNION ALL SELECT 's-'||cust, log_position FROM kinds)"""


@registry.add("latest_event_per_subject", W(TK, _SUBJECT, " SELECT subject_id, max(p) AS log_position FROM t GROUP BY subject_id"))
def latest_event_per_subject(spark, d):
    """Append-side freshness: latest event of each subject, expiries included."""
    return freshness.latest_by_subject(_transitions(spark, d)).select("subject_id", "latest.log_position")


_H = "(SELECT (count(*)+(SELECT count(*) FROM customer))//2 FROM orders)"


def _half(log):
    cut = log.agg(F.floor(F.max("log_position") / 2).alias("_half"))
    prefix = log.crossJoin(F.broadcast(cut)).where(F.col("log_position") <= F.col("_half")).drop("_half")  # one row
    return prefix, L.tip(prefix).select("log_position", "event_id")


@registry.add("belief_status", W(CL, f""", st AS (SELECT 's-'||c_custkey AS subject_id, c_custkey+1 AS p FROM customer UNION ALL SELECT 's-'||cust, log_position FROM ord),
 ls AS (SELECT subject_id, max(p) AS latest_position FROM st GROUP BY 1)
 SELECT belief_id, min(claims.subject_id) AS subject_id, min(log_position)<={_H} AS present, max(latest_position) AS latest_position,
 max(latest_position)>{_H} AS stale FROM claims JOIN ls ON ls.subject_id=claims.subject_id GROUP BY belief_id"""))
def belief_status(spark, d):
    """Beliefs of a half-published view with progress and their subject's latest event."""
    log = cut_lineage(_rows(spark, d))
    prefix, progress = _half(log)
    view = identity.beliefs(prefix, LATE).select("belief_id", "subject_id", "property_id")
    names = identity.claims(log).select("belief_id")
    return freshness.belief_status(log, view, progress, names).select("belief_id", "subject_id", "present", "latest_position", "stale")


@registry.add("mention_status", W(ME, f""", st AS (SELECT 's-'||c_custkey AS subject_id, c_custkey+1 AS p FROM customer UNION ALL SELECT 's-'||o_custkey,
 (SELECT count(*) FROM customer)+o_orderkey+1 FROM orders), ls AS (SELECT subject_id, max(p) AS latest_position FROM st GROUP BY 1)
 SELECT mention_id, CASE WHEN log_position%3=0 THEN (SELECT max(p) FROM st) ELSE latest_position END AS latest_position,
 CASE WHEN log_position%3=0 THEN true ELSE latest_position>{_H} END AS stale,
 CASE WHEN log_position%3=0 THEN 'log' ELSE 'subject' END AS freshness_scope FROM men JOIN ls USING (subject_id)"""))
def mention_status(spark, d):
    """Mentions of a half-published view; absent ones are judged against the whole log."""
    log = cut_lineage(_rows(spark, d))
    _, progress = _half(log)
    stored = identity.mention_table(log).where("log_position % 3 <> 0").select("mention_id", "subject_id", "event_id")
    return freshness.identity_status(log, stored, progress, identity.mention_table(log), "mention_id").select(
        "mention_id", "latest_position", "stale", "freshness_scope")


@registry.add("candidate_values", W(CL, " SELECT claim_candidate_id, value_json FROM claims WHERE property_id='status'"))
def candidate_values(spark, d):
    """Values of named candidates, exact JSON kept."""
    cands = identity.candidates(_rows(spark, d))
    return reads.candidate_values(cands, cands.where("property_id = 'status'"))


@registry.add("subject_beliefs", W(CL, " SELECT DISTINCT belief_id, property_id FROM claims WHERE subject_id='s-7'"))
def subject_beliefs(spark, d):
    """Beliefs of one named subject."""
    return reads.of_subject(identity.beliefs(_rows(spark, d), LATE), "s-7").select("belief_id", "property_id")


@registry.add("current_belief_lookup", W(CL, " SELECT DISTINCT belief_id, subject_id FROM claims WHERE property_id='status'"))
def current_belief_lookup(spark, d):
    """Current beliefs of named subject/property pairs; duplicates would refuse."""
    log = _rows(spark, d)
    pairs = identity.claims(log).where("property_id = 'status'").select("subject_id", "property_id")
    return reads.current_belief(identity.beliefs(log, LATE), pairs).select("belief_id", "subject_id")


@registry.add("first_occurrences", W(CL, " SELECT belief_id, min(log_position) AS log_position FROM claims GROUP BY belief_id"))
def first_occurrences(spark, d):
    """Event that first used each belief ID."""
    return identity.claims(_rows(spark, d)).groupBy("belief_id").agg(F.min("log_position").alias("log_position"))


@registry.add("projector_equivalence", W(S.ORDERS, " SELECT 'c-'||n||'-1' AS location FROM ord WHERE n%73=11"))
def projector_equivalence(spark, d):
    """Candidates on which projectors 2 and 3 disagree (values changed on purpose)."""
    log = _rows(spark, d)
    two = identity.candidates(log, "2")
    n = F.split("claim_candidate_id", "-")[1].cast("long")
    three = transitions.candidates_with_endings(log).select(*two.columns).withColumn(
        "value_json", F.when((n % 73 == 11) & F.col("claim_candidate_id").endswith("-1"), "0").otherwise(F.col("value_json")))
    return reads.differences(two, three, "claim_candidate_id", "equivalence").select("location")


@registry.add("equivalence_history", W(S.ORDERS, " SELECT 'x' AS location WHERE false"))
def equivalence_history(spark, d):
    """Disagreements of projectors 2 and 3 before the first transition: none."""
    return audit.equivalence_history(cut_lineage(_transitions(spark, d))).select("location")


@registry.add("incremental_identity", W(TE, """ SELECT claim_candidate_id, c.belief_id, c.log_position, 'Customer#'||lpad(CAST(c.cust AS VARCHAR),9,'0') AS mention_text,
 r.relation FROM cands c LEFT JOIN rel r ON r.target_candidate_id=c.claim_candidate_id"""))
def incremental_identity(spark, d):
    """Identity tables published in two steps."""
    log = cut_lineage(_transitions(spark, d))
    half = log.agg(F.floor(F.max("log_position") / 2)).first()[0]
    one = {k: cut_lineage(v) for k, v in store.merge_identity({}, log.where(F.col("log_position") <= half), "3").items()}
    two = store.merge_identity(one, log.where(F.col("log_position") > half), "3")
    ends = two["relations"].select(F.col("target_candidate_id").alias("claim_candidate_id"), "relation")
    return two["claim_candidates"].select("claim_candidate_id", "belief_id", "log_position", "mention_text").join(
        ends, "claim_candidate_id", "left")


@registry.add("listed_subjects", W(ME, " SELECT subject_id FROM men ORDER BY encode(subject_id) LIMIT 100"))
def listed_subjects(spark, d):
    """Report: first page of subjects in byte order."""
    return signals.list_subjects(identity.entity_table(_rows(spark, d))).select("subject_id")


@registry.add("listed_mentions", W(ME, " SELECT mention_id, text FROM men WHERE encode(mention_id)>encode('m-2') ORDER BY encode(mention_id) LIMIT 60"))
def listed_mentions(spark, d):
    """Report: a page of current mentions in byte order, continued after a key."""
    log = _rows(spark, d)
    return signals.list_mentions(identity.mention_table(log), identity.entity_table(log), lifecycle="current", page_size=60,
                                 after=["m-2"]).select("mention_id", "text")


@registry.add("found_mentions", W(ME, """ SELECT mention_id, text FROM men WHERE starts_with(text,'Customer#00000') AND (text>'Customer#000000010' OR
 (text='Customer#000000010' AND mention_id>'m-10')) ORDER BY encode(text), encode(mention_id) LIMIT 25"""))
def found_mentions(spark, d):
    """Report: one page of a literal prefix search, continued after a key."""
    log = _rows(spark, d)
    return signals.find_mention(identity.mention_table(log), identity.entity_table(log), "Customer#00000", "prefix",
                                page_size=25, after=["Customer#000000010", "m-10"]).select("mention_id", "text")


@registry.add("listed_properties", W(CL, " SELECT DISTINCT property_id FROM claims ORDER BY encode(property_id) LIMIT 100"))
def listed_properties(spark, d):
    """Report: first page of distinct properties."""
    return signals.list_properties(identity.beliefs(_rows(spark, d), LATE)).select("property_id")


@registry.add("listed_beliefs", W(CL, " SELECT DISTINCT belief_id FROM claims WHERE property_id='status' ORDER BY encode(belief_id) LIMIT 40"))
def listed_beliefs(spark, d):
    """Report: a page of beliefs of one property."""
    return signals.list_beliefs(identity.beliefs(_rows(spark, d), LATE), property_id="status", page_size=40).select("belief_id")


@registry.add("canonical_records", W(IR, S.CLAIMS, """ SELECT claim_candidate_id, '{"belief_id":"'||belief_id||'","claim_candidate_id":"'||claim_candidate_id||'","mention_id":"'||mention_id
 ||'","occurred_at":"'||r.occurred_at||'","opposing_events":[],"origin_type":"observed","predecessors":[],"property_id":"'||property_id
 ||'","provenance_paths":[[{"event_id":"em-'||cust||'","mention_id":"'||mention_id||'","subject_id":"'||subject_id||'"},{"belief_id":"'||belief_id
 ||'","claim_candidate_id":"'||claim_candidate_id||'","event_id":"'||c.event_id||'"}]],"recorded_at":"'||r.recorded_at||'","restrictions":[],"source":'||r.source
 ||',"source_class":"order_book","subject_id":"'||subject_id||'","superseding_events":[],"supporting_events":["'||c.event_id||'"],"value":'||value_json
 ||',"verifiability":"externally_checkable","verification_basis":{"event_ids":["'||c.event_id||'"],"kind":"direct_observation"},"verification_state":"verified"}' AS content
 FROM claims c JOIN rows_ r ON r.log_position=c.log_position"""))
def canonical_records(spark, d):
    """Canonical JSON of every claim candidate."""
    return identity.candidates(_rows(spark, d)).select("claim_candidate_id", identity.candidate_json().alias("content"))


@registry.add("leaf_digests", W(ME, """ SELECT mention_id, sha256('"'||mention_id||'"') AS route, sha256('{"format":"tenet-map/1","key":"'||mention_id
 ||'","kind":"leaf","value":{"event_id":"'||event_id||'","mention_id":"'||mention_id||'","subject_id":"'||subject_id||'","text":"'||text||'"}}') AS digest FROM men"""))
def leaf_digests(spark, d):
    """Routes and leaf digests of the mention map."""
    from tenetlog.operators.commitment import with_leaf
    m = identity.mentions(_rows(spark, d))
    return with_leaf(m, F.col("mention_id"), identity.mention_json()).select("mention_id", "route", "digest")


@registry.add("material_sizes", W(S.IDENTITY_LOG, """, mm AS (SELECT log_position, event_id, 'm-'||substr(event_id,4) AS m, 's-'||substr(event_id,4) AS s,
 json_extract_string(ciphertext,'$.text') AS t FROM rows_ WHERE event_type='entity_mention_recorded')
 SELECT 'mentions' AS kind, count(*) AS members, CAST(sum(octet_length(encode('{"event_id":"'||event_id||'","mention_id":"'||m||'","subject_id":"'||s||'","text":"'||t||'"}'))) AS BIGINT) AS bytes FROM mm
 UNION ALL SELECT 'entities', count(*), CAST(sum(octet_length(encode('{"constituting_mention_id":"'||m||'","event_id":"'||event_id||'","lifecycle_status":"current","predecessors":[],"subject_id":"'||s||'"}'))) AS BIGINT) FROM mm
 UNION ALL SELECT 'entity_links', count(*), CAST(sum(octet_length(encode('{"entity_link_confidence":null,"event_id":"'||event_id||'","link_state":"constitutive","mention_id":"'||m||'","subject_id":"'||s||'"}'))) AS BIGINT) FROM mm"""))
def material_sizes(spark, d):
    """Members and canonical bytes of identity record kinds."""
    from tenetlog.operators.commitment import material_sizes as sizes
    return sizes(cut_lineage(adapt.identity_log(spark, d)), LATE).where("kind in ('mentions','entities','entity_links')")


@registry.add("semantic_hashes", W(IR, """ SELECT event_id, sha256('{"event_id":"'||event_id||'","schema_version":"0","event_type":"'||event_type||'","occurred_at":"'||occurred_at
 ||'","source":'||""" + S.quoted("source") + """||',"source_class":"'||source_class||'","origin_type":"observed","entity_refs":'||coalesce(""" + S.quoted("entity_refs") + """,'null')
 ||',"canonical_entity_id":null,"ciphertext":'||""" + S.quoted("ciphertext") + """||',"redacted":false}') AS semantic FROM rows_"""))
def semantic_hashes(spark, d):
    """What a retry must repeat: everything that does not depend on position."""
    return adapt.identity_requests(spark, d).select("event_id", admission.semantic_hash().alias("semantic"))


@registry.add("snapshot_sizes", W(CL, """ SELECT 'beliefs' AS kind, count(DISTINCT belief_id) AS records FROM claims
 UNION ALL SELECT 'claim_candidates', count(*) FROM claims
 UNION ALL SELECT unnest(['entities','mentions','entity_links']), count(*) FROM customer
 UNION ALL SELECT 'events', (SELECT count(*) FROM customer)+(SELECT count(*) FROM orders)"""))
def snapshot_sizes(spark, d):
    """Records of each kind in a snapshot, after the checks that a replay makes."""
    tables = reads.snapshot(cut_lineage(adapt.identity_log(spark, d)), END, "2")
    return identity.union_all([t.agg(F.count(F.lit(1)).alias("records")).select(F.lit(k).alias("kind"), "records") for k, t in tables.items()])
