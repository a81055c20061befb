import hashlib
import json
import random

import pytest
from pyspark.sql import Window, functions as F

from tenetlog.functions import instants
from tenetlog.operators import admission, audit, commitment as M, identity, integrity, reads, segments, signals, transitions, values
from tenetlog.operators.chains import hash_chain
from tenetlog.schema import LogError
from tenetlog.session import cut_lineage
from tenetlog.sources import adapt, log as L

LATE = "2024-04-01T00:00:00Z"


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows."""
    rng = random.Random(5)
    rows = [(p, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.randrange(1000)) for p in range(1, 301)]
    return cut_lineage(spark.createDataFrame(rows, "log_position long, k string, v long")), rows


def test_segmented_windows_equal_plain_windows(hot):
    df, _ = hot
    w = Window.partitionBy("k").orderBy("log_position")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("log_position", F.max("v").over(before).alias("m"), F.row_number().over(w).cast("long").alias("o"),
                      F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"))
    cut = segments.running_max(df, ["k"], F.col("v"), "m", size=13)
    cut = segments.ordinals(cut, ["k"], "o", size=13)
    cut = segments.neighbour(cut, ["k"], {"p": "v"}, forward=False, size=13)
    cut = segments.neighbour(cut, ["k"], {"n": "v"}, forward=True, size=13)
    got = cut.select("log_position", "m", F.col("o").cast("long").alias("o"), "p", "n")
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0


def test_predecessor_crosses_segments_and_sees_gaps(hot):
    df, _ = hot
    got = {r.log_position: r.before for r in segments.predecessor(df.where("log_position <> 40"), {"before": "log_position"}, size=13).collect()}
    assert all(got[p] == (p - 1 if p > 1 and p != 41 else None) for p in got)


def test_hash_chain_in_rounds(hot):
    df, rows = hot
    text = F.col("v").cast("string")
    want, state = {}, {}
    for p, k, v in rows:
        state[k] = hashlib.sha256((str(v) if k not in state else f"<{state[k]}>{v}").encode()).hexdigest()
        want[p] = state[k]
    chained = hash_chain(df, ["k"], first=text, before=F.lit("<"), after=F.concat(F.lit(">"), text), size=17)
    assert {r.log_position: r.chain_hash for r in chained.collect()} == want
    final = hash_chain(df, ["k"], first=text, before=F.lit("<"), after=F.concat(F.lit(">"), text), size=17, final_only=True)
    assert {r.k: r.chain_hash for r in final.collect()} == state


def test_dense_positions(spark):
    df = spark.range(0, 500).where("id % 3 <> 1").withColumnRenamed("id", "o")
    got = [r.log_position for r in segments.dense_positions(df, "o", start=7, size=11).orderBy("o").collect()]
    assert got == list(range(8, 8 + len(got)))


def test_value_fold_equals_sequential_fold(spark, sf):
    log = cut_lineage(adapt.value_log(spark, sf))
    rows = values.value_events(log).select("log_position", "belief_id", "value", "occurred_us", "event_id", "event_hash", "event_type").orderBy("log_position").collect()
    view = {}
    for r in rows:
        v = view.setdefault(r.belief_id, {"us": None, "hash": "", "support": [], "over": []})
        v["hash"] = hashlib.sha256((v["hash"] + r.event_hash).encode()).hexdigest()
        v["support"].append(r.event_id)
        if r.event_type == "correction_appended":
            v["over"].append(r.event_id)
        if v["us"] is None or r.occurred_us >= v["us"]:
            v["us"], v["value"] = r.occurred_us, r.value
    names = log.select(F.get_json_object("ciphertext", "$.belief_id").alias("belief_id")).distinct()
    got = {r.belief_id: r for r in values.named_beliefs(log, LATE, names).collect()}
    assert set(got) == set(view)
    for b, v in view.items():
        assert (got[b].current_value, got[b].view_version_hash, got[b].supporting_events, got[b].superseding_events) == (
            v["value"], v["hash"], v["support"], v["over"])


def test_patterns_take_long_texts(spark):
    text = 'a "quoted" \\ line\n' * 60_000
    payload = json.dumps({"link_state": "constitutive", "mention_id": "m", "subject_id": "s", "text": text},
                         sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    row = spark.createDataFrame([(payload, json.dumps([text, "x"]))], "p string, refs string").select(
        F.col("p").rlike(identity.MENTION_SHAPE).alias("shape"), F.to_json(F.array("refs")).rlike(identity.NONEMPTY_TEXT).alias("one"),
        integrity.pack(integrity._refs_checks(F.col("refs"))).alias("bad")).first()
    assert row.shape and row.one and row.bad == []


def test_headers_of_projector_3_follow_touches(spark, sf):
    log = cut_lineage(adapt.transition_log(spark, sf))
    last = M.touches(log, "3").groupBy("belief_id").agg(F.max_by("recorded_at", "log_position").alias("t"))
    heads = identity.beliefs(log, LATE, "3").join(last, "belief_id")
    assert heads.count() == last.count() and heads.where("updated_at <> t").count() == 0
    plain = identity.candidates(log, "3").groupBy("belief_id").agg(F.max_by("recorded_at", "log_position").alias("c"))
    assert last.join(plain, "belief_id").where("t <> c").count() > 0


def test_other_spellings_are_no_damage(spark):
    texts = ['{"a":1,"b":"x"}', '{"a": 1,"b":"x"}', '{"b":"x","a":1}', '{"a":1.50}', '{"a":1.5}', '{"a":"\\u00e9"}', '{"a":"é"}', '{"a":2}']
    df = spark.createDataFrame([(t,) for t in texts], "ciphertext string").select(
        "ciphertext", integrity.canonical_payload(False).alias("c"), integrity.canonical_payload(True).alias("e"))
    for r in df.collect():
        assert r.c == r.e == json.dumps(json.loads(r.ciphertext), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_replay_refuses_whole_log_problems(spark, sf):
    log = cut_lineage(adapt.value_log(spark, sf))
    assert reads.project(log, "2024-02-01T00:01:00Z", "0").count() > 0
    broken = log.withColumn("source_class", F.when(F.col("log_position") == 900, "x").otherwise(F.col("source_class")))
    with pytest.raises(LogError):
        reads.project(broken, "2024-02-01T00:01:00Z", "0")  # damage after the cutoff still refuses
    with pytest.raises(ValueError):
        reads.project(log, LATE, "9")
    with pytest.raises(LogError):
        reads.project(log, LATE, "2", verify=True)


def _simulate(rows):
    """Sequential admission of identity requests in plain Python."""
    ids, keys, mentions, subjects, cands, belief, pair, verdict = {}, {}, {}, {}, set(), {}, {}, {}
    for r in rows:
        body, ok = json.loads(r.ciphertext), True
        actor = json.loads(r.source)["actor_id"]
        key = (actor, r.occurred_at, r.ciphertext)
        if r.event_id in ids or key in keys:
            verdict[r.log_position] = "retry" if ids.get(r.event_id) == keys.get(key) == (r.event_id, r.ciphertext) else "refused"
            continue
        if "mention_id" in body:
            ok = body["mention_id"] not in mentions and body["subject_id"] not in subjects
            if ok:
                mentions[body["mention_id"]] = body["subject_id"]
                subjects[body["subject_id"]] = True
        else:
            c2, b2, p2 = set(cands), dict(belief), dict(pair)
            for c in body["claims"]:
                scope = (c["subject_id"], c["property_id"])
                ok &= c["verifiability"] == "externally_checkable" and c["subject_id"] in subjects
                ok &= mentions.get(c["mention_id"]) == c["subject_id"] and c["claim_candidate_id"] not in c2
                ok &= p2.get(scope, c["belief_id"]) == c["belief_id"] and b2.get(c["belief_id"], scope) == scope
                c2.add(c["claim_candidate_id"])
                b2.setdefault(c["belief_id"], scope)
                p2.setdefault(scope, c["belief_id"])
            if ok:
                cands, belief, pair = c2, b2, p2
        if ok:
            ids[r.event_id] = keys[key] = (r.event_id, r.ciphertext)
        verdict[r.log_position] = "accepted" if ok else "refused"
    return verdict


def test_identity_admission_equals_sequential(spark, sf):
    from tenetlog.plans.identity_queries import _damaged
    rows = cut_lineage(_damaged(adapt.identity_requests(spark, sf)))
    again = rows.where("log_position % 40 = 3").withColumn("log_position", F.col("log_position") + 5000)
    rows = rows.unionByName(again)
    want = _simulate(rows.orderBy("log_position").collect())
    got = {r.log_position: r.status for r in admission.admit(rows, "1").collect()}
    assert got == want and {"accepted", "refused", "retry"} == set(want.values())


def test_admission_in_two_batches_equals_sequential(spark, sf):
    from tenetlog.plans.identity_queries import _damaged
    rows = cut_lineage(_damaged(adapt.identity_requests(spark, sf)))
    rows = cut_lineage(rows.unionByName(rows.where("log_position % 40 = 3").withColumn("log_position", F.col("log_position") + 5000)))
    want = _simulate(rows.orderBy("log_position").collect())
    first = rows.where("log_position <= 900")
    one = cut_lineage(admission.admit(first, "1"))
    stored = cut_lineage(L.assign(admission.accepted(first, one)))
    two = admission.admit(rows.where("log_position > 900"), "1", stored)
    assert {r.log_position: r.status for r in one.unionByName(two).collect()} == want


def test_clock_bounds():
    assert admission.stamp(None, LATE).recorded_at == LATE
    assert admission.stamp("2024-04-01T00:01:00Z", LATE).recorded_at == "2024-04-01T00:01:00Z"
    with pytest.raises(admission.ClockSkewError) as caught:
        admission.stamp("2024-04-01T00:02:01Z", LATE, "e-1")
    assert caught.value.details["reason_code"] == "tip_ahead_of_clock"


@pytest.fixture(scope="module")
def small(spark, sf):
    """A short transition log: few customers, all of their orders."""
    log = adapt.transition_requests(spark, sf).where(
        F.coalesce(F.regexp_extract("ciphertext", r'"b-(\d+)-', 1), F.lit("")).isin("", "3", "5", "8", "13"))
    rows = segments.dense_positions(log.withColumnRenamed("log_position", "o").drop("chain_id"), "o").drop("o")
    return cut_lineage(L.assign(rows))


def test_roots_do_not_depend_on_the_split(small):
    a = cut_lineage(M.belief_versions(small, "3"))
    b = cut_lineage(M.belief_versions(small, "3", bucket=2))
    assert a.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    last = a.groupBy("belief_id").agg(F.max_by("result_root", "log_position").alias("result_root"))
    final = M.collection_roots(small, "3").select("belief_id", "result_root")
    assert last.exceptAll(final).count() == 0


def test_full_lineage_in_plain_python(small):
    log = cut_lineage(small.where("event_type in ('entity_mention_recorded', 'observation_recorded')"))
    cj = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    from tenetlog.schema import ENVELOPE_FIELDS
    mention, state = {}, {}
    for r in log.orderBy("log_position").collect():
        body = json.loads(r.ciphertext)
        dep = {"event_id": r.event_id, "event_hash": r.event_hash, "envelope": {f: r[f] for f in ENVELOPE_FIELDS}, "payload": body}
        if "mention_id" in body:
            mention[body["mention_id"]] = (body, r.event_id, dep)
            continue
        for c in body["claims"]:
            m, link_event, link_dep = mention[c["mention_id"]]
            cand = dict(c, verification_state="verified", verification_basis={"kind": "direct_observation", "event_ids": [r.event_id]},
                        supporting_events=[r.event_id], opposing_events=[], superseding_events=[], restrictions=[], predecessors=[],
                        occurred_at=r.occurred_at, recorded_at=r.recorded_at, source=json.loads(r.source), source_class=r.source_class,
                        origin_type=r.origin_type, provenance_paths=[[
                            {"event_id": link_event, "mention_id": c["mention_id"], "subject_id": c["subject_id"]},
                            {"event_id": r.event_id, "belief_id": c["belief_id"], "claim_candidate_id": c["claim_candidate_id"]}]])
            record = {"entity": {"subject_id": m["subject_id"], "lifecycle_status": "current", "constituting_mention_id": m["mention_id"],
                                 "event_id": link_event, "predecessors": []},
                      "mention": {"mention_id": m["mention_id"], "text": m["text"], "subject_id": m["subject_id"], "event_id": link_event},
                      "link": {"mention_id": m["mention_id"], "subject_id": m["subject_id"], "link_state": "constitutive",
                               "entity_link_confidence": None, "event_id": link_event}}
            b = state.setdefault(c["belief_id"], {"c": set(), "i": set(), "d": set(), "h": None, "s": c["subject_id"], "p": c["property_id"]})
            b["c"].add(cj(cand)), b["i"].add(cj(record)), b["d"].update((cj(dep), cj(link_dep)))
            ordered = {k: [json.loads(t) for t in sorted(b[k], key=str.encode)] for k in "cid"}
            result = {"belief_id": c["belief_id"], "subject_id": b["s"], "property_id": b["p"], "lifecycle_status": "current",
                      "predecessors": [], "claim_candidates": ordered["c"], "identity_records": ordered["i"],
                      "event_dependencies": ordered["d"], "resolution_status": "no_authoritative_head", "updated_at": r.recorded_at}
            before = [] if b["h"] is None else [{"belief_id": c["belief_id"], "view_version_hash": b["h"]}]
            b["h"] = hashlib.sha256(cj({"lineage_format": "tenet-belief-lineage/1", "projector_version": "1",
                                        "producing_event": {"event_id": r.event_id, "event_hash": r.event_hash},
                                        "predecessors": before, "result": result}).encode()).hexdigest()
    got = {r.belief_id: r.view_version_hash for r in M.full_lineage(log).collect()}
    assert got == {k: v["h"] for k, v in state.items()}


def test_proofs_and_tampering(spark):
    # Two maps of different sizes, so they split to different depths.
    rows = spark.range(200).select(F.when(F.col("id") < 5, "small").otherwise("large").alias("s"), F.col("id").cast("string").alias("key"))
    leaves = cut_lineage(M.with_leaf(rows, F.col("key"), F.col("key")))
    proofs = cut_lineage(M.proofs(leaves, leaves, ["s"], bucket=3).join(M.map_roots(leaves, ["s"], bucket=500), "s")
                         .join(leaves.select("route", "key"), "route"))
    assert proofs.count() == 200
    other = M.with_leaf(proofs.drop("route", "digest").withColumn("key", F.concat("key", F.lit("x"))), F.col("key"), F.col("key"))
    cases = {"good": proofs, "root": proofs.withColumn("root", F.sha2("root", 256)),
             "short": proofs.withColumn("proof", F.slice("proof", 2, 256)), "leaf": proofs.withColumn("digest", F.sha2("digest", 256)),
             "key": other}
    for name, case in cases.items():
        assert M.verify_proofs(case).where(F.col("valid") == (name != "good")).count() == 0, name


def test_v3_sets_and_equivalence(small):
    cands = cut_lineage(transitions.candidates_with_endings(small))
    live, retained = transitions.candidate_sets(cands)
    assert live.count() + retained.count() == cands.count() and retained.count() == transitions.relations(small).count()
    assert transitions.ending_violations(cands, transitions.relations(small)).count() == 0
    assert identity.event_violations(small, "3").count() == 0
    with pytest.raises(LogError):
        transitions.without_transitions(small)


FIELDS = ("event_id", "occurred_at", "recorded_at", "source", "source_class", "payload_hash", "prev_event_hash",
          "event_hash", "idempotency_key", "ciphertext", "event_type")


@pytest.fixture(scope="module")
def base_log(spark, sf):
    return cut_lineage(adapt.value_log(spark, sf).where("log_position <= 128"))


def test_mutations_are_detected(base_log):
    """One damaged field per position, all in one log: every position is reported."""
    expr, p = {}, F.col("log_position")
    at = {f: 5 + 10 * i for i, f in enumerate(FIELDS)}
    for f, pos in at.items():
        bad = F.lit("2024-01-31T00:00:00Z") if f == "recorded_at" else F.concat(F.coalesce(F.col(f), F.lit("")), F.lit("0"))
        expr[f] = F.when(p == pos, bad).otherwise(F.col(f))
    log = base_log.withColumns(expr)
    original = {r.log_position: r.event_id for r in base_log.collect()}
    found = {r.location for r in integrity.log_violations(L.inline(log)).collect()}
    assert all(original[pos] in found or original[pos] + "0" in found for pos in at.values())
    dropped = base_log.where("log_position <> 70")
    checks = {r.check for r in integrity.link_violations(dropped).collect()}
    assert {"position", "chain"} <= checks
    assert integrity.log_violations(L.inline(base_log)).count() == 0


def test_audit_finds_each_kind_of_damage(base_log):
    events, payloads = L.split(base_log)
    progress = L.tip(base_log).select("log_position", "event_id")
    view = cut_lineage(values.fold(base_log, LATE).drop("undecided"))
    lineage = cut_lineage(values.lineage(base_log, LATE))
    clean = audit.Store(events, payloads, progress, {"beliefs": view, "lineage": lineage, "support": values.support(base_log, LATE)})
    assert audit.audit(clean, LATE, "0").count() == 0
    bad = audit.Store(events, payloads.where(F.col("event_id") != "e-3"), progress.withColumn("event_id", F.lit("e-0")),
                      {"beliefs": view.limit(3), "lineage": lineage.withColumn("view_version_hash", F.lit("x"))})
    checks = {r.check for r in audit.audit(bad, LATE, "0").collect()}
    assert {"payload_hash", "coverage", "lineage"} <= checks


def test_discovery_pages(spark):
    rows = spark.createDataFrame([(f"s{i}",) for i in range(7)] + [("é",), ("Z",)], "subject_id string").withColumn(
        "lifecycle_status", F.lit("current"))
    seen, after = [], None
    while True:
        page = signals.list_subjects(rows, page_size=4, after=after).collect()
        seen += [r.subject_id for r in page]
        if not page[-1].has_more:
            break
        after = [seen[-1]]
    assert seen == sorted(seen, key=str.encode) and len(seen) == 9
    for size in (0, 1001, True, 2.0):
        with pytest.raises(ValueError):
            signals.list_subjects(rows, page_size=size)
    token = signals.encode_cursor({"q": 1}, {"event_id": None}, {"log_position": 0}, ["é"], "f/1")
    assert signals.decode_cursor(token, {"q": 1}, "f/1")["last_key"] == ["é"]
    for bad in (token + "A", token[:-2], "!!"):
        with pytest.raises(ValueError):
            signals.decode_cursor(bad, {"q": 1}, "f/1")


def test_literal_cutoff_requires_offset():
    with pytest.raises(ValueError):
        instants.literal_us("2024-01-01T00:00:00")
