"""Faults that the third round's review named."""
import json
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenetlog.operators import admission, commitment as M, identity, keyindex
from tenetlog.session import checkpoint_root, cut_lineage
from tenetlog.sources import adapt, store


def _wanted(sf, name):
    con = duckdb.connect()
    for table in ("customer", "orders", "events"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    return [c[0] for c in cur.description], sorted(repr(r) for r in cur.fetchall())


def _equal(spark, sf, name):
    columns, want = _wanted(sf, name)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in entry.queries()[name](spark, sf).collect())
    assert got == want and got
    return got


@pytest.mark.parametrize("name", ["snapshot_sizes", "published_overview"])
def test_cutoffs_lie_behind_long_logs(spark, sf, monkeypatch, name):
    """A log of many events goes on for months; a fixed date cut it off."""
    monkeypatch.setattr(adapt, "START", "2024-12-01 00:00:00")
    _equal(spark, sf, name)


def test_forged_chains_of_the_whole_log(spark, sf):
    rows = _equal(spark, sf, "forged_chain_audit")
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(rows) == len(range(3, (events - 1) // 64 + 1, 5))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_commitments_move_once_by_mention_and_once_by_belief(spark, sf):
    """Claims once moved with long texts, for each map, version and chain anew."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = cut_lineage(adapt.identity_log(spark, sf))
        for made, most in ((M.full_lineage(log), 3), (M.belief_versions(log), 4), (M.collection_roots(log), 4)):
            assert _shuffles(made) <= most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_and_small_beliefs_have_the_same_versions(spark, sf):
    log = cut_lineage(adapt.transition_log(spark, sf).where("log_position <= 600"))
    names = ["belief_id", "log_position", "result_root", "view_version_hash"]
    small, large = (sorted(map(tuple, M.belief_versions(log, "3", bucket=b).select(*names).collect())) for b in (4096, 2))
    assert small == large and small


def test_upper_levels_of_a_map_are_asked_once_for_each_child(spark, monkeypatch):
    """All routes were asked in the one group at the root."""
    plain = M._prove_udf

    def guarded(namespace):
        inner = plain(namespace).func

        @F.pandas_udf(f"array<{M._STEP}>")
        def prove(routes: pd.Series, digests: pd.Series, asked: pd.Series) -> pd.Series:
            assert max(map(len, asked)) <= 64
            return inner(routes, digests, asked)
        return prove

    monkeypatch.setattr(M, "_prove_udf", guarded)
    keys = spark.range(1500).select(F.lit("s").alias("s"), F.concat(F.lit("k"), "id").alias("key"))
    leaves = cut_lineage(M.with_leaf(keys, F.col("key"), F.lit("1")))
    rows = M.proofs(leaves, leaves, ["s"], bucket=8).join(M.map_roots(leaves, ["s"]), "s")
    assert M.verify_proofs(rows).where("valid").count() == 1500


def _moved(node):
    names = {node.output().apply(i).name() for i in range(node.output().size())} if node.nodeName() == "Exchange" else set()
    return names.union(*(_moved(node.children().apply(i)) for i in range(node.children().size())))


def test_admission_moves_ids_and_no_texts(spark, sf):
    """Whole requests and claims once moved for each of their checks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = adapt.identity_requests(spark, sf).withColumn("event_hash", F.lit("")).withColumn("alive", F.lit(True))
        found = identity.event_violations(cut_lineage(rows), "1")
        names = _moved(found._jdf.queryExecution().executedPlan().initialPlan())
        assert "mention_id" in names and not names & {"claim_json", "ciphertext", "value_json", "source"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("made, projector", [(adapt.identity_log, "2"), (adapt.transition_log, "3")])
def test_sizes_count_the_members_that_are_committed(spark, sf, made, projector):
    """Also where claims come again, name a mention that is not there, or an event states no claim."""
    log = made(spark, sf).where("log_position % 7 <> 3 or log_position > 150")
    again = log.where("log_position % 5 = 0").withColumn("log_position", F.col("log_position") + 1_000_000)
    empty = log.where("log_position % 11 = 0 and event_type = 'observation_recorded'").withColumn("ciphertext", F.lit('{"claims":[]}'))
    log = cut_lineage(log.unionByName(again).unionByName(empty))
    keys = ["belief_id", "kind"]
    want = M.latest_members(M.collection_members(log, projector), keys).groupBy(*keys).count()
    got = sorted(map(repr, map(tuple, M.collection_sizes(log, projector).collect())))
    assert got == sorted(map(repr, map(tuple, want.collect()))) and got


def test_collection_sizes_hash_no_claims(spark, sf):
    """Sizes once took a hashed log on disk and two digests of each member's whole text."""
    made = entry.queries()["collection_sizes"](spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "cut-" not in plan
    assert not any("/cut-" in f for f in made.inputFiles())


def _stated(row):
    """(kind, id) pairs of a stored event, read in Python."""
    yield "event_id", row.event_id
    yield "idempotency_key", row.idempotency_key
    said = json.loads(row.ciphertext)
    claims = said.get("claims", []) if row.event_type == "observation_recorded" else [said["claim"]] if "claim" in said else []
    if row.event_type == "entity_mention_recorded":
        yield from (("mention_id", said["mention_id"]), ("subject_id", said["subject_id"]))
    for claim in claims:
        yield from (("claim_candidate_id", claim["claim_candidate_id"]), ("belief_id", claim["belief_id"]),
                    ("pair", json.dumps([claim["subject_id"], claim["property_id"]], separators=(",", ":"))))
    for target in said.get("targets", []):
        yield "target", target


def test_an_index_names_the_first_owner_of_each_id(spark, sf):
    """Also of events that come twice; a bucket holds an ID once, in order."""
    values = adapt.value_log(spark, sf).where("log_position <= 300").withColumn("log_position", F.col("log_position") + 100_000)
    log = adapt.transition_log(spark, sf).where("log_position <= 700").unionByName(values)
    log = cut_lineage(log.unionByName(log.where("log_position % 9 = 0").withColumn("log_position", F.col("log_position") + 200_000)))
    meant = {r[0]: r[1] for r in log.select("log_position", admission.semantic_hash()).collect()}
    want = {}
    for row in log.orderBy("log_position").collect():
        for key in _stated(row):
            want.setdefault(key, (row.log_position, meant[row.log_position]))
    made = keyindex.in_buckets(keyindex.of_append(log, 7))
    rows = made.where(F.col("kind") != keyindex.HEAD).collect()
    assert {(r.kind, r.id): (r.log_position, r.semantic) for r in rows} == want and len(rows) == len(want)
    assert {k for k, _ in want} >= {"mention_id", "claim_candidate_id", "pair", "target"}
    heads = made.where(F.col("kind") == keyindex.HEAD)
    assert 0 < heads.count() == heads.select("id").distinct().count() and not heads.where("semantic is not null or us is null").count()


def test_keys_and_values_of_an_append_are_read_once(spark, sf):
    """An index scanned the log ten times and joined it with itself; a publication parsed each payload five times."""
    log = cut_lineage(adapt.value_log(spark, sf))
    plan = keyindex.of_append(log, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 5 and "Join" not in plan
    for changed in store.value_changes({}, log, "2030-01-01T00:00:00Z").values():
        assert "from_json(" not in changed._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_written_once(spark, sf):
    """Admission once wrote whole requests anew in every round."""
    root = checkpoint_root(spark)
    before = set(os.listdir(root))
    assert entry.queries()["long_text_mentions"](spark, sf).where("status = 'accepted' and problems = 0").count() == 200
    written = [spark.read.parquet(f"{root}/{f}").columns for f in sorted(set(os.listdir(root)) - before) if f.startswith("cut-")]
    assert sum("ciphertext" in columns for columns in written) == 1
