"""Faults that the fourth round's review named."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenetlog.operators import admission, commitment as M, identity
from tenetlog.session import checkpoint_root, cut_lineage
from tenetlog.sources import adapt, log as L
from tenetlog.sources.store import LogStore


@pytest.mark.parametrize("name", ["identity_admission", "transition_admission", "association_refusals"])
def test_claims_are_parsed_once_whatever_the_rounds(spark, sf, monkeypatch, name):
    """Each round once parsed every claim again, and judged every row."""
    read, claims = [], identity.claims
    monkeypatch.setattr(identity, "claims", lambda *a, **k: read.append(1) or claims(*a, **k))
    assert entry.queries()[name](spark, sf).count()
    assert len(read) <= 2


def test_an_event_id_is_free_again_after_a_refusal_for_its_references(spark, sf):
    """A later event with the ID of one that was refused for its entity_refs was refused too."""
    rows = adapt.identity_requests(spark, sf).where("log_position <= 200")
    first = F.col("log_position") == 160
    bad = rows.where(first).withColumn("entity_refs", F.lit('["s-none"]'))
    good = rows.where(first).withColumn("log_position", F.lit(1000).cast("long"))
    verdicts = admission.admit(cut_lineage(rows.where(~first).unionByName(bad).unionByName(good)), "1")
    got = {r.log_position: r.status for r in verdicts.where("log_position in (160, 1000)").collect()}
    assert got == {160: "refused", 1000: "accepted"}


def test_stores_keep_digests_in_half_the_room(spark, sf, tmp_path):
    """Hex digits went to disk as they are, twice the size of what they say."""
    log = cut_lineage(adapt.value_log(spark, sf))
    LogStore(spark, str(tmp_path / "store")).write_log(log)
    size = sum(f.stat().st_size for f in (tmp_path / "store" / "log").rglob("*.parquet"))
    assert size < 220 * log.count()      # four digests of 32 bytes each in a row


def _shuffle_columns(node, found):
    if node.nodeName() == "Exchange":
        found.append(node.schema().simpleString())
    for i in range(node.children().size()):
        _shuffle_columns(node.children().apply(i), found)
    return found


def test_members_move_with_keys_instead_of_their_routes(spark, sf):
    """A leaf's route is a digest of its key; three went along with each claim where the key does."""
    made = M.timed_members(cut_lineage(adapt.identity_log(spark, sf)))
    moved = [s for s in _shuffle_columns(made._jdf.queryExecution().executedPlan().initialPlan(), []) if "_candidate" in s]
    assert len(moved) == 1 and moved[0].count("route") == 1


def test_two_projectors_publish_from_one_log(spark, sf):
    """The same log was written and indexed for each projector, and once more before."""
    root = checkpoint_root(spark)
    before = set(os.listdir(root))
    assert entry.queries()["unsupported_publication"](spark, sf).count() == 2
    assert sum(f.startswith("store-") for f in set(os.listdir(root)) - before) == 1


def test_texts_of_any_length_are_read(spark):
    """Texts of more than 20,000,000 characters were read as if the mention had no fields."""
    docs = spark.range(2).select(F.concat(F.lit("m-"), F.col("id")).alias("mention_id"), F.concat(F.lit("d-"), F.col("id")).alias("subject_id"),
                                 F.repeat(F.lit("word "), F.when(F.col("id") == 0, 3).otherwise(4_100_000).cast("int")).alias("text"))
    made = L.prepare_mentions(docs, actor_id=F.lit("reader"), source_class=F.lit("corpus"), occurred_at=F.lit("2024-04-01T00:00:00Z"),
                              event_id=F.col("mention_id"))
    assert sorted(r.n for r in identity.mentions(made.drop("mention_id", "subject_id", "text")).select(F.length("text").alias("n")).collect()) == [15, 20_500_000]
