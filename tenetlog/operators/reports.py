"""Claims that documents state about themselves: extraction, admission, import, reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenetlog.functions import canonical as C, literals
from tenetlog.operators import identity, integrity
from tenetlog.operators.commitment import NAMESPACE
from tenetlog.schema import MENTION, OBSERVATION, LogError
from tenetlog.sources.log import claim_json, mention_payload, prepare_requests, semantic_struct

DECLARATION = ("identity", "version", "digest_algorithm", "canonicalization_profile", "definition_digest")
ARTIFACT = ("repository", "revision", "path", "blob")
# What each literal property means, and its only shape and scope.
MEANINGS = {
    "adr.title.literal": "The ADR artifact at the recorded revision stated this literal title.",
    "adr.status.literal": "The ADR artifact at the recorded revision stated this literal Status declaration.",
    "adr.implementation.literal": "The ADR artifact at the recorded revision stated this literal Implementation declaration.",
}
VALUE_SHAPE, ARTIFACT_KIND, SOURCE_CLASS = "literal-string", "adr-path", "adr-importer"


@dataclass(frozen=True)
class Policy:
    """Small reviewed tables. ``entries``: one row per declaration and property;
    ``admitted``: declarations; ``artifacts``: reviewed (repository, revision, path, blob)."""
    entries: DataFrame
    admitted: DataFrame
    artifacts: DataFrame


def require_report_projector(version: str) -> None:
    if version not in ("1", "2"):
        raise ValueError('reports require explicit projector "1" or "2"')


# --- extraction ---

def scan_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts with scope, blob check and extraction result (error or literals)."""
    return (artifacts.withColumn("subject_scope", C.subject_scope(F.col("repository"), F.col("path")))
            .withColumn("blob_ok", C.git_blob_hash(F.col("data"), F.length("blob")) == F.col("blob"))
            .withColumn("_x", literals.extract("data"))
            .withColumn("error", F.when(~F.col("blob_ok"), "artifact bytes do not match pinned blob")
                        .otherwise(F.col("_x.error")))
            .withColumn("literals", F.col("_x.literals")).withColumn("dates", F.col("_x.dates"))
            .drop("_x", "data"))


def literal_rows(scanned: DataFrame) -> DataFrame:
    return (scanned.where("error is null").select(*ARTIFACT, "subject_scope", F.explode("literals").alias("l"))
            .select(*ARTIFACT, "subject_scope", "l.*"))


def refusals(scanned: DataFrame) -> DataFrame:
    return scanned.where("error is not null").select(
        F.lit("artifact").alias("check"), F.col("path").alias("location"), F.col("error").alias("message"))


def read_artifacts(artifacts: DataFrame, policy: Policy, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts asked for (repository, revision, path, ordinal), and violations.

    Reviewed bindings are unique rows; unknown or repeated requests are reported.
    """
    key = ["repository", "revision", "path"]
    reviewed = policy.artifacts.select(*ARTIFACT).distinct()
    bound = wanted.join(reviewed, key, "left")
    counts = bound.groupBy(*key).agg(F.count("blob").alias("n"), F.countDistinct("ordinal").alias("asked"))
    bad = counts.where("n <> 1 or asked <> 1").select(
        F.lit("artifact").alias("check"), F.col("path").alias("location"),
        F.when(F.col("asked") != 1, "paths must be distinct").otherwise("outside reviewed public inputs").alias("message"))
    good = bound.join(counts.where("n = 1 and asked = 1").select(*key), key, "left_semi")
    return good.join(artifacts, list(ARTIFACT)).orderBy("ordinal"), bad


def expand_prefixes(blobs: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed artifacts from (repository, revision, path_prefix) entries.

    Equal on repository and revision, prefix as the residual; entries that match
    nothing are violations.
    """
    e = entries.select("repository", "revision", "path_prefix")
    joined = blobs.join(e, ["repository", "revision"]).where(F.col("path").startswith(F.col("path_prefix")))
    empty = e.join(joined.select("repository", "revision", "path_prefix"), ["repository", "revision", "path_prefix"],
                   "left_anti").select(F.lit("prefix").alias("check"), F.col("path_prefix").alias("location"),
                                       F.lit("literal prefix expansion matched no blobs").alias("message"))
    return joined.select(*ARTIFACT).distinct(), empty


# --- vocabulary ---

def definition_digests(entries: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Digest of each definition: its canonical JSON with sorted entries.

    ``entries``: identity, version, label, description and per entry property,
    value_shape, artifact_scope, report_meaning, entry_label, entry_description.
    """
    s = lambda name: C.json_string(F.col(name))
    entry = C.json_object(property=s("property"), value_shape=s("value_shape"), artifact_scope=s("artifact_scope"),
                          report_meaning=s("report_meaning"), label=s("entry_label"), description=s("entry_description"))
    grouped = entries.groupBy("identity", "version", "label", "description").agg(
        F.array_sort(F.collect_list(entry)).alias("texts"))
    text = C.json_object(format=f'"{namespace}.adr-report-vocabulary/1"', identity=s("identity"), version=s("version"),
                         label=s("label"), description=s("description"), entries=C.json_array_of(F.col("texts")))
    return grouped.select("identity", "version", F.lit("sha256").alias("digest_algorithm"),
                          F.lit(f"{namespace}.canonical-json/1").alias("canonicalization_profile"),
                          C.sha256(text).alias("definition_digest"))


def definition_violations(entries: DataFrame) -> DataFrame:
    meaning = None
    for prop, text in MEANINGS.items():
        cond = F.col("property") == prop
        meaning = F.when(cond, text) if meaning is None else meaning.when(cond, text)
    label = F.concat_ws("/", "identity", "version", "property")
    shape = integrity.unpack(entries, integrity.pack([
        ("entry", ~F.coalesce((F.col("report_meaning") == meaning) & (F.col("value_shape") == VALUE_SHAPE)
                              & (F.col("artifact_scope") == ARTIFACT_KIND), F.lit(False)),
         "unsupported property/shape/scope/report meaning"),
        *[("entry", F.coalesce(F.col(n) == "", F.lit(True)), f"{n} must be a nonempty string")
          for n in ("identity", "version", "property", "entry_label", "entry_description")]]), label)
    twice = (entries.groupBy("identity", "version", "property").count().where("count > 1")
             .select(F.lit("entry").alias("check"), label.alias("location"),
                     F.lit("duplicate property/entry").alias("message")))
    return shape.unionByName(twice)


def declaration_checks(prefix: str, namespace: str = NAMESPACE) -> list[tuple[str, Column, str]]:
    c = lambda n: F.col(prefix + n)
    return [
        *[("declaration", F.coalesce(c(n) == "", F.lit(True)), f"{n} must be a nonempty string") for n in DECLARATION],
        ("declaration", c("digest_algorithm") != "sha256", "unsupported digest algorithm"),
        ("declaration", c("canonicalization_profile") != f"{namespace}.canonical-json/1",
         "unsupported canonicalization profile"),
        ("declaration", ~C.valid_hash(c("definition_digest")), "invalid definition digest"),
    ]


def default_policy(spark: SparkSession, artifacts: DataFrame, namespace: str = NAMESPACE) -> Policy:
    """One admitted vocabulary with the three literal properties."""
    rows = [(f"{namespace}.adr-reports", "1", "Reports", "Literal declarations", p, VALUE_SHAPE, ARTIFACT_KIND, m, p, m)
            for p, m in MEANINGS.items()]
    entries = spark.createDataFrame(
        rows, "identity string, version string, label string, description string, property string, value_shape string, "
              "artifact_scope string, report_meaning string, entry_label string, entry_description string")
    digests = definition_digests(entries, namespace)
    return Policy(entries.join(digests, ["identity", "version"]), digests, artifacts.select(*ARTIFACT))


# --- recorded report events ---

def report_columns(log: DataFrame) -> DataFrame:
    """Parse the report part of each event's source."""
    config = F.get_json_object("source", "$.config")
    parsed = F.from_json(config, "report_vocabulary struct<" + ",".join(f"{n}:string" for n in DECLARATION)
                         + ">, report_artifact struct<kind:string,repository:string,revision:string,path:string,"
                           "blob:string,subject_scope:string>, extractor string, "
                           "report_locations map<string,struct<start_line:bigint,end_line:bigint,start_byte:bigint,end_byte:bigint>>")
    return log.withColumn("_r", parsed).select(
        "*", *[F.col(f"_r.report_vocabulary.{n}").alias(f"v_{n}") for n in DECLARATION],
        *[F.col(f"_r.report_artifact.{n}").alias(f"a_{n}") for n in ("kind", *ARTIFACT, "subject_scope")],
        F.col("_r.extractor").alias("extractor"), F.col("_r.report_locations").alias("locations")).drop("_r")


def authorize(log: DataFrame, policy: Policy, projector: str, namespace: str = NAMESPACE) -> DataFrame:
    """Violations of report events against the policy.

    Declarations are a handful of rows. Reviewed artifacts grow with the corpus,
    so that join is left to the optimizer rather than forced to broadcast.
    """
    require_report_projector(projector)
    c = F.col
    rows = report_columns(log)
    admitted = policy.admitted.select(*[c(n).alias(f"v_{n}") for n in DECLARATION], F.lit(True).alias("_admitted")).distinct()
    known = policy.artifacts.select(*[c(n).alias(f"a_{n}") for n in ARTIFACT], F.lit(True).alias("_reviewed")).distinct()
    rows = rows.join(admitted, [f"v_{n}" for n in DECLARATION], "left").join(known, [f"a_{n}" for n in ARTIFACT], "left")
    is_mention, is_claim = c("event_type") == MENTION, c("event_type") == OBSERVATION
    text = F.get_json_object("ciphertext", "$.text")
    event_level = integrity.unpack(rows, integrity.pack(declaration_checks("v_", namespace) + [
        ("vocabulary", c("_admitted").isNull(), "vocabulary not admitted by startup snapshot"),
        ("artifact", ~c("a_kind").eqNullSafe(ARTIFACT_KIND), "incompatible artifact scope"),
        ("artifact", c("_reviewed").isNull(), "artifact outside reviewed public inputs"),
        ("artifact", ~c("a_subject_scope").eqNullSafe(C.subject_scope(c("a_repository"), c("a_path"))), "artifact path scope mismatch"),
        ("extractor", ~c("extractor").eqNullSafe(f"{namespace}.adr-literal/1"), "unsupported extractor"),
        ("locations", c("locations").isNull(), "report_locations must be an object"),
        ("origin", ~c("origin_type").eqNullSafe("observed"), "unsupported report origin"),
        ("event_type", ~(is_mention | is_claim), "unsupported external report event"),
        ("mention", is_mention & ((F.size("locations") > 0) | ~text.eqNullSafe(c("a_subject_scope"))),
         "mention requires recorded path scope and empty locations"),
    ]), c("event_id"))

    located = report_columns(log).select("log_position", "a_subject_scope", "locations", *[f"v_{n}" for n in DECLARATION])
    declared = policy.entries.select(*[c(n).alias(f"v_{n}") for n in DECLARATION], c("property").alias("property_id"),
                                     F.lit(True).alias("_declared"))
    claims = identity.resolved_claims(log, projector).join(located, "log_position").join(
        declared, [f"v_{n}" for n in DECLARATION] + ["property_id"], "left")
    place = F.try_element_at("locations", c("claim_candidate_id"))
    span_ok = ((place["start_line"] >= 1) & (place["end_line"] >= place["start_line"]) & (place["start_byte"] >= 0)
               & (place["end_byte"] > place["start_byte"]))
    scope_ok = (c("mention_text") == c("a_subject_scope")) & (c("link_subject_id") == c("subject_id"))
    claim_level = integrity.unpack(claims, integrity.pack([
        ("property", c("_declared").isNull(), "undeclared property"),
        ("value", ~c("value_json").rlike(f"^{identity.NONEMPTY_TEXT}$"), "literal value must be a nonempty string"),
        ("scope", ~F.coalesce(scope_ok, F.lit(False)), "claim mention/subject does not identify the recorded artifact scope"),
        ("location", place.isNull(), "candidate/location mismatch"),
        ("location", place.isNotNull() & ~F.coalesce(span_ok, F.lit(False)), "invalid literal span"),
    ]), c("claim_candidate_id"))
    counts = claims.groupBy("log_position", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("claim_candidate_id").alias("d"), F.max(F.size("locations")).alias("l"))
    sets = counts.where("n <> d or d <> l").select(F.lit("location").alias("check"), c("event_id").alias("location"),
                                                   F.lit("candidate/location mismatch").alias("message"))
    return identity.union_all([event_level, claim_level, sets])


def undefined_history(log: DataFrame, policy: Policy) -> DataFrame:
    """Stored report events whose definition is no longer retained."""
    defined = policy.entries.select(*[F.col(n).alias(f"v_{n}") for n in DECLARATION]).distinct()
    has = F.array_contains(F.json_object_keys(F.get_json_object("source", "$.config")), "report_vocabulary")
    return (report_columns(log.where(F.coalesce(has, F.lit(False))))
            .join(defined, [f"v_{n}" for n in DECLARATION], "left_anti")
            .select(F.lit("definition").alias("check"), F.col("event_id").alias("location"),
                    F.lit("missing retained definition/binding").alias("message")))


# --- import ---

def _id(kind: str, *parts: Column) -> Column:
    """Deterministic ID: a retried task mints the same one."""
    return F.concat(F.lit(kind + "-"), F.substring(C.sha256(F.concat_ws(C.UNIT_SEPARATOR, F.lit(kind), *parts)), 1, 32))


def prepare_import(scanned: DataFrame, policy: Policy, run_id: str, occurred_at: Column, *,
                   retained: DataFrame | None = None, current: DataFrame | None = None,
                   namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """(requests, associations) of an import run.

    ``scanned`` needs an ``ordinal``. Requests carry ``order``: a mention where the
    scope is new, then the observation of all literals, reusing current beliefs.
    """
    good = scanned.where("error is null")
    scopes = good.groupBy("subject_scope").agg(F.min("ordinal").alias("_first"))
    new_m, new_s = _id("mention", F.col("subject_scope")), _id("subject", F.col("subject_scope"))
    if retained is None:
        assoc = scopes.select("subject_scope", "_first", new_m.alias("mention_id"), new_s.alias("subject_id"),
                              F.lit(True).alias("fresh"))
    else:
        known = retained.select(F.col("scope").alias("subject_scope"), F.col("mention_id").alias("_m"), F.col("subject_id").alias("_s"))
        assoc = scopes.join(known, "subject_scope", "left").select(
            "subject_scope", "_first", F.coalesce("_m", new_m).alias("mention_id"),
            F.coalesce("_s", new_s).alias("subject_id"), F.col("_m").isNull().alias("fresh"))
    declaration = policy.admitted.where(F.col("identity") == f"{namespace}.adr-reports").select(
        *[F.col(n).alias(f"v_{n}") for n in DECLARATION])
    base = good.join(assoc, "subject_scope").crossJoin(F.broadcast(declaration))  # the producer's one declaration
    s = lambda n: C.json_string(F.col(n))
    vocabulary = C.json_object(**{n: s(f"v_{n}") for n in DECLARATION})
    artifact = C.json_object(kind=f'"{ARTIFACT_KIND}"', repository=s("repository"), revision=s("revision"),
                             path=s("path"), blob=s("blob"), subject_scope=s("subject_scope"))

    def config(locations):
        return C.json_object(report_vocabulary=vocabulary, report_artifact=artifact, report_locations=locations,
                             extractor=f'"{namespace}.adr-literal/1"', source_dates=C.json_strings(F.col("dates")))

    common = dict(actor_id=F.lit(SOURCE_CLASS), source_class=F.lit(SOURCE_CLASS), occurred_at=occurred_at,
                  entity_refs=F.array("subject_id"))
    mention_rows = prepare_requests(
        base.where(F.col("fresh") & (F.col("ordinal") == F.col("_first"))), event_type=F.lit(MENTION),
        payload=mention_payload(F.col("mention_id"), F.col("subject_id"), F.col("subject_scope")),
        event_id=_id("event", F.lit(run_id), F.lit("m"), F.col("subject_scope")), config=config("{}"), **common)
    lit = base.select("*", F.explode("literals").alias("l"))
    lit = lit.withColumn("property_id", F.col("l.property_id")).withColumn(
        "candidate_id", _id("candidate", F.lit(run_id), *[F.col(n) for n in ARTIFACT], F.col("l.property_id")))
    fresh_belief = _id("belief", F.col("subject_id"), F.col("property_id"))
    if current is not None:
        lit = lit.join(current.select("subject_id", "property_id", F.col("belief_id").alias("_b")),
                       ["subject_id", "property_id"], "left").withColumn("belief_id", F.coalesce("_b", fresh_belief))
    else:
        lit = lit.withColumn("belief_id", fresh_belief)
    claim = claim_json(F.col("belief_id"), F.col("candidate_id"), F.col("mention_id"), F.col("property_id"),
                       F.col("subject_id"), C.json_string(F.col("l.value")), F.lit("externally_checkable"))
    place = F.concat(C.json_string(F.col("candidate_id")), F.lit(":"), C.json_object(**{
        n: F.col(f"l.{n}").cast("string") for n in ("start_line", "end_line", "start_byte", "end_byte")}))
    key = [*ARTIFACT, "subject_scope", "ordinal", "subject_id", "dates", *[f"v_{n}" for n in DECLARATION]]
    per = lit.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l.start_line").alias("n"), claim.alias("t")))).alias("claims"),
        F.array_sort(F.collect_list(place)).alias("places"))
    claims_json = C.json_array_of(F.transform("claims", lambda x: x["t"]))
    observations = prepare_requests(
        per, event_type=F.lit(OBSERVATION), payload=C.json_object(claims=claims_json),
        event_id=_id("event", F.lit(run_id), F.lit("o"), *[F.col(n) for n in ARTIFACT]),
        config=C.json_object(report_vocabulary=vocabulary, report_artifact=artifact,
                             report_locations=F.concat(F.lit("{"), F.array_join("places", ","), F.lit("}")),
                             extractor=f'"{namespace}.adr-literal/1"', source_dates=C.json_strings(F.col("dates"))),
        **common)
    columns = ["order", "event_id", "schema_version", "event_type", "occurred_at", "source", "source_class",
               "origin_type", "entity_refs", "canonical_entity_id", "ciphertext", "redacted"]
    requests = (mention_rows.withColumn("order", F.col("ordinal") * 2).select(*columns)
                .unionByName(observations.withColumn("order", F.col("ordinal") * 2 + 1).select(*columns)))
    return requests, assoc.select(F.col("subject_scope").alias("scope"), "mention_id", "subject_id")


def association_violations(log: DataFrame, associations: DataFrame) -> DataFrame:
    """Retained associations must agree with mentions, and name each scope once."""
    m = identity.mentions(log).select("mention_id", F.col("subject_id").alias("_s"), F.col("text").alias("_t"))
    joined = associations.join(m, "mention_id", "left")
    wrong = integrity.unpack(joined, integrity.pack([
        ("association", ~(F.col("_s").eqNullSafe(F.col("subject_id")) & F.col("_t").eqNullSafe(F.col("scope"))),
         "missing/inconsistent retained mention/subject association")]), F.col("scope"))
    twice = (associations.distinct().groupBy("scope").count().where("count > 1")
             .select(F.lit("association").alias("check"), F.col("scope").alias("location"),
                     F.lit("ambiguous retained scope associations").alias("message")))
    return wrong.unionByName(twice)


def lost_associations(log: DataFrame, associations: DataFrame) -> DataFrame:
    """Recorded report mentions without a retained association."""
    recorded = report_columns(identity.mentions(log)).where("a_subject_scope is not null").select(
        F.col("a_subject_scope").alias("scope"), "mention_id", "subject_id")
    return recorded.join(associations, ["scope", "mention_id", "subject_id"], "left_anti").select(
        F.lit("association").alias("check"), F.col("scope").alias("location"),
        F.lit("missing retained association manifest").alias("message"))


def completion_violations(log: DataFrame, requests: DataFrame, projector: str = "1") -> DataFrame:
    """Requests of an import that are not committed as they were prepared, and
    claims that the view does not hold."""
    require_report_projector(projector)
    text = F.to_json(semantic_struct(), {"ignoreNullFields": "false"})
    stored = log.select("event_id", text.alias("_stored"))
    asked = requests.select("event_id", text.alias("_asked"))
    missing = (asked.join(stored, "event_id", "left").where(~F.col("_asked").eqNullSafe(F.col("_stored")))
               .select(F.lit("request").alias("check"), F.col("event_id").alias("location"),
                       F.lit("expected complete import request not committed").alias("message")))
    flat = requests.withColumn("log_position", F.lit(0)).withColumn("event_hash", F.lit("")).withColumn(
        "recorded_at", F.lit("")).withColumn("chain_id", F.lit(0))
    fields = ["claim_candidate_id", "belief_id", "mention_id", "subject_id", "property_id", "value_json", "verifiability",
              "event_id", "source"]
    lost = (identity.claims(flat, projector).select(*fields)
            .join(identity.candidates(log, projector).select(*fields), fields, "left_anti")
            .select(F.lit("claim").alias("check"), F.col("claim_candidate_id").alias("location"),
                    F.lit("expected literal claim/scope/support absent from publication").alias("message")))
    return missing.unionByName(lost)


def manifest_violations(required: DataFrame, offered: DataFrame, observed: DataFrame) -> DataFrame:
    """A rerun must name the retained artifacts: required within observed within offered."""
    lost = required.select(*ARTIFACT).join(observed, list(ARTIFACT), "left_anti")
    extra = observed.select(*ARTIFACT).join(offered, list(ARTIFACT), "left_anti")
    return lost.unionByName(extra).select(
        F.lit("manifest").alias("check"), F.col("path").alias("location"),
        F.lit("run already retains different artifact requests").alias("message"))


# --- reads ---

def report_details(log: DataFrame, asked: DataFrame, projector: str, as_of: str,
                   namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """(reports in asked order, violations) for (claim_candidate_id, ordinal).

    Only recorded provenance is read. Every report row is rechecked against the
    events that support it.
    """
    require_report_projector(projector)
    c = F.col
    repeated = asked.groupBy("claim_candidate_id").count().where("count > 1 or claim_candidate_id = ''").select(
        F.lit("request").alias("check"), c("claim_candidate_id").alias("location"),
        F.lit("report IDs must be distinct nonempty names").alias("message"))
    cands = asked.join(identity.candidates(log, projector).drop("ordinal"), "claim_candidate_id", "left")
    events = report_columns(log).select(
        c("event_id"), c("event_type").alias("o_type"), c("payload_hash").alias("o_payload_hash"), c("source").alias("o_source"),
        *[c(f"v_{n}") for n in DECLARATION], *[c(f"a_{n}") for n in ("kind", *ARTIFACT, "subject_scope")], "extractor", "locations")
    boot = identity.mentions(log).select(
        c("event_id").alias("link_event_id"), c("mention_id").alias("b_mention"), c("subject_id").alias("b_subject"), c("text").alias("b_text"))
    current = identity.claims(log, projector).groupBy("belief_id").agg(
        F.min(F.struct("subject_id", "property_id")).alias("b1"), F.max(F.struct("subject_id", "property_id")).alias("b2"))
    rows = (cands.join(events, "event_id", "left").join(boot, "link_event_id", "left").join(current, "belief_id", "left")
            .withColumn("location", F.try_element_at("locations", c("claim_candidate_id"))))
    found, place = c("event_id").isNotNull(), c("location")
    hex_id = "^([0-9a-f]{40}|[0-9a-f]{64})$"
    here = F.struct("subject_id", "property_id")
    checks = [
        ("candidate", ~found, "unknown claim candidate"),
        ("property", found & ~F.coalesce(c("property_id").isin(*MEANINGS), F.lit(False)), "unsupported literal report property"),
        ("event", found & (~c("o_type").eqNullSafe(OBSERVATION) | (c("origin_type") != "observed")), "unsupported report event"),
        ("source", found & ~c("source").eqNullSafe(c("o_source")), "source differs from supporting event"),
        *[(n, found & bad, m) for n, bad, m in declaration_checks("v_", namespace)],
        ("artifact", found & ~F.coalesce((c("a_kind") == ARTIFACT_KIND)
                                         & (c("a_subject_scope") == C.subject_scope(c("a_repository"), c("a_path"))), F.lit(False)),
         "artifact scope mismatch"),
        ("artifact", found & ~F.coalesce(c("a_revision").rlike(hex_id) & c("a_blob").rlike(hex_id), F.lit(False)),
         "non-native revision/blob"),
        ("extractor", found & ~c("extractor").eqNullSafe(f"{namespace}.adr-literal/1"), "unsupported literal extractor"),
        ("location", found & ~F.coalesce((place["start_line"] >= 1) & (place["end_line"] >= place["start_line"])
                                         & (place["start_byte"] >= 0) & (place["end_byte"] > place["start_byte"]), F.lit(False)),
         "invalid span bounds"),
        ("association", found & ~F.coalesce((c("b_mention") == c("mention_id")) & (c("b_subject") == c("subject_id"))
                                            & (c("b_text") == c("a_subject_scope")), F.lit(False)), "association mismatch"),
        ("belief", found & ~F.coalesce((c("b1") == here) & (c("b2") == here), F.lit(False)), "containing belief mismatch"),
        ("value", found & ~F.coalesce(c("value_json").rlike(f"^{identity.NONEMPTY_TEXT}$"), F.lit(False)), "nonliteral value"),
    ]
    bad = integrity.unpack(rows, integrity.pack(checks), c("claim_candidate_id")).unionByName(repeated)
    refused = bad.select(F.col("location").alias("claim_candidate_id")).distinct()
    good = rows.where(found).join(refused, "claim_candidate_id", "left_anti").select(
        "ordinal", "claim_candidate_id", "belief_id", "mention_id", "subject_id", "property_id",
        c("a_repository").alias("repository"), c("a_revision").alias("revision"), c("a_path").alias("path"), c("a_blob").alias("blob"),
        F.lit("artifact_at_revision_stated").alias("meaning"),
        F.from_json(F.concat(F.lit('{"v":'), c("value_json"), F.lit("}")), "v string")["v"].alias("value"),
        "verification_state", "verifiability", F.lit(as_of).alias("projected_as_of"),
        c("event_id").alias("observation_event_id"), "occurred_at", "recorded_at", "event_hash",
        c("o_payload_hash").alias("payload_hash"), "source_class", "origin_type",
        *[place[n].alias(n) for n in ("start_line", "end_line", "start_byte", "end_byte")])
    return good.orderBy("ordinal"), bad


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    if not df.limit(1).count():
        raise LogError(f"{what} must not be empty")
    return df
