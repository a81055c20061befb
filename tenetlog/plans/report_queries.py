"""Queries over documents and the claims they state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenetlog.functions import canonical as C
from tenetlog.operators import identity, reports
from tenetlog.operators.segments import dense_positions
from tenetlog.plans import sqltext as S
from tenetlog.plans.registry import LATE, registry
from tenetlog.session import cut_lineage
from tenetlog.sources import adapt, log as L

TIME = "2024-03-01T00:00:00Z"
# Documents as the adaptation builds them, and why some refuse.
DOCS = """d AS (SELECT doc_id AS n, source, lang, 'doc/'||doc_id AS path, 'repo-path:["library","doc/'||doc_id||'"]' AS scope,
 '# '||source||chr(10)||chr(10)||'Status: '||lang||chr(10)||chr(10)||text||CASE WHEN doc_id%11=3 THEN chr(10)||chr(10)||'Status: again'||chr(10)
 WHEN doc_id%13=5 THEN chr(10)||chr(10)||'```'||chr(10)||'open'||chr(10) WHEN doc_id%17=2 THEN chr(10)||chr(10)||'**Status:** bold'||chr(10)
 ELSE chr(10)||chr(10)||'Date: 2024-01-01'||chr(10) END AS content,
 CASE WHEN doc_id%11=3 THEN 'line '||(7+length(text)-length(replace(text,chr(10),'')))||': repeated adr.status.literal' WHEN doc_id%13=5 THEN 'unclosed code fence'
 WHEN doc_id%17=2 THEN 'line '||(7+length(text)-length(replace(text,chr(10),'')))||': unsupported declaration markup/delimiter' END AS error FROM documents)"""
W = S.with_
BLOB = "sha1(encode('blob '||octet_length(encode(content)))||'\\x00'::BLOB||encode(content))"


def _id(kind, *parts):
    return f"'{kind}-'||substr(sha256('{kind}'" + "".join(f"||chr(31)||{p}" for p in parts) + "),1,32)"


def _scanned(spark, d):
    return reports.scan_artifacts(adapt.artifacts(spark, d)).withColumn("ordinal", F.col("n"))


def _report_log(spark, d):
    """(policy, requests, associations, stored log) of one import run."""
    scanned = cut_lineage(_scanned(spark, d))
    policy = reports.default_policy(spark, scanned)
    requests, associations = reports.prepare_import(scanned, policy, "run", F.lit(TIME))
    requests = cut_lineage(requests)
    placed = dense_positions(requests, "order").withColumn("recorded_at", F.lit(TIME)).withColumn(
        "chain_id", L.chain_of(F.col("log_position"))).drop("order")
    return policy, requests, associations, cut_lineage(L.assign_in_chain(placed))


@registry.add("literal_declarations", W(DOCS, """ SELECT path, 'adr.title.literal' AS property_id, source AS value, 1 AS start_line, 1 AS end_line, 2 AS start_byte,
 2+octet_length(encode(source)) AS end_byte FROM d WHERE error IS NULL UNION ALL SELECT path, 'adr.status.literal', lang, 3, 3,
 12+octet_length(encode(source)), 12+octet_length(encode(source))+octet_length(encode(lang)) FROM d WHERE error IS NULL"""))
def literal_declarations(spark, d):
    """Literal declarations of every document, with line and byte spans."""
    return reports.literal_rows(_scanned(spark, d)).select(
        "path", "property_id", "value", "start_line", "end_line", "start_byte", "end_byte")


@registry.add("document_refusals", W(DOCS, " SELECT path AS location, error AS message FROM d WHERE error IS NOT NULL"))
def document_refusals(spark, d):
    """Documents that yield nothing, and why."""
    return reports.refusals(_scanned(spark, d)).select("location", "message")


@registry.add("artifact_blobs", W(DOCS, f" SELECT path, {BLOB} AS blob, n%7<>4 AS blob_ok FROM d"))
def artifact_blobs(spark, d):
    """Native blob names of artifact bytes, and artifacts whose bytes differ from them."""
    a = adapt.artifacts(spark, d)
    changed = a.withColumn("data", F.when(F.col("n") % 7 == 4, F.concat("data", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("data")))
    return changed.select("path", "blob", (C.git_blob_hash(F.col("data"), F.length("blob")) == F.col("blob")).alias("blob_ok"))


@registry.add("import_requests", W(DOCS, f""", ids AS (SELECT *, {BLOB} AS blob, {_id('subject','scope')} AS subject_id, {_id('mention','scope')} AS mention_id,
 '0123456789abcdef0123456789abcdef01234567' AS rev FROM d WHERE error IS NULL)
 SELECT {_id('event',"'run'","'m'",'scope')} AS event_id, '{{"link_state":"constitutive","mention_id":"'||mention_id||'","subject_id":"'||subject_id||'","text":'||{S.quoted('scope')}||'}}' AS ciphertext FROM ids
 UNION ALL SELECT {_id('event',"'run'","'o'","'library'",'rev','path','blob')}, '{{"claims":['||array_to_string(list_transform([['adr.title.literal',source],['adr.status.literal',lang]],
 lambda p: '{{"belief_id":"'||{_id('belief','subject_id','p[1]')}||'","claim_candidate_id":"'||{_id('candidate',"'run'","'library'",'rev','path','blob','p[1]')}||'","mention_id":"'||mention_id
 ||'","property_id":"'||p[1]||'","subject_id":"'||subject_id||'","value":"'||p[2]||'","verifiability":"externally_checkable"}}'),',')||']}}' FROM ids"""))
def import_requests(spark, d):
    """Requests of a document import: one mention per new scope, one observation per document."""
    scanned = cut_lineage(_scanned(spark, d))
    requests, _ = reports.prepare_import(scanned, reports.default_policy(spark, scanned), "run", F.lit(TIME))
    return requests.select("event_id", "ciphertext")


@registry.add("reviewed_artifacts", W(DOCS, " SELECT path, n AS ordinal FROM d WHERE n%3=0"))
def reviewed_artifacts(spark, d):
    """Artifacts read in the order asked for."""
    a = adapt.artifacts(spark, d)
    policy = reports.default_policy(spark, a)
    wanted = a.where("n % 3 = 0").select("repository", "revision", "path", F.col("n").alias("ordinal"))
    return reports.read_artifacts(a, policy, wanted)[0].select("path", "ordinal")


@registry.add("unreviewed_artifacts", W(DOCS, " SELECT path AS location FROM d WHERE n%5=1"))
def unreviewed_artifacts(spark, d):
    """Asked artifacts outside the reviewed prefixes."""
    a = adapt.artifacts(spark, d)
    reviewed, _ = reports.expand_prefixes(a.where("n % 5 <> 1"), a.select("repository", "revision", F.lit("doc/").alias("path_prefix")).distinct())
    policy = reports.default_policy(spark, reviewed)
    wanted = a.select("repository", "revision", "path", F.col("n").alias("ordinal"))
    return reports.read_artifacts(a, policy, wanted)[1].select("location")


@registry.add("report_violations", W(DOCS, f""", ids AS (SELECT *, {BLOB} AS blob, '0123456789abcdef0123456789abcdef01234567' AS rev FROM d WHERE error IS NULL)
 SELECT 'artifact' AS "check", {_id('event',"'run'","'m'",'scope')} AS location FROM ids WHERE n%6=2
 UNION ALL SELECT 'artifact', {_id('event',"'run'","'o'","'library'",'rev','path','blob')} FROM ids WHERE n%6=2"""))
def report_violations(spark, d):
    """Report events whose artifact is not reviewed."""
    policy, _, _, log = _report_log(spark, d)
    n = F.split("path", "/")[1].cast("long")
    narrow = reports.Policy(policy.entries, policy.admitted, policy.artifacts.where(n % 6 != 2))
    return reports.authorize(log, narrow, "1").select("check", "location")


@registry.add("report_details", W(DOCS, """ SELECT path, 'adr.status.literal' AS property_id, lang AS value, 3 AS start_line, 12+octet_length(encode(source)) AS start_byte
 FROM d WHERE error IS NULL"""))
def report_details(spark, d):
    """Named reports with artifact, value, span and provenance, rechecked against the log."""
    _, _, _, log = _report_log(spark, d)
    asked = identity.claims(log).where("property_id = 'adr.status.literal'").select(
        "claim_candidate_id", F.col("log_position").alias("ordinal"))
    return reports.report_details(log, asked, "1", LATE)[0].select("path", "property_id", "value", "start_line", "start_byte")


@registry.add("import_completion", W(DOCS, f""", ids AS (SELECT *, {BLOB} AS blob, '0123456789abcdef0123456789abcdef01234567' AS rev FROM d WHERE error IS NULL)
 SELECT {_id('event',"'run'","'o'","'library'",'rev','path','blob')} AS location FROM ids WHERE n%4=1
 UNION ALL SELECT {_id('candidate',"'run'","'library'",'rev','path','blob','p.p')} FROM ids, (SELECT unnest(['adr.title.literal','adr.status.literal']) AS p) p WHERE n%4=1"""))
def import_completion(spark, d):
    """Requests and claims of an import that the log does not hold."""
    _, requests, _, log = _report_log(spark, d)
    path = F.get_json_object("source", "$.config.report_artifact.path")
    lost = (F.col("event_type") == "observation_recorded") & (F.split(path, "/")[1].cast("long") % 4 == 1)
    return reports.completion_violations(log.where(~lost), requests).select("location")


@registry.add("association_audit", W(DOCS, """ SELECT scope AS location, 'missing retained association manifest' AS message FROM d WHERE error IS NULL AND (n%4=2 OR n%8=3)
 UNION ALL SELECT scope, 'missing/inconsistent retained mention/subject association' FROM d WHERE error IS NULL AND n%8=3"""))
def association_audit(spark, d):
    """Retained associations that are lost, or disagree with the log."""
    _, _, associations, log = _report_log(spark, d)
    n = F.regexp_extract("scope", r"doc/(\d+)", 1).cast("long")
    kept = associations.where(n % 4 != 2).withColumn("subject_id", F.when(n % 8 == 3, "other").otherwise(F.col("subject_id")))
    return reports.association_violations(log, kept).unionByName(reports.lost_associations(log, kept)).select("location", "message")


@registry.add("definition_violations", W(DOCS, """, e AS (SELECT n, 'terms-'||lang||'/'||n||'/adr.title.literal' AS location FROM d),
 twice AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE n%17=6)
 SELECT location, 'unsupported property/shape/scope/report meaning' AS message FROM twice WHERE n%7=3 OR n%11=4
 UNION ALL SELECT location, 'entry_label must be a nonempty string' FROM twice WHERE n%13=5
 UNION ALL SELECT location, 'duplicate property/entry' FROM e WHERE n%17=6"""))
def definition_violations(spark, d):
    """Definition entries, one per document, with another meaning or shape, without a label, or stated twice."""
    n, prop = F.col("n"), "adr.title.literal"
    entries = adapt.table(spark, d, "documents").select(
        F.col("doc_id").alias("n"), F.concat(F.lit("terms-"), "lang").alias("identity"), F.col("doc_id").cast("string").alias("version"),
        F.lit(prop).alias("property")).select(
        "*", F.when(n % 7 == 3, "another meaning").otherwise(reports.MEANINGS[prop]).alias("report_meaning"),
        F.when(n % 11 == 4, "number").otherwise(reports.VALUE_SHAPE).alias("value_shape"), F.lit(reports.ARTIFACT_KIND).alias("artifact_scope"),
        F.when(n % 13 == 5, "").otherwise("Title").alias("entry_label"), F.lit("A title").alias("entry_description"))
    return reports.definition_violations(entries.unionByName(entries.where(n % 17 == 6))).select("location", "message")


@registry.add("undefined_history", W(DOCS, f""", ids AS (SELECT *, {BLOB} AS blob, '0123456789abcdef0123456789abcdef01234567' AS rev FROM d WHERE error IS NULL AND n%3=0)
 SELECT {_id('event',"'late'","'m'",'scope')} AS location FROM ids UNION ALL SELECT {_id('event',"'late'","'o'","'library'",'rev','path','blob')} FROM ids"""))
def undefined_history(spark, d):
    """Report events of an import under a definition that is no longer retained."""
    scanned = cut_lineage(_scanned(spark, d))
    policy = reports.default_policy(spark, scanned)
    digest = [n for n in reports.DECLARATION if n not in ("identity", "version")]
    changed = policy.entries.drop(*digest).withColumn("version", F.lit("2"))
    digests = reports.definition_digests(changed)
    later = reports.Policy(changed.join(digests, ["identity", "version"]), digests, policy.artifacts)
    late = F.col("n") % 3 == 0
    old, _ = reports.prepare_import(scanned.where(~late), policy, "run", F.lit(TIME))
    new, _ = reports.prepare_import(scanned.where(late), later, "late", F.lit(TIME))
    placed = dense_positions(cut_lineage(old.unionByName(new)), "order").withColumn("recorded_at", F.lit(TIME)).withColumn(
        "chain_id", L.chain_of(F.col("log_position"))).drop("order")
    return reports.undefined_history(L.assign_in_chain(placed), policy).select("location")


@registry.add("manifest_violations", W(DOCS, """ SELECT path AS location FROM d WHERE n%3=0 AND n%5=1
 UNION ALL SELECT path FROM d WHERE ((n%3=0 AND n%5<>1) OR n%3=1) AND n%7=2"""))
def manifest_violations(spark, d):
    """Artifacts that a rerun lost or added against the manifest of its run."""
    a = adapt.artifacts(spark, d).drop("data")
    return reports.manifest_violations(
        a.where("n % 3 = 0"), a.where("n % 7 <> 2"), a.where("(n % 3 = 0 and n % 5 <> 1) or n % 3 = 1")).select("location")
