"""Queries over logs of values."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tenetlog.functions import canonical as C, instants, jsontext
from tenetlog.operators import admission, audit, freshness, integrity, intake, reads, seals, segments, signals, values
from tenetlog.plans import mapsql as Q, sqltext as S
from tenetlog.plans.registry import END, LATE, registry
from tenetlog.session import cut_lineage, scratch_path
from tenetlog.sources import adapt, log as L, store
from tenetlog.sources.store import LogStore

R, W, HL = S.VALUE_ROWS, S.with_, S.VALUE_LOG
FOLD = """SELECT belief_id, arg_max(value,{'i':occurred_us,'p':log_position}) AS current_value,
 arg_max(occurred_at,{'i':occurred_us,'p':log_position}) AS value_occurred_at, 'verified' AS verification_state,
 arg_max(verifiability,{'i':occurred_us,'p':log_position}) AS verifiability, 'observed' AS display_origin,
 arg_max(event_id,{'i':occurred_us,'p':log_position}) AS head_event_id, count(*) AS support_count,
 count(*) FILTER (event_type='correction_appended') AS superseding_count,
 CASE WHEN arg_max(event_type,{'i':occurred_us,'p':log_position})='correction_appended'
  THEN 'correction supersedes prior value (Inv. 6 superseding event)' ELSE 'direct observation (world-oracle class, Inv. 4)' END AS resolution_basis,
 (SELECT max(recorded_at) FROM rows_) AS projected_as_of, arg_max(recorded_at,log_position) AS updated_at"""


def _rows(spark, d, **kw):
    return adapt.value_requests(spark, d, **kw).drop("n", "belief_id", "value", "verifiability")


def _end(rows):
    """Recorded time of the last event: a cutoff that grows with the table."""
    return rows.agg(F.max("recorded_at")).first()[0] or LATE


@registry.add("current_values", W(R, f" {FOLD} FROM rows_ GROUP BY belief_id"))
def current_values(spark, d):
    """Value, state, basis and support counts of every belief at the last recorded time."""
    rows = _rows(spark, d)
    return values.fold(rows, _end(rows)).drop("undecided")


@registry.add("current_values_with_lineage", W(HL, f""" {FOLD},
 list_reduce(list(event_hash ORDER BY log_position), lambda a,x: sha256(a||x), '') AS view_version_hash
 FROM log GROUP BY belief_id"""))
def current_values_with_lineage(spark, d):
    """The value view and its hash lineage at the table's last recorded time."""
    log = cut_lineage(adapt.value_log(spark, d))
    end = _end(log)
    return values.fold(log, end).drop("undecided").join(values.lineage(log, end), "belief_id")


@registry.add("log_with_payloads", W(HL, """ SELECT log_position, event_id, event_type, recorded_at, payload_hash, prev_event_hash,
 event_hash, ciphertext FROM log"""))
def log_with_payloads(spark, d):
    """Full scan: events joined with their payload rows."""
    events, payloads = L.split(cut_lineage(adapt.value_log(spark, d)))
    return L.join_payloads(events, payloads).select(
        "log_position", "event_id", "event_type", "recorded_at", "payload_hash", "prev_event_hash", "event_hash", "ciphertext")


@registry.add("event_assignment", W(HL, """ SELECT log_position, event_id, chain_id, idempotency_key, payload_hash, prev_event_hash,
 event_hash FROM log"""))
def event_assignment(spark, d):
    """Hashes, keys and chain links assigned to positioned requests."""
    rows = L.assign(_rows(spark, d), recorded_at=F.col("recorded_at"))
    return rows.select("log_position", "event_id", "chain_id", "idempotency_key", "payload_hash", "prev_event_hash", "event_hash")


@registry.add("events_after_position", W(R, " SELECT log_position, event_id, ciphertext FROM rows_ WHERE log_position > 500"))
def events_after_position(spark, d):
    """Incremental scan after a position."""
    return L.after(_rows(spark, d), 500).select("log_position", "event_id", "ciphertext")


@registry.add("events_in_order", W(R, " SELECT row_number() OVER (ORDER BY log_position) AS place, event_id FROM rows_"))
def events_in_order(spark, d):
    """All events of the table in log order."""
    rows = _rows(spark, d)
    ordered = reads.events_of(rows, _end(rows))
    return segments.dense_positions(ordered.select("event_id", "log_position"), "log_position", "place").select("place", "event_id")


@registry.add("retained_pairs", W(HL, """ SELECT log_position, event_id, true AS predecessor_ok FROM log
 WHERE event_type='correction_appended'"""))
def retained_pairs(spark, d):
    """Named events with their predecessor link checked by position."""
    log = cut_lineage(adapt.value_log(spark, d))
    names = log.where("event_type = 'correction_appended'").select("event_id")
    return L.retained_pairs(log, names).select("log_position", "event_id", "predecessor_ok")


@registry.add("events_by_idempotency_key", W(HL, " SELECT log_position, event_id FROM log WHERE source_class='class1'"))
def events_by_idempotency_key(spark, d):
    """Lookup of recorded events by keys computed from resubmitted requests."""
    again = _rows(spark, d).where("source_class = 'class1'").select(C.idempotency_key(
        C.actor_of(F.col("source")), F.col("occurred_at"), F.col("ciphertext")).alias("idempotency_key"))
    return L.by_idempotency_key(adapt.value_log(spark, d), again).select("log_position", "event_id")


@registry.add("events_since", W(R, """ SELECT log_position, event_id, event_type, occurred_at FROM rows_
 WHERE recorded_us >= epoch_us(TIMESTAMP '2024-02-01 00:05:00') ORDER BY log_position LIMIT 50"""))
def events_since(spark, d):
    """Report: the first envelopes recorded from a time on, in log order."""
    rows = _rows(spark, d).withColumn("idempotency_key", F.lit("")).withColumn("payload_hash", F.lit("")).withColumn(
        "prev_event_hash", F.lit("")).withColumn("event_hash", F.lit(""))
    return L.events_since(rows, "2024-02-01T00:05:00Z", 50).select("log_position", "event_id", "event_type", "occurred_at")


@registry.add("log_tip", W(HL, """ SELECT max(log_position) AS log_position, arg_max(event_id,log_position) AS event_id,
 arg_max(event_hash,log_position) AS event_hash, arg_max(recorded_at,log_position) AS recorded_at FROM log"""))
def log_tip(spark, d):
    """Latest event of the log."""
    return L.tip(adapt.value_log(spark, d))


@registry.add("support_members", W(R, """ SELECT belief_id, row_number() OVER (PARTITION BY belief_id ORDER BY log_position) AS ordinal,
 log_position, event_id, event_type='correction_appended' AS superseding FROM rows_"""))
def support_members(spark, d):
    """Support set of every belief over the whole table, one row per member."""
    rows = _rows(spark, d)
    return values.support(rows, _end(rows))


@registry.add("support_arrays", W(R, """ SELECT belief_id, (log_position-1)//65536 AS segment,
 array_to_string(list(event_id ORDER BY log_position),' ') AS supporting,
 coalesce(array_to_string(list(event_id ORDER BY log_position) FILTER (event_type='correction_appended'),' '),'') AS superseding
 FROM rows_ GROUP BY belief_id, segment"""))
def support_arrays(spark, d):
    """Support and superseding arrays over the whole table, per belief and position segment."""
    log = _rows(spark, d)
    rows = values.support_segments(log, _end(log))
    return rows.select("belief_id", "segment", F.array_join("supporting_events", " ").alias("supporting"),
                       F.array_join("superseding_events", " ").alias("superseding"))


@registry.add("belief_lineage", W(HL, """ SELECT belief_id,
 list_reduce(list(event_hash ORDER BY log_position), lambda a,x: sha256(a||x), '') AS view_version_hash FROM log GROUP BY belief_id"""))
def belief_lineage(spark, d):
    """Hash lineage of every belief over the whole log."""
    return values.lineage(cut_lineage(adapt.value_log(spark, d)), END)


_HEADS = """ SELECT belief_id, log_position, arg_max(value,{'i':occurred_us,'p':log_position}) OVER w AS current_value,
 arg_max(event_id,{'i':occurred_us,'p':log_position}) OVER w AS head_event_id, recorded_us AS valid_from_us,
 lead(recorded_us) OVER (PARTITION BY belief_id ORDER BY log_position) AS valid_to_us FROM rows_
 WINDOW w AS (PARTITION BY belief_id ORDER BY log_position ROWS UNBOUNDED PRECEDING)"""


@registry.add("belief_history", W(R, _HEADS))
def belief_history(spark, d):
    """Head of each belief after each of its events, with validity bounds."""
    return values.history(_rows(spark, d))


@registry.add("values_as_of", W(R, """, req AS (SELECT n AS request_id, 'user:'||user_id||'/property:click' AS belief_id,
 epoch_us(TIMESTAMP '2024-02-01 00:00:00') + (n//3)*1000000 AS as_of_us FROM rows_),
hist AS (""" + _HEADS + """)
 SELECT request_id, req.belief_id, as_of_us, current_value, head_event_id FROM req LEFT JOIN hist ON hist.belief_id=req.belief_id
 AND valid_from_us<=as_of_us AND (valid_to_us IS NULL OR as_of_us<valid_to_us)"""))
def values_as_of(spark, d):
    """As-of join: the value each request would have read at its own cutoff."""
    e = adapt.table(spark, d, "events")
    requests = e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit("/property:click")).alias("belief_id"),
        (F.lit(1706745600000000) + F.floor(F.col("event_id") / 3) * 1000000).alias("as_of_us"))
    return values.values_as_of(cut_lineage(_rows(spark, d)), requests)


@registry.add("prior_instants", W(R, """ SELECT log_position, belief_id, max(occurred_us) OVER (PARTITION BY belief_id ORDER BY log_position
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_us FROM rows_"""))
def prior_instants(spark, d):
    """Greatest earlier source instant of the belief, per event."""
    return values.prior_instants(_rows(spark, d)).select("log_position", "belief_id", "prior_us")


@registry.add("backdated_corrections", W(S.SUBMITTED_ROWS, """ SELECT log_position, event_id FROM (SELECT *, max(occurred_us) OVER
 (PARTITION BY belief_id ORDER BY log_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_us FROM rows_)
 WHERE event_type='correction_appended' AND occurred_us<prior_us"""))
def backdated_corrections(spark, d):
    """Corrections older than the value they would correct."""
    return values.backdated_corrections(_rows(spark, d, submitted=True)).select("log_position", "event_id")


# Submissions, then exact retries, then conflicting resubmissions.
_SUBMISSIONS = S.SUBMITTED_ROWS + """,
cnt AS (SELECT count(*) AS c FROM rows_),
subs AS (SELECT log_position, n, 'first' AS part, belief_id, event_type, occurred_us, verifiability, origin_type FROM rows_
 UNION ALL SELECT log_position+c, n, 'again', belief_id, event_type, occurred_us, verifiability, origin_type FROM rows_, cnt WHERE n%50=10
 UNION ALL SELECT log_position+2*c, n, 'changed', belief_id, event_type, occurred_us, verifiability, origin_type FROM rows_, cnt WHERE n%50=20),
judged AS (SELECT *, verifiability='unknowable' OR origin_type<>'observed' AS bad, max(occurred_us) FILTER (part='first' AND verifiability<>'unknowable'
 AND origin_type='observed') OVER (PARTITION BY belief_id ORDER BY log_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_us FROM subs),
firsts AS (SELECT n, NOT bad AND NOT (event_type='correction_appended' AND occurred_us<coalesce(prior_us,occurred_us)) AS ok FROM judged WHERE part='first')
"""


@registry.add("value_admission", W(_SUBMISSIONS, """ SELECT log_position, 'e-'||n AS event_id, CASE WHEN bad THEN 'refused'
 WHEN part='first' THEN CASE WHEN ok THEN 'accepted' ELSE 'refused' END
 WHEN part='again' THEN CASE WHEN ok THEN 'retry' ELSE 'refused' END
 ELSE 'refused' END AS status FROM judged JOIN firsts USING (n)"""))
def value_admission(spark, d):
    """Batch admission: domain, origin, backdating, exact retries and conflicts."""
    first = adapt.value_requests(spark, d, submitted=True)
    count = first.agg(F.count(F.lit(1)).alias("c"))
    shifted = first.crossJoin(F.broadcast(count))  # one row
    again = shifted.where("n % 50 = 10").withColumn("log_position", F.col("log_position") + F.col("c")).drop("c")
    changed = (shifted.where("n % 50 = 20").withColumn("log_position", F.col("log_position") + 2 * F.col("c")).drop("c")
               .withColumn("ciphertext", F.replace("ciphertext", F.lit('"value":"'), F.lit('"value":"9'))))
    rows = first.unionByName(again).unionByName(changed).drop("n", "belief_id", "value", "verifiability")
    return admission.admit(rows, "0").select("log_position", "event_id", "status")


@registry.add("store_admission", W(_SUBMISSIONS, """ SELECT part, 'e-'||n AS event_id, CASE WHEN bad THEN 'refused'
 WHEN part='first' THEN CASE WHEN ok THEN 'accepted' ELSE 'refused' END
 WHEN part='again' THEN CASE WHEN ok THEN 'retry' ELSE 'refused' END
 ELSE 'refused' END AS status FROM judged JOIN firsts USING (n)"""))
def store_admission(spark, d):
    """Three batches submitted to a store: requests, exact retries, conflicts. Earlier owners come from the key index."""
    first = cut_lineage(adapt.value_requests(spark, d, submitted=True).drop(
        "belief_id", "value", "verifiability", "recorded_at", "chain_id", "log_position").withColumnRenamed("n", "order"))
    changed = first.where("order % 50 = 20").withColumn("ciphertext", F.replace("ciphertext", F.lit('"value":"'), F.lit('"value":"9')))
    kept, found = LogStore(spark, scratch_path(spark, "store")), []
    for part, batch in (("first", first), ("again", first.where("order % 50 = 10")), ("changed", changed)):
        verdicts = kept.submit(batch, "2024-03-01T00:00:00Z", "0", require_published=False)
        found.append(verdicts.select(F.lit(part).alias("part"), "event_id", "status"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@registry.add("clamped_recording_times", W(R, """, jit AS (SELECT log_position, recorded_us - (n%5)*3000000 AS us FROM rows_)
 SELECT log_position, strftime(make_timestamp(max(us) OVER (ORDER BY log_position)), '%Y-%m-%dT%H:%M:%SZ') AS recorded_at FROM jit"""))
def clamped_recording_times(spark, d):
    """Imported recording times that step back are raised to the running tip."""
    rows = adapt.value_requests(spark, d).withColumn(
        "recorded_at", F.date_format(
            F.lit(adapt.START).cast("timestamp_ntz") + F.make_dt_interval(
                secs=(F.floor(F.col("n") / 2) - (F.col("n") % 5) * 3).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return admission.clamp_recorded(rows.select("log_position", "event_id", "recorded_at")).select("log_position", "recorded_at")


@registry.add("skewed_imports", W(R, """, jit AS (SELECT log_position, event_id, recorded_us - CASE WHEN n%31=9 THEN 200 ELSE 3*(n%5) END*1000000 AS us FROM rows_),
 t AS (SELECT *, max(us) OVER (ORDER BY log_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tip FROM jit)
 SELECT event_id AS location, 'tip_ahead_of_clock' AS message FROM t WHERE tip-us > 120*1000000"""))
def skewed_imports(spark, d):
    """Imported rows whose clock lies too far behind the running tip."""
    behind = F.when(F.col("n") % 31 == 9, 200).otherwise((F.col("n") % 5) * 3)
    rows = adapt.value_requests(spark, d).withColumn("recorded_at", F.date_format(
        F.lit(adapt.START).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.floor(F.col("n") / 2) - behind).cast("decimal(18,6)")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return admission.skewed_rows(rows.select("log_position", "event_id", "recorded_at")).select("location", "message")


@registry.add("strict_refusal_paths", """SELECT event_id AS location, '$.k' AS path, 'duplicate JSON key ''k''' AS message FROM events WHERE event_id%4=1
 UNION ALL SELECT event_id, '$.a[1].b', 'duplicate JSON key ''b''' FROM events WHERE event_id%4=2
 UNION ALL SELECT event_id, '$.a[2]', 'nonfinite Infinity' FROM events WHERE event_id%4=2
 UNION ALL SELECT event_id, '$', 'invalid JSON' FROM events WHERE event_id%4=3""")
def strict_refusal_paths(spark, d):
    """Every fault of payload texts with its path; two in one text are both told."""
    n, p = F.col("event_id"), F.col("props")
    text = (F.when(n % 4 == 1, F.concat(F.lit('{"k":1,'), F.expr("substring(props, 2)")))
            .when(n % 4 == 2, F.concat(F.lit('{"a":[0,{"b":1,"b":'), p, F.lit('},Infinity]}'))).when(n % 4 == 3, F.concat(p, F.lit("]"))).otherwise(p))
    rows = adapt.table(spark, d, "events").select("event_id", text.alias("t"))
    return signals.strict_refusals(rows, "event_id", "t").select("location", "path", "message")


_DOCUMENT = """'{'||CASE WHEN n%11=3 THEN '' ELSE '"belief_id":"'||belief_id||'",' END||CASE WHEN n%13=5 THEN '"value":7,' WHEN n%17=4 THEN ''
 ELSE '"value":"'||value||'",' END||'"verifiability":"'||CASE WHEN n%19=6 THEN 'maybe' ELSE verifiability END||'","occurred_at":"'||
 CASE WHEN n%23=7 THEN '2024-01-01T00:00:00' WHEN n%29=8 THEN 'yesterday' ELSE occurred_at END||'","source":{'||CASE WHEN n%31=9 THEN '' ELSE
 '"actor_id":"'||actor||'"' END||'},"source_class":"'||CASE WHEN n%37=10 THEN '' ELSE source_class END||'"}'"""


@registry.add("intake_screen", W(R, """ SELECT log_position, CASE WHEN n%11=3 THEN 'missing field: belief_id' WHEN n%13<>5 AND n%17=4 THEN 'missing field: value'
 WHEN n%37=10 THEN 'missing field: source_class' WHEN n%13=5 THEN 'value must be a JSON string' WHEN n%19=6 THEN 'unknown verifiability'
 WHEN n%31=9 THEN 'source.actor_id required' WHEN n%23=7 THEN 'occurred_at must carry a timezone offset'
 WHEN n%29=8 THEN 'occurred_at not ISO8601' END AS reason FROM rows_"""))
def intake_screen(spark, d):
    """First check of raw documents: the first reason to reject each, or none."""
    rows = adapt.value_requests(spark, d).withColumn("actor", C.actor_of(F.col("source")))
    n = F.col("n")
    part = lambda cond, text, other: F.when(cond, text).otherwise(other)
    member = lambda name, col: F.concat(F.lit(f'"{name}":"'), col, F.lit('"'))
    document = F.concat(
        F.lit("{"), part(n % 11 == 3, F.lit(""), F.concat(member("belief_id", F.col("belief_id")), F.lit(","))),
        F.when(n % 13 == 5, F.lit('"value":7,')).when(n % 17 == 4, F.lit("")).otherwise(
            F.concat(member("value", F.col("value")), F.lit(","))),
        member("verifiability", part(n % 19 == 6, F.lit("maybe"), F.col("verifiability"))), F.lit(","),
        member("occurred_at", F.when(n % 23 == 7, "2024-01-01T00:00:00").when(n % 29 == 8, "yesterday").otherwise(F.col("occurred_at"))),
        F.lit(',"source":{'), part(n % 31 == 9, F.lit(""), member("actor_id", F.col("actor"))), F.lit("},"),
        member("source_class", part(n % 37 == 10, F.lit(""), F.col("source_class"))), F.lit("}"))
    return intake.screen(rows.select("log_position", document.alias("document"))).select("log_position", "reason")


@registry.add("timestamp_spellings", W(R, """ SELECT log_position, occurred_us AS same_us,
 CASE n%5 WHEN 3 THEN NULL ELSE occurred_us END AS spelled_us FROM rows_"""))
def timestamp_spellings(spark, d):
    """Instants of source times in extended, basic, comma-fraction and offset-free spellings."""
    rows = adapt.value_requests(spark, d)
    t, n = F.col("occurred_at"), F.col("n")
    body, offset = F.substring(t, 1, 19), F.expr("substring(occurred_at, 20)")
    spelled = (F.when(n % 5 == 1, F.concat(F.replace(F.replace(body, F.lit("-"), F.lit("")), F.lit(":"), F.lit("")), offset))
               .when(n % 5 == 2, F.concat(body, F.lit(",000"), offset)).when(n % 5 == 3, body)
               .when(n % 5 == 4, F.concat(F.replace(body, F.lit("T"), F.lit(" ")), F.replace(offset, F.lit(":"), F.lit(""))))
               .otherwise(t))
    return rows.select("log_position", instants.instant_us(t).alias("same_us"), instants.instant_us(spelled).alias("spelled_us"))


def _corrupted(log):
    p = F.col("log_position")
    return (log.withColumn("event_hash", F.when(p % 211 == 20, F.sha2(F.lit("x"), 256)).otherwise(F.col("event_hash")))
            .withColumn("ciphertext", F.when(p % 223 == 30, F.concat(F.col("ciphertext"), F.lit(" ")))       # the same content
                        .when(p % 229 == 50, F.replace(F.col("ciphertext"), F.lit('"value":"'), F.lit('"value":"x'))).otherwise(F.col("ciphertext")))
            .withColumn("source_class", F.when(p % 227 == 40, "other").otherwise(F.col("source_class"))))


@registry.add("corrupted_log_audit", W(HL, """, bad AS (SELECT *, CASE WHEN log_position%211=20 THEN sha256('x') ELSE event_hash END AS eh FROM log)
 SELECT 'envelope_hash' AS "check", event_id AS location FROM bad WHERE log_position%211=20 OR log_position%227=40
 UNION ALL SELECT 'payload_hash', event_id FROM bad WHERE log_position%229=50 AND log_position%223<>30
 UNION ALL SELECT 'idempotency_key', event_id FROM bad WHERE log_position%229=50 AND log_position%223<>30
 UNION ALL SELECT 'chain', b.event_id FROM bad b JOIN bad a ON a.log_position=b.log_position-1 WHERE a.log_position%211=20 AND a.chain_id=b.chain_id"""))
def corrupted_log_audit(spark, d):
    """Audit of a log with changed hashes, payloads and fields: exactly those are found, and no other spelling of a payload."""
    bad = L.inline(_corrupted(cut_lineage(adapt.value_log(spark, d))))
    return integrity.log_violations(bad).select("check", "location")


@registry.add("forged_chain_audit", W(R, """, h AS (SELECT max(log_position)//2 AS half FROM rows_)
 SELECT DISTINCT 'chain' AS "check", CAST((log_position-1)//64 AS VARCHAR) AS location, 'chain does not end in its recorded tip' AS message,
 half AS reached FROM rows_, h WHERE ((log_position-1)//64)%5=3"""))
def forged_chain_audit(spark, d):
    """Chains rewritten and hashed afresh: every link holds. With those of the second append alone, publication stops
    before that append; with those of the whole log, the audit finds exactly those."""
    log = cut_lineage(adapt.value_log(spark, d))
    half = log.agg(F.max("log_position")).first()[0] // 2
    kept = LogStore(spark, scratch_path(spark, "store"))
    for part in (log.where(F.col("log_position") <= half), log.where(F.col("log_position") > half)):
        kept.write_log(part)
    chosen, late = F.col("chain_id") % 5 == 3, F.col("chain_id") > half // 64
    twin = L.assign_in_chain(adapt.value_requests(spark, d).withColumn("source_class", F.lit("forged"))).select(*log.columns)

    def written(rows):
        folder = kept.commits.new_folder("log")
        rows.withColumn("recorded_us", instants.instant_us(F.col("recorded_at"))).write.parquet(f"{kept.root}/{folder}")
        return folder

    def commit(folders):
        state = kept.manifest()
        kept.commits.commit(replace(state, number=state.number + 1, folders={**state.folders, "log": folders}))

    first = kept.manifest().folders["log"][0]
    between = written(log.where(~late & (F.col("log_position") > half)))    # the chain that both appends reach
    second = written(log.where(late & ~chosen).unionByName(twin.where(late & chosen)))
    commit([first, between, second])
    reached = kept.publish(END, "0")
    commit([written(log.where(~late & ~chosen).unionByName(twin.where(~late & chosen))), second])
    return audit.log_audit(kept.audit_tables("0")).select("check", "location", "message", F.lit(reached).cast("long").alias("reached"))


_BATCHES = """CASE WHEN n < (SELECT count(*) FROM events)//3 THEN 1 WHEN n < 2*(SELECT count(*) FROM events)//3 THEN 2 ELSE 3 END"""


@registry.add("interrupted_submits", "WITH RECURSIVE " + S.VALUE_ROWS.lstrip().replace("rows_ AS", "plain_ AS") + f""",
rows_ AS (SELECT * EXCLUDE (recorded_at, recorded_us), {_BATCHES} AS batch, '2024-03-01T00:00:0'||{_BATCHES}||'Z' AS recorded_at FROM plain_)"""
              + S.HASHED + """,
ends AS (SELECT batch, min(log_position) AS first_position, max(log_position) AS append_position FROM log GROUP BY batch),
tips AS (SELECT CAST(batch AS VARCHAR) AS batch, CAST(chain_id AS VARCHAR) AS chain, arg_max(event_hash, log_position) AS tip FROM log GROUP BY ALL),
""" + Q.map_roots(Q.leaves("tips", "batch", "chain", "'\"'||tip||'\"'")) + """,
sealed AS (SELECT e.batch, append_position, sha256('seal/1|'||append_position||'|'||first_position||'|'||root||'|') AS seal FROM ends e JOIN roots r
  ON r.scope=CAST(e.batch AS VARCHAR) WHERE e.batch=1
 UNION ALL SELECT e.batch, e.append_position, sha256('seal/1|'||e.append_position||'|'||e.first_position||'|'||root||'|'||s.seal) FROM sealed s
  JOIN ends e ON e.batch=s.batch+1 JOIN roots r ON r.scope=CAST(e.batch AS VARCHAR))
 SELECT 'event' AS kind, log_position, event_id, event_hash AS hash FROM log UNION ALL SELECT 'seal', append_position, NULL, seal FROM sealed""")
def interrupted_submits(spark, d):
    """Three batches; each is stopped after another of its writes and submitted again. The log and its seals, and nothing else."""
    rows = cut_lineage(adapt.value_requests(spark, d).drop(
        "belief_id", "value", "verifiability", "recorded_at", "chain_id", "log_position").withColumnRenamed("n", "order"))
    count = rows.count()
    kept = LogStore(spark, scratch_path(spark, "store"))
    for k, stop in enumerate(("log", "tips", "seals")):
        batch = rows.where((F.col("order") >= k * count // 3) & (F.col("order") < (k + 1) * count // 3))
        _, writes = kept.submission(batch, f"2024-03-01T00:00:0{k + 1}Z", "0", require_published=False)
        for written in writes:
            if written == stop:
                break
        kept.submit(batch, f"2024-03-01T00:00:0{k + 1}Z", "0", require_published=False)
    log = kept.log().select(F.lit("event").alias("kind"), "log_position", "event_id", F.col("event_hash").alias("hash"))
    return log.unionByName(kept.seals().select(F.lit("seal").alias("kind"), F.col("append_position").alias("log_position"),
                                               F.lit(None).cast("string").alias("event_id"), F.col("seal").alias("hash")))


@registry.add("changed_seal_audit", W(R, """ SELECT 'seal' AS "check", CAST(max(log_position)//2 AS VARCHAR) AS location, 'seal does not match its tips' AS message FROM rows_
 UNION ALL SELECT 'seal', CAST(max(log_position) AS VARCHAR), 'seal does not lead from the one before' FROM rows_
 UNION ALL SELECT 'seal', CAST(max(log_position)//2 AS VARCHAR), 'seal does not match its contents' FROM rows_"""))
def changed_seal_audit(spark, d):
    """Two sealed appends, then another root and another seal for the first: both show, and so does the broken succession."""
    log = adapt.value_log(spark, d)
    end = log.agg(F.max("log_position")).first()[0]
    half = end // 2
    parts = [(log.where(F.col("log_position") <= half), half, 1), (log.where(F.col("log_position") > half), end, half + 1)]
    tips = [cut_lineage(seals.append_tips(rows, last)) for rows, last, _ in parts]
    first = cut_lineage(seals.sealed(tips[0], 1, None))
    second = seals.sealed(tips[1], half + 1, first.first().seal)
    changed = first.withColumn("root", F.sha2(F.lit("r"), 256)).withColumn("seal", F.sha2(F.lit("s"), 256))
    return seals.seal_violations(tips[0].unionByName(tips[1]), changed.unionByName(second))


@registry.add("verified_publication", W(R, """, n AS (SELECT max(log_position) AS n FROM rows_)
 SELECT n//2 - 1 AS reached, n//2 AS log_position, 'envelope_hash' AS "check", 'envelope hash mismatch' AS message FROM n"""))
def verified_publication(spark, d):
    """A store with one changed event in the middle: publication stops before it and says why."""
    log = cut_lineage(adapt.value_log(spark, d))
    middle = log.agg(F.max("log_position")).first()[0] // 2
    damaged = F.col("log_position") == middle
    kept = LogStore(spark, scratch_path(spark, "store"))
    kept.write_log(log.withColumn("source_class", F.when(damaged, "changed").otherwise(F.col("source_class"))))
    reached = kept.publish(END, "0")
    return kept.pending_violations(END, "0").select(F.lit(reached).cast("long").alias("reached"), "log_position", "check", "message")


@registry.add("stepped_back_times", W(R, " SELECT 'recorded_at' AS \"check\", event_id AS location FROM rows_ WHERE log_position%199=7"))
def stepped_back_times(spark, d):
    """Events whose recorded time lies before that of the event before them."""
    log = cut_lineage(adapt.value_log(spark, d))
    early = F.col("log_position") % 199 == 7
    bent = log.withColumn("recorded_at", F.when(early, F.lit("2024-01-31T23:00:00Z")).otherwise(F.col("recorded_at")))
    return audit.log_audit(audit.Store(*L.split(bent), log.select("log_position", "event_id").limit(0))).where("check = 'recorded_at'").select(
        "check", "location")


@registry.add("malformed_requests", W(R, """, bad AS (SELECT n, event_id, CASE n%41 WHEN 3 THEN ['occurred_at'] WHEN 5 THEN ['source'] WHEN 7 THEN ['source.actor_id']
 WHEN 11 THEN ['source.config'] WHEN 13 THEN ['redaction'] WHEN 17 THEN ['payload'] WHEN 19 THEN ['occurred_at','payload'] ELSE [] END AS checks FROM rows_)
 SELECT unnest(checks) AS "check", event_id AS location FROM bad"""))
def malformed_requests(spark, d):
    """Requests refused for their shape: times without an offset, sources, redaction, payloads."""
    n = F.col("log_position") - 1
    kind = lambda *k: (n % 41).isin(*k)
    rows = _rows(spark, d).withColumn("occurred_at", F.when(kind(3, 19), F.substring("occurred_at", 1, 19)).otherwise(F.col("occurred_at")))
    rows = rows.withColumn("source", F.when(kind(5), "[]").when(kind(7), '{"actor_id":"","config":{}}').when(
        kind(11), '{"actor_id":"u","config":[]}').otherwise(F.col("source")))
    rows = rows.withColumn("redacted", F.col("redacted") | kind(13)).withColumn(
        "ciphertext", F.when(kind(17, 19), '"text"').otherwise(F.col("ciphertext")))
    return integrity.unpack(rows, integrity.pack(integrity.request_checks()), F.col("event_id")).select("check", "location")


@registry.add("malformed_hashes", """SELECT event_id, event_id%6 IN (0,1) AS valid FROM events""")
def malformed_hashes(spark, d):
    """SHA-256 digests told from other texts: capitals, other lengths, other letters, a line end, absent ones."""
    n, h = F.col("event_id"), F.sha2(F.col("event_id").cast("string"), 256)
    text = (F.when(n % 6 <= 1, h).when(n % 6 == 2, F.upper(F.concat(F.lit("a"), F.substring(h, 2, 63)))).when(n % 6 == 3, F.substring(h, 1, 63))
            .when(n % 6 == 4, F.concat(F.substring(h, 1, 63), F.lit("g"))).when(n % 12 == 5, F.concat(h, F.lit("\n"))))
    return adapt.table(spark, d, "events").select("event_id", F.coalesce(C.valid_hash(text), F.lit(False)).alias("valid"))


@registry.add("published_overview", W(R, " SELECT count(*) AS event_count, '0' AS projectors, max(log_position) AS reached FROM rows_"))
def published_overview(spark, d):
    """A store's event count and the projectors that have published from it."""
    kept = LogStore(spark, scratch_path(spark, "store"))
    kept.write_log(adapt.value_log(spark, d))
    reached = kept.publish(END, "0", verify=False)
    return kept.overview().select("event_count", F.array_join("projector_versions", ",").alias("projectors"), F.lit(reached).cast("long").alias("reached"))


@registry.add("missing_payload_audit", W(R, """ SELECT event_id AS location, CASE WHEN log_position%101=5 THEN 'missing payload row'
 ELSE 'redacted payload replay is not implemented' END AS message FROM rows_ WHERE log_position%101=5 OR log_position%103=6
 UNION ALL SELECT 'ghost-'||event_id, 'orphan payload row' FROM rows_ WHERE log_position%107=7"""))
def missing_payload_audit(spark, d):
    """Absent, redacted and orphan payload rows."""
    events, payloads = L.split(cut_lineage(adapt.value_log(spark, d)))
    at = events.select("event_id", "log_position")
    rows = payloads.join(at, "event_id").where("log_position % 101 <> 5").withColumn("redacted", F.col("log_position") % 103 == 6)
    ghosts = rows.where("log_position % 107 = 7").withColumn("event_id", F.concat(F.lit("ghost-"), "event_id"))
    # The ghost of a missing payload does not exist either.
    extra = at.where("log_position % 107 = 7 and log_position % 101 = 5").select(
        F.concat(F.lit("ghost-"), "event_id").alias("event_id"), F.lit(None).cast("string").alias("payload_hash"),
        F.lit(None).cast("string").alias("canonical_entity_id"), F.lit(None).cast("string").alias("ciphertext"), F.lit(False).alias("redacted"))
    stored = rows.drop("log_position").unionByName(ghosts.drop("log_position")).unionByName(extra)
    found = integrity.row_violations(L.join_payloads(events, stored)).unionByName(integrity.orphan_violations(events, stored))
    return found.select("location", "message")


@registry.add("duplicate_identities", W(R, " SELECT event_id AS location, 'duplicate event_id' AS message FROM rows_ WHERE log_position%109=8"
              " UNION ALL SELECT sha256(actor||chr(31)||occurred_at||chr(31)||ciphertext), 'duplicate idempotency_key' FROM rows_ WHERE log_position%109=8"))
def duplicate_identities(spark, d):
    """Event IDs and idempotency keys recorded twice."""
    log = cut_lineage(adapt.value_log(spark, d))
    twice = log.unionByName(log.where("log_position % 109 = 8"))
    return integrity.duplicate_violations(twice).select("location", "message")


@registry.add("same_content_events", W(R, """, k AS (SELECT sha256('{"value":"'||value||'"}') AS payload_hash, * FROM rows_)
 SELECT payload_hash, count(*) AS events, count(DISTINCT source_class) AS source_classes, min(log_position) AS first_position FROM k
 GROUP BY payload_hash HAVING count(*)>1"""))
def same_content_events(spark, d):
    """Contents stated by several events, with their independent source classes."""
    rows = adapt.value_requests(spark, d)
    return L.same_content(rows.withColumn("payload_hash", C.payload_hash(C.json_object(value=C.json_string(F.col("value"))))))


@registry.add("corroborated_contents", W(R, """, k AS (SELECT sha256('{"value":"'||value||'"}') AS payload_hash, * FROM rows_)
 SELECT payload_hash, count(DISTINCT source_class) AS source_classes, CAST(count(*) AS BIGINT) AS events FROM k GROUP BY payload_hash
 HAVING count(DISTINCT source_class)>=2"""))
def corroborated_contents(spark, d):
    """Contents that pass the corroboration gate."""
    rows = adapt.value_requests(spark, d)
    return signals.corroborated(rows.withColumn("payload_hash", C.payload_hash(C.json_object(value=C.json_string(F.col("value"))))))


@registry.add("latest_event_per_belief", W(HL, """ SELECT belief_id, max(log_position) AS log_position, arg_max(event_id,log_position) AS event_id,
 arg_max(event_hash,log_position) AS event_hash FROM log GROUP BY belief_id"""))
def latest_event_per_belief(spark, d):
    """Append-side freshness: latest event of each belief."""
    return freshness.latest_by_belief(adapt.value_log(spark, d)).select("belief_id", "latest.*")


_HALF = "(SELECT max(log_position)//2 FROM rows_)"


def _published_half(log):
    """The first half of a log and its progress row (applied position and event)."""
    half = log.agg(F.floor(F.max("log_position") / 2).alias("_half"))
    prefix = log.crossJoin(F.broadcast(half)).where(F.col("log_position") <= F.col("_half")).drop("_half")  # one row
    return prefix, L.tip(prefix.withColumn("event_hash", F.lit(""))).select("log_position", "event_id")


@registry.add("value_status", W(R, f""", a AS (SELECT belief_id, max(log_position) FILTER (log_position<={_HALF}) AS applied,
 max(log_position) AS latest_position FROM rows_ GROUP BY belief_id)
 SELECT belief_id, applied IS NOT NULL AS present, latest_position, latest_position>{_HALF} AS stale,
 CASE WHEN latest_position>{_HALF} THEN 'stale' ELSE 'fresh' END AS freshness_state FROM a"""))
def value_status(spark, d):
    """Beliefs of a half-published view with their staleness."""
    log = _rows(spark, d).withColumn("event_hash", F.lit(""))
    prefix, progress = _published_half(log)
    names = values.value_events(log).select("belief_id")
    return freshness.value_status(log, values.fold(prefix, END), progress, names).select(
        "belief_id", "present", "latest_position", "stale", "freshness_state")


@registry.add("projection_status", W(R, f""" SELECT '0' AS projector_version, {_HALF} AS applied_position,
 (SELECT event_id FROM rows_ WHERE log_position={_HALF}) AS applied_event_id, max(log_position) AS latest_position,
 arg_max(event_id,log_position) AS latest_event_id, true AS stale, 'stale' AS freshness_state FROM rows_"""))
def projection_status(spark, d):
    """Applied progress of a half-published view against the log tip."""
    log = _rows(spark, d).withColumn("event_hash", F.lit(""))
    prefix, progress = _published_half(log)
    return freshness.projection_status(log, progress, values.fold(prefix, END), "0")


@registry.add("staleness_truth", W(R, """, s AS (SELECT log_position, CASE WHEN n%3=0 THEN NULL ELSE n%7 END AS applied,
 CASE WHEN n%5=0 THEN NULL ELSE n%11 END AS latest, n%2=0 AS present, n%13<>0 AS valid FROM rows_)
 SELECT log_position, NOT valid OR (present AND applied IS NULL) OR (latest IS NOT NULL AND (NOT present OR latest>coalesce(applied,0))) AS stale FROM s"""))
def staleness_truth(spark, d):
    """Staleness of every combination of progress, latest append, presence and validity."""
    n = F.col("event_id")
    e = adapt.table(spark, d, "events")
    return e.select((n + 1).alias("log_position"), freshness.is_stale(
        F.when(n % 3 != 0, n % 7), F.when(n % 5 != 0, n % 11), n % 2 == 0, n % 13 != 0).alias("stale"))


@registry.add("incremental_equals_replay", W(HL, """ SELECT belief_id, arg_max(value,{'i':occurred_us,'p':log_position}) AS current_value,
 count(*) AS support_count, count(*) FILTER (event_type='correction_appended') AS superseding_count,
 list_reduce(list(event_hash ORDER BY log_position), lambda a,x: sha256(a||x), '') AS view_version_hash FROM log GROUP BY belief_id"""))
def incremental_equals_replay(spark, d):
    """Publish half the log, then the rest: the view of the whole log, lineage included."""
    log = cut_lineage(adapt.value_log(spark, d))
    half = log.agg(F.floor(F.max("log_position") / 2)).first()[0]
    first = store.merge_values({}, log.where(F.col("log_position") <= half), LATE)
    first = {k: cut_lineage(v) for k, v in first.items()}
    second = store.merge_values(first, log.where(F.col("log_position") > half), LATE)
    return second["beliefs"].select("belief_id", F.col("head.value").alias("current_value"), "support_count",
                                    "superseding_count", "view_version_hash")


@registry.add("stored_view_differences", W(R, """, f AS (SELECT belief_id, row_number() OVER (ORDER BY belief_id) AS k FROM (SELECT DISTINCT belief_id FROM rows_))
 SELECT belief_id AS location, CASE WHEN substr(sha256(belief_id),1,1)='0' THEN 'missing from stored view' ELSE 'stored content differs from log' END AS message
 FROM f WHERE substr(sha256(belief_id),1,1) IN ('0','1')"""))
def stored_view_differences(spark, d):
    """A stored view with lost and changed rows against its log."""
    view = values.fold(_rows(spark, d), END).drop("undecided")
    digit = F.substring(F.sha2("belief_id", 256), 1, 1)
    stored = view.where(digit != "0").withColumn("current_value", F.when(digit == "1", "tampered").otherwise(F.col("current_value")))
    return reads.differences(view, stored, "belief_id").select("location", "message")


@registry.add("dangling_references", W(R, " SELECT 'gone-'||event_id AS location FROM rows_ WHERE n%113=9"))
def dangling_references(spark, d):
    """Support members that name events the log does not have."""
    log = _rows(spark, d)
    members = values.support(log, END).withColumn("event_id", F.when(
        (F.col("log_position") - 1) % 113 == 9, F.concat(F.lit("gone-"), "event_id")).otherwise(F.col("event_id")))
    holder = audit.Store(log, log, log.select("log_position", "event_id").limit(0))
    return audit.missing_references(holder, members).select("location")


@registry.add("pending_events", W(R, f" SELECT event_id AS location FROM rows_ WHERE log_position>{_HALF}"))
def pending_events(spark, d):
    """Events after the published position."""
    log = _rows(spark, d)
    _, progress = _published_half(log)
    return audit.pending(audit.Store(log, log, progress)).select("location")


@registry.add("dependency_hashes", W(HL, """ SELECT chain_id, sha256('["'||array_to_string(list(event_hash ORDER BY event_hash),'","')||'"]') AS dep_hash
 FROM log GROUP BY chain_id"""))
def dependency_hashes(spark, d):
    """Hash over the event hashes of each chain (at most 64 each)."""
    log = adapt.value_log(spark, d)
    return log.groupBy("chain_id").agg(C.dependency_hash(F.collect_list("event_hash")).alias("dep_hash"))


@registry.add("canonical_sets", """SELECT user_id, '["'||array_to_string(list(DISTINCT event_type ORDER BY event_type),'","')||'"]' AS members
 FROM events GROUP BY user_id""")
def canonical_sets(spark, d):
    """Distinct members of a set in canonical byte order, as canonical JSON."""
    e = adapt.table(spark, d, "events")
    texts = C.canonical_set(F.collect_set(C.json_string(F.col("event_type"))))
    return e.groupBy("user_id").agg(C.json_array_of(texts).alias("members"))


@registry.add("routes_and_keys", """SELECT event_id, sha256('"user:'||user_id||'"') AS route,
 '["user:'||user_id||'","'||event_type||'"]' AS pair, 'repo-path:["library","doc/'||event_id||'"]' AS scope FROM events""")
def routes_and_keys(spark, d):
    """Routing digits, pair keys and scope texts."""
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    return adapt.table(spark, d, "events").select(
        "event_id", C.route(user).alias("route"), C.pair_key(user, F.col("event_type")).alias("pair"),
        C.subject_scope(F.lit("library"), F.concat(F.lit("doc/"), F.col("event_id").cast("string"))).alias("scope"))


@registry.add("strict_json_refusals", """SELECT event_id, CASE event_id%5 WHEN 1 THEN 'duplicate JSON key ''k''' WHEN 2 THEN 'nonfinite NaN'
 WHEN 3 THEN 'invalid JSON' END AS error, CASE event_id%5 WHEN 1 THEN '$.k' WHEN 2 THEN '$.k' END AS path FROM events""")
def strict_json_refusals(spark, d):
    """Strict parsing of payload texts with duplicate keys, NaN or broken syntax."""
    n, p = F.col("event_id"), F.col("props")
    text = (F.when(n % 5 == 1, F.concat(F.lit('{"k":1,'), F.expr("substring(props, 2)"))).when(n % 5 == 2, F.lit('{"k":NaN}'))
            .when(n % 5 == 3, F.concat(p, F.lit("}"))).otherwise(p))
    return adapt.table(spark, d, "events").select("event_id", text.alias("t")).select(
        "event_id", jsontext.strict_json(F.col("t")).alias("s")).select(
        "event_id", F.col("s.error").alias("error"), F.col("s.faults")[0]["path"].alias("path"))


@registry.add("canonical_json_texts", """SELECT event_id, '{"k":'||json_extract_string(props,'$.k')||',"t":"'||event_type||'","z":[1,2]}' AS text FROM events""")
def canonical_json_texts(spark, d):
    """Canonical form of JSON texts with spaces and unsorted keys."""
    text = F.concat(F.lit('{"z": [1, 2], "t": "'), F.col("event_type"), F.lit('", '), F.expr("substring(props, 2)"))
    return adapt.table(spark, d, "events").select("event_id", text.alias("t")).select(
        "event_id", jsontext.canonical_json(F.col("t")).alias("text"))


@registry.add("audit_priorities", """SELECT user_id, CAST(count(*)*2 + max(event_id)%30 + CASE WHEN count(DISTINCT event_type)=1 THEN 3 ELSE 0 END
 + CASE WHEN min(event_id)%2=0 THEN 3 ELSE 0 END AS BIGINT) AS priority FROM events GROUP BY user_id ORDER BY priority DESC, user_id LIMIT 100""")
def audit_priorities(spark, d):
    """Report: the beliefs to audit first, by weighted score."""
    e = adapt.table(spark, d, "events").groupBy("user_id").agg(
        (F.max("event_id") % 30).alias("days"), F.count(F.lit(1)).alias("refs"),
        (F.countDistinct("event_type") == 1).alias("single"), (F.min("event_id") % 2 == 0).alias("low"))
    scored = e.select("user_id", signals.audit_priority(F.col("days"), F.col("refs"), F.col("single"), F.col("low")).alias("priority"))
    return signals.audit_queue(scored, "user_id", 100)


_DAYS = """WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type FROM events),
 d AS (SELECT CAST(k AS DATE) AS day, count(event_type) AS n, count(*) FILTER (event_type='error') AS bad
 FROM (SELECT unnest(generate_series(min(day),max(day),INTERVAL 1 DAY)) AS k FROM c) k LEFT JOIN c ON c.day=CAST(k AS DATE) GROUP BY 1)"""


def _daily(spark, d):
    """Events by day."""
    day = F.to_date("ts")
    return adapt.table(spark, d, "events").groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("intake"), F.count_if(F.col("event_type") == "error").alias("bad"))


@registry.add("contradiction_alerts", _DAYS + """ SELECT strftime(day,'%Y-%m-%d') AS day, bad AS open_contradictions,
 coalesce(bad > avg(bad) OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) * 1.1, false) AS alert FROM d""")
def contradiction_alerts(spark, d):
    """Days with unusually many open contradictions against the week before."""
    daily = _daily(spark, d).select("day", F.col("bad").alias("open_contradictions"))
    return signals.contradiction_alerts(daily, 1.1).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "open_contradictions", "alert")


@registry.add("intake_alerts", _DAYS + """ SELECT strftime(day,'%Y-%m-%d') AS day, bad AS false_positives, n AS intake,
 sum(bad) OVER w * 5 > sum(n) OVER w AS alert FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def intake_alerts(spark, d):
    """Days whose week of false positives exceeds a fifth of its intake."""
    daily = _daily(spark, d).withColumnRenamed("bad", "false_positives")
    return signals.intake_alerts(daily, 0.2).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "false_positives", "intake", "alert")


_STATES = "(['unverified','verified','questioned','quarantined'])"


@registry.add("state_changes", f"""WITH s AS (SELECT event_id, {_STATES}[event_id%4+1] AS f, CASE WHEN event_id%9=0 THEN 'redacted'
 ELSE {_STATES}[event_id//4%4+1] END AS t, event_id%3=0 AS o, event_id%2=0 AS off FROM events)
 SELECT event_id, CASE WHEN t='redacted' THEN true WHEN (f,t) IN (('unverified','verified'),('questioned','verified'),('quarantined','questioned'))
 THEN o AND NOT off WHEN (f,t) IN (('unverified','questioned'),('verified','questioned'),('questioned','quarantined')) THEN true ELSE false END AS allowed FROM s""")
def state_changes(spark, d):
    """Whether each requested state change is permitted."""
    n = F.col("event_id")
    states = F.array(*[F.lit(s) for s in ("unverified", "verified", "questioned", "quarantined")])
    rows = adapt.table(spark, d, "events").select(
        "event_id", F.element_at(states, (n % 4 + 1).cast("int")).alias("from_state"),
        F.when(n % 9 == 0, "redacted").otherwise(F.element_at(states, (F.floor(n / 4) % 4 + 1).cast("int"))).alias("to_state"),
        (n % 3 == 0).alias("has_world_oracle"), (n % 2 == 0).alias("offline"))
    return signals.state_change_allowed(rows).select("event_id", "allowed")


@registry.add("confidence_ceilings", f"""WITH s AS (SELECT event_id, event_id%4 AS o, (event_id%10)/10.0::DOUBLE AS a, (event_id%7)/7.0::DOUBLE AS b FROM events)
 SELECT event_id, CAST(round(least(o/3.0::DOUBLE, a, b)*1000000) AS BIGINT) AS ceiling_ppm FROM s""")
def confidence_ceilings(spark, d):
    """Weakest link of a claim's state and its identity links."""
    n = F.col("event_id")
    states = F.array(*[F.lit(s) for s in ("quarantined", "questioned", "unverified", "verified")])
    links = F.array((n % 10) / F.lit(10.0), (n % 7) / F.lit(7.0))
    value = signals.effective_confidence(F.element_at(states, (n % 4 + 1).cast("int")), links)
    return adapt.table(spark, d, "events").select("event_id", F.round(value * 1000000).cast("long").alias("ceiling_ppm"))


@registry.add("dense_positions", W(S.SUBMITTED_ROWS, """ SELECT event_id, row_number() OVER (ORDER BY log_position) AS position FROM rows_
 WHERE verifiability<>'unknowable'"""))
def dense_positions(spark, d):
    """Dense positions of the kept requests, in two passes."""
    rows = adapt.value_requests(spark, d, submitted=True).where("verifiability <> 'unknowable'")
    return segments.dense_positions(rows.select("event_id", F.col("log_position").alias("submitted")), "submitted", "position").select(
        "event_id", "position")
