"""Queries over the log and the state: S, P, H, A and W of the inventory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factlog.functions import values
from factlog.functions.constants import SECRET_RULES
from factlog.operators import activation, projection, snapshots, state, write
from factlog.plans import views as v
from factlog.plans.views import sql
from factlog.session import PREFIX, shared_dir, spread
from factlog.sources import log

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        Q[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


_BODY = """'{"tx":"' || tx || '","ts":"' || ts || '","actor":"' || actor || '","op":"' || op || '","e":"' || e || '","a":"' || a || '","v":' || v || ',"src":"' || src || '","invocation_id":"' || invocation_id || '"'"""


def lines(s, d):
    """The facts as a log: sealed lines in seven segments."""
    return log.to_lines(v.facts(s, d)).selectExpr("file", "cast(tx as bigint) AS line_no", "line")


@query("s1_scan", sql(f"SELECT file, tx, ts, actor, op, e, a, v, src, invocation_id, sha256({_BODY} || '}}') AS checksum FROM facts", "facts"))
def s1(s, d):
    return log.scan(lines(s, d)).drop("line_no")


@query("s1_read_files", sql("SELECT tx, e, a, v, true AS ok FROM facts", "facts"))
def s1_files(s, d):
    """The facts as segments of text in the shared folder, read again."""
    path = f"{shared_dir(s)}/{PREFIX}segments-{uuid.uuid4().hex}"
    log.write_export(v.facts(s, d), path)
    lines = log.verify(log.read_lines(s, path))
    return log.scan(lines).select("tx", "e", "a", "v", "ok")


@query("s2_ordered", sql("SELECT tx, file, row_number() OVER (PARTITION BY file ORDER BY tx) AS n FROM facts", "facts"))
def s2(s, d):
    return log.ordered(v.facts(s, d)).selectExpr("tx", "file", "cast(row_number() over (partition by file order by tx) as bigint) AS n")


@query("s3_seal", sql(f"SELECT tx, sha256({_BODY} || '}}') AS checksum FROM facts", "facts"))
def s3(s, d):
    return log.seal(v.facts(s, d)).select("tx", "checksum")


@query("s4_verify", sql("SELECT file, count(*) AS n, count(*) FILTER (CAST(tx AS BIGINT) % 100 <> 7) AS good FROM facts GROUP BY file", "facts"))
def s4(s, d):
    tampered = lines(s, d).withColumn("line", F.when(F.col("line_no") % 100 == 7, F.replace("line", F.lit('"v":'), F.lit('"v":1'))).otherwise(F.col("line")))
    return log.verify(tampered).groupBy("file").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))


def broken(s, d):
    """Segments 1 and 3 with a fault each: a tampered value, and a line that is no JSON."""
    bad = F.when((F.col("file") == "segment1") & (F.col("line_no") > 500), F.replace("line", F.lit('"v":'), F.lit('"v":1'))).when((F.col("file") == "segment3") & (F.col("line_no") > 700), F.lit("{")).otherwise(F.col("line"))
    return lines(s, d).withColumn("line", bad)


@query("s5_faults", sql("SELECT file, min(CAST(tx AS BIGINT)) AS line_no, CASE file WHEN 'segment1' THEN 'BAD_CHECKSUM' ELSE 'BAD_JSON' END AS fault FROM facts WHERE (file = 'segment1' AND CAST(tx AS BIGINT) > 500) OR (file = 'segment3' AND CAST(tx AS BIGINT) > 700) GROUP BY file", "facts"))
def s5(s, d):
    return log.faults(broken(s, d))


@query("s6_quarantine", sql("SELECT file, count(*) AS n FROM facts WHERE file NOT IN ('segment1', 'segment3') GROUP BY file", "facts"))
def s6(s, d):
    return log.healthy(broken(s, d), log.faults(broken(s, d))).groupBy("file").agg(F.count("*").alias("n"))


@query("s7_collisions", sql(", t AS (SELECT lpad(CAST(CAST(tx AS BIGINT) // 3 AS VARCHAR), 26, '0') AS tx, file FROM facts) SELECT tx, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM t GROUP BY tx HAVING count(DISTINCT file) > 1", "facts"))
def s7(s, d):
    shifted = v.facts(s, d).selectExpr("lpad(cast(cast(tx as bigint) div 3 as string), 26, '0') AS tx", "file")
    return log.collisions(shifted).select("tx", F.array_join("files", ",").alias("files"))


@query("s8_append_check", sql(", g AS (SELECT e AS grp, count(*) AS n, min(tx) AS tx, CASE WHEN count(DISTINCT tx) > 1 THEN 'MIXED_TX' WHEN count(*) FILTER (op = 'retract') > 0 THEN 'UNSEALED' END AS shape FROM facts GROUP BY e), b AS (SELECT *, max(tx) FILTER (shape IS NULL) OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) SELECT grp, n, CASE WHEN shape IS NOT NULL THEN shape WHEN tx <= greatest(lpad('500', 26, '0'), coalesce(before, '')) THEN 'TX_NOT_GREATER' END AS error FROM b", "facts"))
def s8(s, d):
    f = log.seal(v.facts(s, d)).withColumn("checksum", F.when(F.col("op") != "retract", F.col("checksum")))
    return log.check_group(f.withColumn("grp", F.col("e")), "500".rjust(26, "0"))


_GROUPS = "lpad(CAST(CAST(tx AS BIGINT) + 2 - 2 * (CAST(tx AS BIGINT) % 3) AS {}), 26, '0')"


@query("s8_append", sql(f", g AS (SELECT *, {_GROUPS.format('VARCHAR')} AS grp FROM facts), b AS (SELECT *, max(tx) FILTER (op <> 'retract') OVER (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) SELECT tx, e, a, v FROM b WHERE op <> 'retract' AND (before IS NULL OR tx > before)", "facts"))
def s8_append(s, d):
    """Every fact is a group; in each three of them the last comes first, so two of three are late, and retractions come unsealed. Three batches, one of them sent twice."""
    f = log.seal(v.facts(s, d)).drop("file").withColumn("checksum", F.when(F.col("op") != "retract", F.col("checksum"))).withColumn("grp", F.expr(_GROUPS.format("STRING")))
    table = log.FactTable(s, f"{shared_dir(s).rstrip('/')}/{PREFIX}log-{uuid.uuid4().hex}")
    for batch, (low, high) in enumerate([("0", "1998"), ("1998", "3999"), ("3999", "9" * 26)]):
        part = f.where((F.col("tx") >= low.rjust(26, "0")) & (F.col("tx") < high.rjust(26, "0")))
        for _ in range(1 + (batch == 1)):
            table.append(part, batch)
    return table.read().select("tx", "e", "a", "v")


@query("s9_merge", sql("SELECT tx, e, a, v FROM facts WHERE file IN ('segment2', 'segment3')", "facts"))
def s9(s, d):
    f = v.facts(s, d)
    return log.merge_new(f.where("file IN ('segment1', 'segment2', 'segment3')"), f.where("file IN ('segment0', 'segment1')")).select("tx", "e", "a", "v")


@query("s10_validate", sql("SELECT count(*) AS datoms, count(DISTINCT tx) AS txs FROM facts", "facts"))
def s10(s, d):
    return log.import_counts(log.scan(lines(s, d)))


@query("s11_export", sql(f"SELECT {_BODY} || ',\"checksum\":\"' || sha256({_BODY} || '}}') || '\"}}' AS line FROM facts WHERE tx > lpad('100', 26, '0')", "facts"))
def s11(s, d):
    return log.export(v.facts(s, d), "100".rjust(26, "0"))


@query("s12_import", sql("""SELECT doc_id AS line_no, CASE doc_id % 5 WHEN 0 THEN 'drawer' WHEN 1 THEN 'diary' WHEN 2 THEN 'drawer' WHEN 3 THEN 'shelf' ELSE 'x' END AS was,
    CASE doc_id % 5 WHEN 0 THEN 'Observation' WHEN 1 THEN 'SessionReflection' WHEN 2 THEN 'Observation' END AS kind, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 2 = 0 THEN project ELSE 'imported' END AS project,
    CASE doc_id % 5 WHEN 4 THEN 'PARSE' WHEN 3 THEN 'UNKNOWN_KIND' WHEN 2 THEN 'EMPTY_BODY' END AS reason FROM entries""", "entries"))
def s12(s, d):
    e = v.entries(s, d)
    was = F.element_at(F.array(*map(F.lit, ["drawer", "diary", "drawer", "shelf", "x"])), (F.col("doc_id") % 5 + 1).cast("int"))
    record = F.to_json(F.struct(was.alias("kind"), F.col("e").alias("id"), F.when(F.col("doc_id") % 5 == 2, " ").otherwise("b").alias("body"), F.when(F.col("doc_id") % 2 == 0, F.col("project")).alias("project"), F.create_map(F.lit("project"), F.lit("never")).alias("tags")))
    rows = e.select(F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 5 == 4, "{oops").otherwise(record).alias("line"), was.alias("was"))
    out = log.import_records(rows)
    return out.join(rows.select("line_no", "was"), "line_no").select("line_no", "was", "kind", F.when(F.col("reason").isNull() | (F.col("reason") != "PARSE"), F.col("facets")["project"]).alias("project"), "reason")


@query("s14_fetch_vectors", sql("SELECT id AS entity_id, len(embedding) AS dim FROM vectors WHERE vec_id % 3 = 0", "vectors"))
def s14(s, d):
    x = v.vectors(s, d)
    return log.fetch_vectors(x.withColumnRenamed("id", "entity_id"), x.where("vec_id % 3 = 0").select(F.col("id").alias("entity_id"))).select("entity_id", F.size("embedding").cast("long").alias("dim"))


_LAST = "last AS (SELECT e, a, arg_max(v, tx) AS v, arg_max(op, tx) AS op, max(tx) AS tx FROM facts GROUP BY e, a)"


@query("p1_latest", sql(f", {_LAST} SELECT e, a, v, tx FROM last WHERE op <> 'retract'", "facts"))
def p1(s, d):
    return state.latest(v.facts(s, d))


@query("p2_collapse", sql("SELECT a, count(*) AS n, max(tx) AS tx FROM (SELECT *, row_number() OVER (PARTITION BY e, a ORDER BY tx DESC) AS r FROM activation_facts) WHERE r = 1 OR a = 'encoding_at' GROUP BY a", "activation_facts"))
def p2(s, d):
    return state.collapse(v.activation_facts(s, d)).groupBy("a").agg(F.count("*").alias("n"), F.max("tx").alias("tx"))


@query("p3_entities", sql(f", {_LAST}, kept AS (SELECT e, string_agg(a || '=' || v, ',' ORDER BY a) AS attrs FROM last WHERE op <> 'retract' GROUP BY e) SELECT f.e, 'Entry' AS label, coalesce(attrs, '') AS attrs, max(tx) AS last_tx FROM facts f LEFT JOIN kept USING (e) GROUP BY f.e, attrs", "facts"))
def p3(s, d):
    return state.entities(v.facts(s, d)).select("e", "label", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("attrs"), "last_tx")


def tombstoned(s, d):
    """The facts with `error` read as the attribute `exists`."""
    return v.facts(s, d).withColumn("a", F.when(F.col("a") == "error", "exists").otherwise(F.col("a")))


@query("p4_tombstones", sql("SELECT e, bool_or(op = 'retract') AS retracted FROM facts GROUP BY e", "facts"))
def p4(s, d):
    return state.entities(tombstoned(s, d)).select("e", "retracted")


@query("p5_edges", sql(", m AS (SELECT e AS src, CASE a WHEN 'click' THEN 'IN_TRAIL' WHEN 'view' THEN 'ABOUT' WHEN 'purchase' THEN 'DERIVED_FROM' WHEN 'signup' THEN 'LINKED' END AS rel, 'x:' || (CAST(v AS BIGINT) % 5) AS dst, tx FROM facts WHERE op = 'add') SELECT src, rel, dst, max(tx) AS last_tx FROM m WHERE rel IS NOT NULL GROUP BY src, rel, dst", "facts"))
def p5(s, d):
    named = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "trail", "view", "Subject", "purchase", "DERIVED_FROM", "signup", "link.LINKED")]), F.col("a"))
    target = F.concat(F.lit("x:"), (F.col("v").cast("bigint") % 5).cast("string"))
    value = F.when(F.col("a") == "signup", F.concat(F.lit('{"target":"'), target, F.lit('","confidence":0.5}'))).otherwise(F.concat(F.lit('"'), target, F.lit('"')))
    f = v.facts(s, d).withColumn("v", value).withColumn("a", F.coalesce(named, F.lit("plain")))
    return state.edges(f).select("src", "rel", "dst", "last_tx")


@query("p6_labels", sql("SELECT p || ':' || doc_id AS id, l AS label FROM documents, (VALUES ('entry', 'Entry'), ('frame', 'Frame'), ('psi', 'PSI'), ('thing', 'Entity')) t(p, l)"))
def p6(s, d):
    names = F.explode(F.array(*map(F.lit, ["entry", "frame", "psi", "thing"]))).alias("p")
    return v.table(s, d, "documents").select("doc_id", names).select(F.concat_ws(":", "p", "doc_id").alias("id")).select("id", values.label_of("id").alias("label"))


SQL["p6_labels"] = SQL["p6_labels"].removeprefix("WITH  ")


@query("p7_names", "SELECT DISTINCT regexp_replace(regexp_replace(n, '[^A-Za-z0-9_]', '_', 'g'), '^([0-9])', '_\\1') AS graph_name, CASE WHEN n LIKE '\\_%' ESCAPE '\\' THEN 'p_' ELSE '' END || regexp_replace(regexp_replace(n, '[^A-Za-z0-9_]', '_', 'g'), '^([0-9])', 'p_\\1') AS vector_name FROM (SELECT unnest([p_type, p_size || 'x', '_' || p_brand]) AS n FROM part)")
def p7(s, d):
    n = v.table(s, d, "part").select(F.explode(F.array("p_type", F.concat("p_size", F.lit("x")), F.concat(F.lit("_"), "p_brand"))).alias("n"))
    return n.select(values.property_name("n").alias("graph_name"), values.vector_property_name("n").alias("vector_name")).distinct()


@query("p8_decode", "SELECT event_id, 'bigint' AS kind, CAST(user_id AS VARCHAR) AS text FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 'string', event_type FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 'boolean', 'true' FROM events WHERE event_id % 4 = 2 UNION ALL SELECT event_id, 'json', '{\"k\":' || user_id || '}' FROM events WHERE event_id % 4 = 3")
def p8(s, d):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat("user_id", F.lit(".0"))).when(k == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(k == 2, "true").otherwise(F.concat(F.lit('{"k": '), "user_id", F.lit("}")))
    kind, text = values.decoded("raw")
    return v.table(s, d, "events").withColumn("raw", raw).select("event_id", kind.alias("kind"), text.alias("text"))


@query("p9_documents", sql(f", {_LAST} SELECT f.e, count(DISTINCT x.id) AS vectors FROM (SELECT DISTINCT e FROM facts) f LEFT JOIN vectors x ON x.id = f.e GROUP BY f.e", "facts", "vectors"))
def p9(s, d):
    x = v.vectors(s, d).select(F.col("id").alias("entity_id"), "embedding")
    return state.documents(v.facts(s, d), x).select("e", F.col("embedding").isNotNull().cast("bigint").alias("vectors"))


@query("p10_object_ids", "WITH h AS (SELECT doc_id, sha1('factlog:entry:' || doc_id) AS h FROM documents) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h")
def p10(s, d):
    return v.table(s, d, "documents").select("doc_id", values.object_id(F.concat(F.lit("entry:"), "doc_id"), "factlog:").alias("id"))


@query("p11_replay", sql(f", {_LAST} SELECT e, a, op, v, tx FROM last", "facts"))
def p11(s, d):
    f = v.facts(s, d)
    mark = "4000".rjust(26, "0")
    return state.merge_latest(state.fold(state.as_of(f, mark)), state.fold(state.delta(f, mark)))


@query("p12_watermarks", sql("SELECT a AS target, max(tx) AS tx FROM facts GROUP BY a", "facts"))
def p12(s, d):
    f = v.facts(s, d).select(F.col("a").alias("target"), "tx")
    return state.advance(f.where("cast(tx as bigint) % 2 = 0"), f.where("cast(tx as bigint) % 2 = 1"))


@query("p13_rebuild", sql(f", {_LAST} SELECT count(DISTINCT e) AS entities, max(tx) AS tx FROM facts", "facts"))
def p13(s, d):
    from factlog.session import shared_dir

    places = state.rebuild(v.facts(s, d), shared_dir(s))
    return s.read.parquet(places["entities"]).agg(F.count("*").alias("entities"), F.max("last_tx").alias("tx"))


@query("p14_drift", sql("SELECT 'entry:' || user_id AS e, arg_max('m' || (CAST(round(value * 100) AS BIGINT) % 3), event_id) AS digest FROM events WHERE event_type = 'view' GROUP BY user_id HAVING digest <> 'm1'", "facts"))
def p14(s, d):
    return state.drift(digests(s, d), "m1")


def digests(s, d):
    return v.facts(s, d).where("a = 'view'").withColumn("v", F.concat(F.lit("m"), (F.col("v").cast("bigint") % 3).cast("string"))).withColumn("a", F.lit("embedding_model_digest"))


@query("p15_rebind", sql(", l AS (SELECT 'entry:' || user_id AS e, arg_max('m' || (CAST(round(value * 100) AS BIGINT) % 3), event_id) AS digest FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT e, 'model_rebind' AS a, '{\"from\":\"' || digest || '\",\"to\":\"m1\"}' AS v FROM l WHERE digest <> 'm1'", "facts"))
def p15(s, d):
    return state.rebind_facts(state.drift(digests(s, d), "m1"), "m1")


@query("p16_max_tx", sql("SELECT max(tx) AS max_tx FROM facts", "facts"))
def p16(s, d):
    return state.max_tx(v.facts(s, d))


@query("p17_statistics", sql("SELECT 'entries' AS name, CAST(count(DISTINCT e) AS VARCHAR) AS value FROM facts UNION ALL SELECT 'log_tx', max(tx) FROM facts UNION ALL SELECT 'quarantined', '2' UNION ALL SELECT 'lag:' || file, CAST((SELECT count(*) FROM facts g WHERE g.tx > m) AS VARCHAR) FROM (SELECT file, max(tx) FILTER (CAST(tx AS BIGINT) < 600) AS m FROM facts GROUP BY file)", "facts"))
def p17(s, d):
    f = v.facts(s, d)
    marks = f.where("cast(tx as bigint) < 600").groupBy(F.col("file").alias("target")).agg(F.max("tx").alias("tx"))
    return state.statistics(f, marks, log.faults(broken(s, d)))


@query("h1_history", sql("SELECT tx, op, a, v FROM facts WHERE e = 'entry:7'", "facts"))
def h1(s, d):
    return state.history(v.facts(s, d), "entry:7").select("tx", "op", "a", "v")


@query("h2_as_of", sql("SELECT e, min(tx) AS tx FROM facts WHERE tx <= lpad('300', 26, '0') GROUP BY e", "facts"))
def h2(s, d):
    return state.introduced(v.facts(s, d), "300".rjust(26, "0"))


@query("h3_as_of_state", sql(", last AS (SELECT e, a, arg_max(v, tx) AS v, arg_max(op, tx) AS op, max(tx) AS tx FROM facts WHERE tx <= lpad('700', 26, '0') GROUP BY e, a) SELECT e, a, v, tx FROM last WHERE op <> 'retract'", "facts"))
def h3(s, d):
    return state.latest(state.as_of(v.facts(s, d), "700".rjust(26, "0")))


@query("h3_snapshots", sql(", last AS (SELECT e, a, arg_max(v, tx) AS v, arg_max(op, tx) AS op, max(tx) AS tx FROM facts WHERE tx <= lpad('700', 26, '0') GROUP BY e, a) SELECT e, a, v, tx FROM last WHERE op <> 'retract'", "facts"))
def h3_snapshots(s, d):
    """The same read from snapshots, which the log reached in two steps."""
    f = v.facts(s, d)
    n = f.count()
    kept = snapshots.Snapshots(s, f"{shared_dir(s).rstrip('/')}/{PREFIX}snapshots-{uuid.uuid4().hex}", max(100, n // 5))
    kept.extend(f.where(F.col("tx") <= "650".rjust(26, "0")))
    kept.extend(f)
    return kept.as_of("700".rjust(26, "0"))


@query("p13_projection", sql(", last AS (SELECT e, a, arg_max(v, tx) AS v, arg_max(op, tx) AS op, max(tx) AS tx FROM facts GROUP BY e, a) SELECT e, a, v, tx, (SELECT max(tx) FROM facts) AS watermark, '100' AS first, (SELECT CAST(count(*) - 101 AS VARCHAR) FROM facts) AS scanned FROM last WHERE op <> 'retract'", "facts"))
def p13_projection(s, d):
    """A rebuild up to a tx, then a replay of the rest by the stored watermark: latest values, watermark and counters as they are published together."""
    f = v.facts(s, d)
    p = projection.Projection(s, f"{shared_dir(s).rstrip('/')}/{PREFIX}projection-{uuid.uuid4().hex}")
    one = p.rebuild(state.as_of(f, "100".rjust(26, "0")))
    two = p.heal(f)
    return p.latest().select("*", F.lit(p.watermark()).alias("watermark"), F.lit(str(int(one.values["watermark"]))).alias("first"), F.lit(two.values["scanned"]).alias("scanned"))


@query("a1_state", sql("SELECT e, encoding_at, base_activation, retrieval_count, last_retrieved_at, evicted FROM states", "states"))
def a1(s, d):
    return activation.state(v.activation_facts(s, d)).drop("pinned", "pin_activation").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("encoding_at", "last_retrieved_at")})


@query("a2_decay", sql("SELECT e, round(activation, 9) AS activation FROM current_states", "states"))
def a2(s, d):
    return activation.state(v.activation_facts(s, d)).select("e", F.round(activation.current(v.now()), 9).alias("activation"))


@query("a3_visible", sql("SELECT e FROM current_states WHERE NOT evicted AND activation >= 1.5", "states"))
def a3(s, d):
    return activation.visible(activation.state(v.activation_facts(s, d)), v.now(), 1.5).select("e")


@query("a4_base_level", sql("SELECT 'entry:' || user_id AS e, round(ln(sum(pow((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 1e6, -0.5))), 9) AS base_level FROM events GROUP BY user_id", "facts"))
def a4(s, d):
    events = v.table(s, d, "events").select(F.concat(F.lit("entry:"), "user_id").alias("e"), F.col("ts").cast("timestamp").alias("at"))
    return activation.base_level(events, v.now()).select("e", F.round("base_level", 9).alias("base_level"))


@query("a5_importance", "SELECT event_id, round(value / 1000 + CASE WHEN user_id % 2 = 0 THEN 0.2 ELSE 0 END, 9) AS importance FROM events")
def a5(s, d):
    e = v.table(s, d, "events").withColumns({"boost": F.col("value") / 1000, "crossing": F.col("user_id") % 2 == 0})
    return e.select("event_id", F.round(activation.importance("boost", "crossing"), 9).alias("importance"))


@query("a6_composite", "SELECT l_orderkey, l_linenumber, round(0.3 * l_discount + 0.3 * l_tax + 0.3 * l_quantity + 0.1 * l_extendedprice, 6) AS score FROM lineitem")
def a6(s, d):
    return v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(activation.composite("l_discount", "l_tax", "l_quantity", "l_extendedprice"), 6).alias("score"))


@query("a7_seed", "SELECT event_id, CASE WHEN value / 100 > 0 AND value / 100 <= 1 THEN value / 100 ELSE 1.0 END AS base FROM events")
def a7(s, d):
    return v.table(s, d, "events").withColumn("want", F.col("value") / 100).select("event_id", activation.seed("want").alias("base"))


@query("a8_reinforce", sql(", n AS (SELECT 'entry:' || user_id AS e, count(*) AS times FROM events WHERE event_type = 'view' GROUP BY user_id), r AS (SELECT * FROM states JOIN n USING (e) WHERE NOT evicted) SELECT e, 'base_activation' AS a, '1' AS v FROM r UNION ALL SELECT e, 'retrieval_count', CAST(retrieval_count + times AS VARCHAR) FROM r UNION ALL SELECT e, 'last_retrieved_at', '\"2024-02-01T00:00:00.000000Z\"' FROM r", "states"))
def a8(s, d):
    surfaced = v.facts(s, d).where("a = 'view'").select("e")
    return activation.reinforce(activation.state(v.activation_facts(s, d)), surfaced, v.now())


def lifecycle(s, d, *actions):
    names = F.explode(F.array(*map(F.lit, actions))).alias("action")
    asked = v.table(s, d, "customer").select(F.concat(F.lit("entry:"), "c_custkey").alias("e"), names)
    return activation.lifecycle(activation.state(v.activation_facts(s, d)), asked, v.now())


_ASKED = "asked AS (SELECT 'entry:' || c_custkey AS e, action FROM customer, (VALUES {}) t(action)), r AS (SELECT asked.e, action, s.e AS found, s.evicted, s.base_activation, s.age FROM asked LEFT JOIN current_states s USING (e))"


@query("a9_pin", sql(", " + _ASKED.format("('pin'), ('unpin')") + """ SELECT e, action, CASE WHEN found IS NULL THEN 'ENTRY_NOT_FOUND' WHEN action = 'unpin' THEN 'NOT_PINNED' ELSE 'OK' END AS status, a, round(CASE WHEN a = 'pin_activation' THEN base_activation * pow(1 + coalesce(age, 0), -0.5) END, 6) AS pin, a = 'evicted_at_retracted' AS lifted
    FROM r, (VALUES ('pinned'), ('pin_activation'), ('evicted_at_retracted'), (NULL)) t(a) WHERE (a IS NULL) = (found IS NULL OR action = 'unpin') AND (a IS DISTINCT FROM 'evicted_at_retracted' OR evicted)""", "states"))
def a9(s, d):
    return lifecycle(s, d, "pin", "unpin").select("e", "action", "status", "a", F.when(F.col("a") == "pin_activation", F.round(F.col("v").cast("double"), 6)).alias("pin"), (F.col("a") == "evicted_at_retracted").alias("lifted"))


@query("a10_evict", sql(", " + _ASKED.format("('evict'), ('unevict')") + """, o AS (SELECT e, action, CASE WHEN found IS NULL THEN 'ENTRY_NOT_FOUND' WHEN action = 'evict' AND evicted THEN 'ALREADY_EVICTED' WHEN action = 'unevict' AND NOT evicted THEN 'NOT_EVICTED' ELSE 'OK' END AS status FROM r)
    SELECT e, action, status, a FROM o, (VALUES ('base_activation', 'evict'), ('evicted_at', 'evict'), ('evicted_at_retracted', 'unevict'), (NULL, NULL)) t(a, w) WHERE (status = 'OK' AND w = action) OR (status <> 'OK' AND w IS NULL)""", "states"))
def a10(s, d):
    return lifecycle(s, d, "evict", "unevict").select("e", "action", "status", "a")


@query("a11_unknown", sql("SELECT 'entry:' || c_custkey AS e FROM customer WHERE 'entry:' || c_custkey NOT IN (SELECT e FROM states)", "states"))
def a11(s, d):
    return lifecycle(s, d, "unpin").where("status = 'ENTRY_NOT_FOUND'").select("e")


@query("w1_validate", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'MISSING_KIND' WHEN 1 THEN 'REFLECTION_ONLY_KIND' WHEN 2 THEN 'UNKNOWN_KIND' WHEN 3 THEN 'EMPTY_BODY' WHEN 4 THEN 'MISSING_FACET' END AS error FROM documents""")
def w1(s, d):
    k = F.col("doc_id") % 6
    kind = F.when(k == 0, "").when(k == 1, "Principle").when(k == 2, "Nothing").otherwise("Observation")
    facets = F.when(k == 4, F.create_map(F.lit("domain"), F.lit("x"))).otherwise(F.create_map(F.lit("domain"), F.lit("x"), F.lit("project"), F.col("source")))
    return v.table(s, d, "documents").withColumns({"kind": kind, "body": F.when(k == 3, " ").otherwise("b"), "facets": facets}).select("doc_id", write.request_error().alias("error"))


_GENERIC = r"(?i)(password|secret|token|api[_-]?key)[^A-Za-z0-9]{1,5}[A-Za-z0-9/+=]{20,}"


@query("w2_secrets", f"WITH m AS (SELECT doc_id AS id, regexp_extract(text, '{_GENERIC}') AS m, text FROM documents WHERE regexp_matches(text, '{_GENERIC}')) SELECT id, 'generic_high_entropy_secret' AS rule, CAST(min(position(m IN text) - 1) AS BIGINT) AS start FROM m GROUP BY id")
def w2(s, d):
    found = write.secret_matches(v.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), SECRET_RULES, floor=0.0)
    return found.groupBy("id", "rule").agg(F.min("start").alias("start"))


@query("w3_entropy", "WITH b AS (SELECT item_id, unnest(string_split(text, '')) AS c FROM (SELECT p_partkey AS item_id, p_name AS text FROM part)), n AS (SELECT item_id, c, count(*) AS k FROM b GROUP BY item_id, c) SELECT item_id, round(-sum(k / t * log2(k / t)), 6) AS bits FROM (SELECT *, sum(k) OVER (PARTITION BY item_id) AS t FROM n) GROUP BY item_id")
def w3(s, d):
    return spread(v.table(s, d, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("item_id"), F.round(values.entropy("p_name"), 6).alias("bits"))


@query("w4_rules", "SELECT DISTINCT p_brand AS name, CASE WHEN p_size > 45 THEN 'BUILTIN_REDEFINED' END AS error FROM part WHERE p_size > 45 OR p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45) UNION ALL SELECT DISTINCT p_brand, NULL FROM part WHERE p_size > 45")
def w4(s, d):
    p = v.table(s, d, "part")
    builtin = p.where("p_size > 45").select(F.col("p_brand").alias("name")).distinct()
    return write.merged_rules(builtin, p.select(F.col("p_brand").alias("name")).distinct())


@query("w5_facets", "SELECT c_custkey, c_mktsegment AS segment, c_name || ':x' AS name, c_custkey % 4 = 0 AS malformed FROM customer")
def w5(s, d):
    text = F.concat(F.lit(" segment : "), "c_mktsegment", F.lit(", name:"), "c_name", F.lit(":x"), F.when(F.col("c_custkey") % 4 == 0, ",oops").otherwise(""))
    facets, bad = write.parse_facets("facets")
    return v.table(s, d, "customer").withColumn("facets", text).select("c_custkey", facets["segment"].alias("segment"), facets["name"].alias("name"), bad.alias("malformed"))


@query("w6_subjects", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'UNKNOWN_NAMESPACE' WHEN 2 THEN 'EMPTY_LOCAL_ID' ELSE 'UNKNOWN_NAMESPACE' END AS error FROM supplier")
def w6(s, d):
    k = F.col("s_suppkey") % 4
    subject = F.when(k == 0, F.concat(F.lit("lib/"), "s_name")).when(k == 1, F.concat(F.lit("nope/"), "s_name")).when(k == 2, "lib/").otherwise("plain")
    return v.table(s, d, "supplier").select("s_suppkey", values.subject_error(subject).alias("error"))


@query("w7_canonical", "SELECT 'lib/' || s_suppkey AS subject, 'lib/' || CASE WHEN s_suppkey < 90 THEN s_suppkey % 8 ELSE s_suppkey END AS canonical, s_suppkey < 90 AND (s_suppkey >= 8 OR s_suppkey + 8 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 90)) AS resolved FROM supplier")
def w7(s, d):
    sup = v.table(s, d, "supplier")
    aliases = sup.where("s_suppkey >= 8 AND s_suppkey < 90").selectExpr("concat('lib/', s_suppkey) AS alias", "concat('lib/', s_suppkey - 8) AS target")
    return write.canonical_subjects(sup.selectExpr("concat('lib/', s_suppkey) AS subject"), aliases).select("subject", "canonical", "resolved")


@query("w8_facts", """SELECT 'entry:' || c_custkey AS e, a, CASE a WHEN 'body' THEN '"' || c_name || '"' WHEN 'kind' THEN '"Observation"' WHEN 'facet.domain' THEN '"d"' WHEN 'facet.project' THEN '"' || c_mktsegment || '"' WHEN 'trail' THEN '"trail:1"' WHEN 'encoding_at' THEN '"2024-01-01T00:00:00Z"' ELSE '1.0' END AS v
    FROM customer, (VALUES ('body'), ('kind'), ('facet.domain'), ('facet.project'), ('trail'), ('encoding_at'), ('base_activation')) t(a) WHERE a <> 'trail' OR c_custkey % 2 = 0""")
def w8(s, d):
    none = F.lit(None).cast("string")
    asked = v.table(s, d, "customer").select(
        F.concat(F.lit("entry:"), "c_custkey").alias("e"), F.col("c_name").alias("body"), F.lit("Observation").alias("kind"), F.create_map(F.lit("project"), F.col("c_mktsegment"), F.lit("domain"), F.lit("d")).alias("facets"),
        none.alias("subject"), F.when(F.col("c_custkey") % 2 == 0, "trail:1").alias("trail"), none.alias("model"), none.alias("digest"), F.lit("2024-01-01T00:00:00Z").alias("encoding_at"), F.lit(1.0).alias("base"),
    )
    return write.observation_facts(asked).drop("seq")


@query("w9_dimensions", sql("SELECT id, CASE WHEN len(embedding) <> 64 OR vec_id % 5 = 0 THEN 'EMBEDDING_DIM_MISMATCH' END AS error FROM vectors", "vectors"))
def w9(s, d):
    x = v.vectors(s, d).withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return x.select("id", write.dimension_error(dim=64).alias("error"))


@query("w10_concepts", sql("SELECT src AS e, count(*) AS n, min(dst) AS first, max(dst) AS last FROM mentions GROUP BY src", "mentions"))
def w10(s, d):
    c = values.concepts("body")
    return v.entries(s, d).select("e", F.size(c).cast("long").alias("n"), F.concat(F.lit("concept:"), F.array_min(c)).alias("first"), F.concat(F.lit("concept:"), F.array_max(c)).alias("last")).where("n > 0")


@query("w11_mentions", sql("SELECT dst, count(*) AS n FROM mentions GROUP BY dst", "mentions"))
def w11(s, d):
    return v.mentions(s, d).groupBy("dst").agg(F.count("*").alias("n"))


@query("w15_redact", f"SELECT doc_id, CASE WHEN regexp_matches(text, '{_GENERIC}') THEN md5(regexp_replace(text, '{_GENERIC}', '[generic_high_entropy_secret]', 'g')) ELSE md5(text) END AS clean FROM documents")
def w15(s, d):
    rules = [(n, p, 0.0, x) for n, p, _, x in SECRET_RULES]
    return v.table(s, d, "documents").select("doc_id", F.md5(write.redact("text", rules)).alias("clean"))
