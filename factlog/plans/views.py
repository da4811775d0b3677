"""Views of the test tables as the engine's own: each as a DataFrame and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlog.functions.constants import LANGUAGES, STOPWORDS
from factlog.session import spread

NOW = "2024-02-01 00:00:00"

#: SQL of the views, to stand in a WITH clause. Those that use others follow them.
SQL = {
    "facts": """facts AS (SELECT lpad(CAST(event_id AS VARCHAR), 26, '0') AS tx, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts, 'user:' || user_id AS actor,
        CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'retract' ELSE 'add' END AS op, 'entry:' || user_id AS e, event_type AS a,
        CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS v, 'observe' AS src, 'run' || (event_id % 10) AS invocation_id, 'segment' || (event_id % 7) AS file FROM events)""",
    "activation_facts": """activation_facts AS (SELECT tx, e, 'add' AS op,
        CASE a WHEN 'click' THEN 'retrieval_count' WHEN 'view' THEN 'last_retrieved_at' WHEN 'purchase' THEN 'base_activation' WHEN 'signup' THEN 'encoding_at'
        ELSE CASE WHEN CAST(tx AS BIGINT) % 2 = 0 THEN 'evicted_at' ELSE 'evicted_at_retracted' END END AS a,
        CASE WHEN a IN ('click', 'purchase') THEN v ELSE ts END AS v FROM facts)""",
    "states": """last_value_of AS (SELECT e, a, arg_max(v, tx) AS v FROM activation_facts GROUP BY e, a),
        states AS (SELECT e, CAST(replace(replace(max(v) FILTER (a = 'encoding_at'), 'T', ' '), 'Z', '') AS TIMESTAMP) AS encoding_at,
        coalesce(CAST(max(v) FILTER (a = 'base_activation') AS DOUBLE), 0.0) AS base_activation, coalesce(CAST(max(v) FILTER (a = 'retrieval_count') AS BIGINT), 0) AS retrieval_count,
        CAST(replace(replace(max(v) FILTER (a = 'last_retrieved_at'), 'T', ' '), 'Z', '') AS TIMESTAMP) AS last_retrieved_at,
        coalesce(max(v) FILTER (a = 'evicted_at') > coalesce(max(v) FILTER (a = 'evicted_at_retracted'), ''), false) AS evicted FROM last_value_of GROUP BY e),
        aged AS (SELECT *, greatest(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(greatest(coalesce(encoding_at, last_retrieved_at), coalesce(last_retrieved_at, encoding_at))), 0) / 1e6 AS age FROM states),
        current_states AS (SELECT *, CASE WHEN evicted THEN 0.0 ELSE base_activation * pow(1 + coalesce(age, 0), -0.5) END AS activation FROM aged)""",
    "entries": """entries AS (SELECT 'entry:' || doc_id AS e, text AS body, source AS project, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS encoding_at,
        'trail:' || (doc_id % 20) AS trail, lpad(CAST(doc_id AS VARCHAR), 26, '0') AS tx, doc_id % 11 = 0 AS migrated, doc_id FROM documents)""",
    "mentions": """raw_tokens AS (SELECT e AS src, unnest(list_transform(regexp_split_to_array(body, '[^\\p{L}\\p{Nd}_]+'), lambda t: lower(regexp_replace(t, '^[-_]+|[-_]+$', '', 'g')))) AS token FROM entries),
        mentions AS (SELECT DISTINCT src, 'concept:' || token AS dst FROM raw_tokens WHERE octet_length(encode(token)) >= 3 AND NOT regexp_matches(token, '^[0-9]+$') AND token NOT IN ("""
    + ", ".join(f"'{w}'" for w in STOPWORDS)
    + "))",
    "parts": "parts AS (SELECT DISTINCT 'entry:' || l_orderkey AS src, 'concept:' || l_partkey AS dst FROM lineitem)",
    "vectors": "vectors AS (SELECT 'entry:' || vec_id AS id, embedding, label AS community, vec_id FROM embeddings)",
    "files": """files AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || (CASE page_id % 11 """
    + " ".join(f"WHEN {i} THEN '.{exts[0]}'" for i, (_, _, exts) in enumerate(LANGUAGES))
    + """ ELSE '.dat' END) AS path, octet_length(encode(html)) AS size, html AS content, md5(html) AS hash, page_id FROM pages)""",
    "facets": "facets AS (SELECT c_custkey AS pair, 'segment' AS k, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer)",
    "dialogue": """dialogue AS (SELECT 'trail:' || conv_id AS trail, 'entry:' || conv_id || '-' || turn AS e, lpad(CAST(conv_id AS VARCHAR), 16, '0') || lpad(CAST(turn AS VARCHAR), 10, '0') AS tx, role, text, conv_id, turn FROM conversations)""",
}
#: What a view needs before it.
NEEDS = {"activation_facts": ["facts"], "states": ["facts", "activation_facts"], "mentions": ["entries"]}


def sql(body: str, *views: str) -> str:
    """A query over views: the views and what they need, then the body (which may begin with more CTEs after a comma)."""
    names: list[str] = []
    for v in views:
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    body = body.strip()
    if body.startswith(","):
        return "WITH " + ", ".join(SQL[n] for n in names) + body
    return "WITH " + ", ".join(SQL[n] for n in names) + " " + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def facts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "events")).selectExpr(
        "lpad(cast(event_id as string), 26, '0') AS tx", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS ts", "concat('user:', user_id) AS actor",
        "CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'retract' ELSE 'add' END AS op", "concat('entry:', user_id) AS e", "event_type AS a",
        "cast(cast(round(value * 100) as bigint) as string) AS v", "'observe' AS src", "concat('run', event_id % 10) AS invocation_id", "concat('segment', event_id % 7) AS file",
    )


def activation_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).selectExpr(
        "tx", "e", "'add' AS op",
        "CASE a WHEN 'click' THEN 'retrieval_count' WHEN 'view' THEN 'last_retrieved_at' WHEN 'purchase' THEN 'base_activation' WHEN 'signup' THEN 'encoding_at' ELSE if(cast(tx as bigint) % 2 = 0, 'evicted_at', 'evicted_at_retracted') END AS a",
        "CASE WHEN a IN ('click', 'purchase') THEN v ELSE ts END AS v",
    )


def entries(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).selectExpr(
        "concat('entry:', doc_id) AS e", "text AS body", "source AS project", "timestamp_micros(unix_micros(timestamp '2024-01-01 00:00:00') + doc_id * 60000000) AS encoding_at",
        "concat('trail:', doc_id % 20) AS trail", "lpad(cast(doc_id as string), 26, '0') AS tx", "doc_id % 11 = 0 AS migrated", "doc_id",
    )


def mentions(spark: SparkSession, d: str) -> DataFrame:
    from factlog.operators.write import mentions as of

    return of(entries(spark, d))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entries and their parts as concepts."""
    return table(spark, d, "lineitem").selectExpr("concat('entry:', l_orderkey) AS src", "concat('concept:', l_partkey) AS dst").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("concat('entry:', vec_id) AS id", "embedding", "label AS community", "vec_id")


def files(spark: SparkSession, d: str) -> DataFrame:
    case = " ".join(f"WHEN {i} THEN '.{exts[0]}'" for i, (_, _, exts) in enumerate(LANGUAGES))
    return table(spark, d, "pages").selectExpr(
        f"concat(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), CASE page_id % 11 {case} ELSE '.dat' END) AS path",
        "cast(octet_length(html) as bigint) AS size", "html AS content", "md5(html) AS hash", "page_id",
    )


def facets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey AS pair", "stack(2, 'segment', c_mktsegment, 'nation', cast(c_nationkey as string)) AS (k, v)")


def dialogue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("concat('trail:', conv_id) AS trail", "concat('entry:', conv_id, '-', turn) AS e", "concat(lpad(cast(conv_id as string), 16, '0'), lpad(cast(turn as string), 10, '0')) AS tx", "role", "text", "conv_id", "turn")
