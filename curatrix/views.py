"""How the shared tables stand in for a file catalogue: each view in Spark SQL and in the oracle's SQL.

Where one text serves both, SPARK has it alone and SQL repeats it with the functions that differ replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EXT5 = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'MP4' WHEN 3 THEN 'tar.gz' ELSE 'part' END"

SPARK = {
    "catalog": ("documents", "SELECT doc_id, '/lib/' || source || '/' || lang || '/doc-' || doc_id || '.txt' AS path, text, CAST(octet_length(text) AS BIGINT) AS size, sha2(text, 256) AS digest, lang, source FROM documents"),
    "inbox": ("orders", f"SELECT o_orderkey AS id, '/inbox/order-' || o_orderkey || '.' || {EXT5} AS path, CAST(o_orderdate AS DATE) AS modified, date_sub(CAST(o_orderdate AS DATE), CAST(o_custkey % 400 AS INT)) AS created, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS accessed, CAST(round(o_totalprice * 100) AS BIGINT) AS size, sha2(CAST(o_orderkey % 900 AS STRING), 256) AS digest FROM orders"),
    "observations": ("events", "SELECT '/u/' || user_id || CASE WHEN user_id % 10 = 0 THEN '.part' ELSE '.bin' END AS path, CAST(ts AS TIMESTAMP) AS observed_at, CAST(1 AS BIGINT) AS size, CAST(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS modified_at, event_type = 'error' AS locked, true AS present FROM events"),
    "media": ("embeddings", "SELECT vec_id AS id, '/m/' || label || '/' || vec_id || '.jpg' AS path, vec_id || '.jpg' AS name, embedding, label, sha2(CAST(vec_id % 400 AS STRING), 256) AS digest, vec_id % 9 = 0 AS protected, vec_id % 4 = 0 AS uncertain, 'c' || label AS category, CASE WHEN vec_id % 11 = 0 THEN 'error' ELSE 'ready' END AS status FROM embeddings"),
    "journal": ("lineitem", "SELECT l_orderkey AS operation_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS sequence, '/src/' || l_partkey || '.bin' AS source, '/dst/' || l_partkey || '-' || l_linenumber || '.bin' AS destination, CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'completed' WHEN 'NF' THEN 'planned' WHEN 'RF' THEN 'undone' WHEN 'RO' THEN 'failed' WHEN 'AF' THEN 'skipped' ELSE 'completed' END AS status, CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'copy' WHEN 3 THEN 'skip' ELSE 'move' END AS kind, CASE WHEN l_linenumber = 7 THEN 'folder' ELSE 'file' END AS entry_kind, CASE WHEN l_suppkey % 97 = 0 THEN 'INVALID_DATE' END AS error, CAST(round(l_quantity * 1000) AS BIGINT) AS bytes, sha2(CAST(l_partkey AS STRING), 256) AS digest FROM lineitem"),
    "operations": ("orders", "SELECT o_orderkey AS operation_id, o_orderdate AS created_at FROM orders"),
    "tree": ("region nation customer", "SELECT '/' || r_name || '/' || n_name || '/' || c_name || '.dat' AS path, c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
}


def _other(text: str) -> str:
    for a, b in (("sha2(CAST(o_orderkey % 900 AS STRING), 256)", "sha256(CAST(o_orderkey % 900 AS VARCHAR))"), ("sha2(CAST(vec_id % 400 AS STRING), 256)", "sha256(CAST(vec_id % 400 AS VARCHAR))"), ("sha2(CAST(l_partkey AS STRING), 256)", "sha256(CAST(l_partkey AS VARCHAR))"), ("sha2(text, 256)", "sha256(text)"), ("octet_length(text)", "strlen(text)"), ("date_sub(CAST(o_orderdate AS DATE), CAST(o_custkey % 400 AS INT))", "CAST(CAST(o_orderdate AS DATE) - CAST(o_custkey % 400 AS INT) AS DATE)")):
        text = text.replace(a, b)
    return text


SQL = {k: _other(v[1]) for k, v in SPARK.items()}


def _numbered_first(text: str) -> str:
    """The journal's text with its numbers in an inner query: what follows from a row (names, its digest) is made after the shuffle, not carried through it."""
    head, tail = text.index("CAST(row_number()"), " AS sequence"
    number = text[head : text.index(tail)]
    return text.replace(number, "_sequence").replace("FROM lineitem", f"FROM (SELECT *, {number} AS _sequence FROM lineitem )")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = SPARK[name]
    text = _numbered_first(text) if name == "journal" else text
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}
    for t in frames:
        text = text.replace(f" {t}", f" {{{t}}}") if f" {t} " in f"{text} " else text
    return spark.sql(text, **frames)


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
