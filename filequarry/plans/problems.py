"""Queries of the general training-data operators: timestamps, drifting schemas, incremental runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filequarry.operators import drift, incremental, timestamps
from filequarry.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.same_instant_pairs(table(spark, folder, "crawl_records"), table(spark, folder, "pools"))


def p4_instants(spark: SparkSession, folder: str) -> DataFrame:
    rows = timestamps.normalise_fields(table(spark, folder, "crawl_records"), table(spark, folder, "pools"), ["rec_id"])
    return rows.select("rec_id", "field", F.timestamp_micros("instant_us").alias("instant"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "crawl_records"), table(spark, folder, "crawl_runs"))


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent_table(table(spark, folder, "crawl_records"), table(spark, folder, "crawl_runs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.next_batch(table(spark, folder, "crawl_records"), table(spark, folder, "crawl_runs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_instants, p5_found, p5_table, p6_found)}

SQL = {
    "p6_found": """
        WITH s AS (
            SELECT r.rec_id, r.device_id, r.path, r.sha256, u.run_no, u.status = 'ok' AND r.arrived_at <= u.cutoff_at AS processed
            FROM crawl_records r JOIN crawl_runs u USING (run_id)
        ), newest AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY device_id, path ORDER BY run_no DESC, rec_id DESC) = 1
        ), held AS (
            SELECT * FROM s WHERE processed QUALIFY row_number() OVER (PARTITION BY device_id, path ORDER BY run_no DESC, rec_id DESC) = 1
        )
        SELECT n.rec_id FROM newest n LEFT JOIN held h USING (device_id, path)
        WHERE NOT n.processed AND (h.rec_id IS NULL OR n.sha256 IS NULL OR h.sha256 IS NULL OR n.sha256 <> h.sha256)
    """,
    "p5_found": """
        WITH rec AS (
            SELECT u.device_id, u.run_no, r.path, r.meta_data FROM crawl_records r JOIN crawl_runs u USING (run_id) WHERE r.meta_data IS NOT NULL
        ), keyed AS (
            SELECT *, unnest(json_keys(meta_data)) AS k FROM rec
        ), cells AS (
            SELECT device_id, run_no, path, k, CAST(json_extract(meta_data, '$."' || k || '"') AS VARCHAR) AS v,
                CASE json_type(meta_data, '$."' || k || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer'
                    WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS t
            FROM keyed
        ), stats AS (
            SELECT device_id, run_no, k, list_sort(list_distinct(list(t))) AS types FROM cells GROUP BY ALL
        ), pairs AS (
            SELECT DISTINCT a.device_id, a.run_no FROM crawl_runs a JOIN crawl_runs b ON a.device_id = b.device_id AND b.run_no = a.run_no - 1
        ), compared AS (
            SELECT device_id, run_no, k, o.types AS ot, n.types AS nt
            FROM (SELECT device_id, run_no + 1 AS run_no, k, types FROM stats) o FULL JOIN stats n USING (device_id, run_no, k) JOIN pairs USING (device_id, run_no)
        ), common AS (
            SELECT DISTINCT a.device_id, a.run_no, a.path FROM rec a JOIN rec b ON a.device_id = b.device_id AND a.path = b.path AND b.run_no = a.run_no - 1
        ), old AS (
            SELECT DISTINCT device_id, run_no, path, k, v FROM (SELECT device_id, run_no + 1 AS run_no, path, k, v FROM cells WHERE t IS NOT NULL) c
            JOIN common USING (device_id, run_no, path) JOIN (SELECT device_id, run_no, k FROM compared WHERE nt IS NULL) USING (device_id, run_no, k)
        ), new AS (
            SELECT DISTINCT device_id, run_no, path, k, v FROM (SELECT device_id, run_no, path, k, v FROM cells WHERE t IS NOT NULL) c
            JOIN common USING (device_id, run_no, path) JOIN (SELECT device_id, run_no, k FROM compared WHERE ot IS NULL) USING (device_id, run_no, k)
        ), met AS (
            SELECT device_id, run_no, old.k AS o, new.k AS n, count(*) AS c FROM old JOIN new USING (device_id, run_no, path, v) GROUP BY ALL
        ), renamed AS (
            SELECT device_id, run_no, o, n FROM met
            JOIN (SELECT device_id, run_no, k AS o, count(*) AS co FROM old GROUP BY ALL) USING (device_id, run_no, o)
            JOIN (SELECT device_id, run_no, k AS n, count(*) AS cn FROM new GROUP BY ALL) USING (device_id, run_no, n) WHERE c = co AND c = cn
        )
        SELECT device_id, run_no, 'renamed' AS change, o AS old_key, n AS new_key FROM renamed
        UNION ALL SELECT device_id, run_no, 'retyped', k, k FROM compared WHERE len(ot) > 0 AND len(nt) > 0 AND ot <> nt
        UNION ALL SELECT device_id, run_no, 'removed', k, '' FROM compared c WHERE nt IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.device_id = c.device_id AND r.run_no = c.run_no AND r.o = c.k)
        UNION ALL SELECT device_id, run_no, 'added', '', k FROM compared c WHERE ot IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.device_id = c.device_id AND r.run_no = c.run_no AND r.n = c.k)
    """,
}
