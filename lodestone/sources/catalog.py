"""The shop catalogue read from Parquet, and its stand-in over the benchmark tables.

The stand-in is plain SQL in a dialect that other engines read too; ``{name}`` marks an input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

INPUTS = ("region", "nation", "supplier", "part", "lineitem", "events", "documents", "pages", "customer", "orders")

STAND_IN = {
    "articles": """
        SELECT 'v' || CAST(p_partkey AS STRING) AS id,
               CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 'g' || md5(p_name) END AS parent_id,
               CASE WHEN p_partkey % 3 = 0 AND p_partkey % 97 <> 0 THEN '' ELSE p_name END AS title,
               'Größe ' || CAST(p_size AS STRING) AS var_select,
               CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'ART-' || CAST(p_partkey AS STRING) END AS artnum,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(4000000000000 + p_partkey AS STRING) END AS ean,
               CAST('' AS STRING) AS mpn,
               CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Short ' || p_type END AS short_desc,
               CASE WHEN p_partkey % 3 = 1 THEN '' ELSE p_brand END AS manufacturer_id,
               CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 1 END AS active,
               0 AS var_count,
               COALESCE(sold, 0) AS sold,
               CASE WHEN p_partkey % 11 = 0 THEN '0000-00-00 00:00:00' ELSE COALESCE(first_ship, '') END AS inserted,
               p_retailprice AS price,
               CAST(p_partkey % 7 AS DOUBLE) AS stock,
               CAST(1 + p_partkey % 4 AS INT) AS stock_flag
        FROM {part} LEFT JOIN (
          SELECT l_partkey, CAST(sum(l_quantity) AS INT) AS sold, CAST(CAST(min(l_shipdate) AS DATE) AS STRING) AS first_ship FROM {lineitem} GROUP BY l_partkey) s
          ON p_partkey = l_partkey
        UNION ALL
        SELECT 'g' || md5(p_name), '', p_name, '', 'PAR-' || CAST(min(p_partkey) AS STRING), '', 'MPN ' || CAST(count(*) AS STRING), 'Parent of ' || p_name,
               min(p_brand), 1, CAST(count(*) AS INT), 0, '', min(p_retailprice), 0.0, 1
        FROM {part} GROUP BY p_name""",
    "long_desc": """
        SELECT 'g' || md5(p_name) AS article_id, '<p>Fine <b>' || p_name || '</b>ware &amp; more</p>' AS long_desc FROM {part} GROUP BY p_name""",
    "manufacturers": "SELECT DISTINCT p_brand AS id, p_brand AS title FROM {part}",
    "attributes": """
        SELECT 'type' AS id, 'Typ' AS title UNION ALL SELECT 'size', 'Größe' UNION ALL SELECT 'colour', 'Farbe' UNION ALL SELECT 'material', ''""",
    "object2attribute": """
        SELECT 'v' || CAST(p_partkey AS STRING) AS object_id, 'type' AS attr_id, CASE WHEN p_partkey % 10 = 0 THEN lower(p_type) ELSE p_type END AS value, 1 AS pos FROM {part}
        UNION ALL SELECT 'v' || CAST(p_partkey AS STRING), 'size', CAST(p_size AS STRING), 2 FROM {part}
        UNION ALL SELECT 'v' || CAST(p_partkey AS STRING), 'colour', split_part(p_name, ' ', 1) || '_#' || substr(md5(split_part(p_name, ' ', 1)), 1, 6), 3 FROM {part}
        UNION ALL SELECT 'g' || md5(p_name), 'material', ' ' || split_part(p_name, ' ', 2) || ' ', 0 FROM {part} GROUP BY p_name""",
    "categories": """
        SELECT 'r' || CAST(r_regionkey AS STRING) AS id, 'root' AS parent_id, r_name AS title, true AS active, false AS hidden FROM {region}
        UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), n_name, n_nationkey <> 7, n_nationkey % 5 = 0 FROM {nation}""",
    "object2category": """
        SELECT 'g' || md5(p_name) AS object_id, 'n' || CAST(min(p_partkey) % 25 AS STRING) AS cat_id FROM {part} GROUP BY p_name
        UNION SELECT 'g' || md5(p_name), 'n' || CAST(max(p_partkey) % 25 AS STRING) FROM {part} GROUP BY p_name""",
    "discounts": """
        SELECT 'd1' AS id, CAST(10 AS DOUBLE) AS amount, '%' AS kind, 1 AS active, CAST(NULL AS TIMESTAMP) AS active_from, CAST(NULL AS TIMESTAMP) AS active_to, 1 AS sort
        UNION ALL SELECT 'd2', CAST(5 AS DOUBLE), 'abs', 0, CAST('2020-01-01 00:00:00' AS TIMESTAMP), CAST('2099-01-01 00:00:00' AS TIMESTAMP), 2
        UNION ALL SELECT 'd3', CAST(50 AS DOUBLE), '%', 0, CAST('2020-01-01 00:00:00' AS TIMESTAMP), CAST('2021-01-01 00:00:00' AS TIMESTAMP), 3
        UNION ALL SELECT 'd4', CAST(7 AS DOUBLE), 'itm', 1, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), 4""",
    "object2discount": """
        SELECT 'd1' AS discount_id, 'n' || CAST(n_nationkey AS STRING) AS object_id, 'category' AS kind FROM {nation} WHERE n_nationkey IN (3, 7, 11)
        UNION ALL SELECT 'd2', 'v' || CAST(p_partkey AS STRING), 'article' FROM {part} WHERE p_size <= 5
        UNION ALL SELECT 'd2', 'g' || md5(p_name), 'article' FROM {part} GROUP BY p_name HAVING min(p_size) < 2
        UNION ALL SELECT 'd3', 'v' || CAST(p_partkey AS STRING), 'article' FROM {part}
        UNION ALL SELECT 'd4', 'v' || CAST(p_partkey AS STRING), 'article' FROM {part}""",
    "shop_prices": """
        SELECT 'v' || CAST(p_partkey AS STRING) AS article_id, 1 AS shop_id, CASE WHEN p_size % 2 = 0 THEN p_retailprice - 1 ELSE 0.0 END AS price FROM {part} WHERE p_size > 40""",
    "search_events": """
        SELECT CAST(user_id % 2 AS INT) AS shop_id, 0 AS lang_id, ts, CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS request_id,
               event_type || ' ' || regexp_extract(props, '([0-9]+)', 1) AS term_raw, CAST(floor(value) AS INT) % 5 AS hits, '' AS corrected,
               event_type <> 'refund' AS first_look
        FROM {events}""",
}


def inputs(spark: SparkSession, folder: str, names: tuple[str, ...] = INPUTS) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


class StandIn(dict):
    """Shop tables over the benchmark tables, made when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        used = tuple(n for n in INPUTS if f"{{{n}}}" in STAND_IN[name])
        self[name] = self.spark.sql(STAND_IN[name], **inputs(self.spark, self.folder, used))
        return self[name]

    def __contains__(self, name: object) -> bool:
        return name in STAND_IN

    def get(self, name: str, default=None):
        return self[name] if name in STAND_IN else default


def shop(spark: SparkSession, folder: str, shop_id: int, lang_id: int) -> dict[str, DataFrame]:
    """A catalogue kept as Parquet: a folder for each scope, one dataset for each table that is there."""
    base = f"{folder}/shop_id={shop_id}/lang_id={lang_id}"
    jvm = spark.sparkContext._jvm
    out = {}
    for name in STAND_IN:
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out[name] = spark.read.parquet(f"{base}/{name}")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
