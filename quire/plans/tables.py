"""Tables of orders as two engines read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import tables
from quire.sources.tables import table

from .book import query


def engines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """For each order a table of its items under a head of two rows. Engine a leaves the head's corner empty and takes a group's name for a row of three cells; engine b has both whole, but for one order in three, whose head reads otherwise."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("n")).agg(F.max(F.col("l_quantity").cast("bigint")).alias("q"), F.max("l_partkey").alias("p"))

    def cell(row, idx, text, down=1, across=1):
        return F.struct(F.lit(row).cast("int").alias("row") if isinstance(row, int) else row.cast("int").alias("row"), F.lit(idx).alias("idx"), (F.lit(text) if isinstance(text, str) else text.cast("string")).alias("text"), F.lit(down).alias("down"), F.lit(across).alias("across"))

    body = F.array(cell(F.col("n") + 2, 0, F.concat(F.lit("item "), "n")), cell(F.col("n") + 2, 1, F.col("q")), cell(F.col("n") + 2, 2, F.col("p")))
    orders = items.select("table").distinct()
    odd = F.col("table") % 3 == 0
    one = F.array(cell(0, 0, ""), cell(0, 1, "Quantity"), cell(0, 2, "Part"), cell(1, 0, ""), cell(1, 1, "pieces"), cell(1, 2, "number"), cell(2, 0, "Order"), cell(2, 1, ""), cell(2, 2, ""))
    other = F.array(cell(0, 0, "Item", 2), cell(0, 1, F.when(odd, "Weight").otherwise("Quantity")), cell(0, 2, F.when(odd, "Colour").otherwise("Part")), cell(1, 0, F.when(odd, "kg").otherwise("pieces")), cell(1, 1, "number"), cell(2, 0, "Order", 1, 3))

    def of(head):
        return orders.select("table", F.inline(head)).union(items.select("table", F.inline(body)))

    return of(one), of(other)


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS t, l_linenumber AS n FROM lineitem), b AS (SELECT l_orderkey AS t, l_linenumber AS n, max(l_quantity::bigint) AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL), o AS (SELECT DISTINCT t FROM i)
    SELECT t AS "table", 0 AS row, 0 AS idx, CASE WHEN t % 3 = 0 THEN '' ELSE 'Item' END AS text, CASE WHEN t % 3 = 0 THEN 1 ELSE 2 END AS down, 1 AS across FROM o UNION ALL SELECT t, 0, k, ['Quantity', 'Part'][k], 1, 1 FROM o, range(1, 3) r(k) UNION ALL SELECT t, 1, k, ['pieces', 'number'][k], 1, 1 FROM o, range(1, 3) r(k)
    UNION ALL SELECT t, 1, 0, '', 1, 1 FROM o WHERE t % 3 = 0 UNION ALL SELECT t, 2, 0, 'Order', 1, 3 FROM o UNION ALL SELECT t, n + 2, k, CASE k WHEN 0 THEN 'item ' || n WHEN 1 THEN q::varchar ELSE p::varchar END, 1, 1 FROM b, range(3) r(k)""")
def header_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-10: heads and group rows that the other engine has whole."""
    return tables.with_heads(*engines(spark, sf_dir))[0]
