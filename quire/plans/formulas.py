"""Formulas made of parts, as two engines and a document's glyphs give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import formulas
from quire.sources.tables import table

from .book import query


def formula_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula for each part: v^{size} = \\frac{size}{v}. Engine a errs in one of five ways, engine b is silent for one part of seven."""
    key = F.col("p_partkey")
    way, size = key % 5, F.col("p_size").cast("string")
    letter, other = (F.chr((F.lit(97) + (key + k) % 26).cast("int")) for k in (0, 1))
    bold = F.when(way == 4, F.concat(F.lit("\\mathbf{"), letter, F.lit("}"))).otherwise(letter)

    def formula(v, w, script=lambda s: F.concat(F.lit("^{"), s, F.lit("}"))):
        return F.concat(v, script(size), F.lit("=\\frac{"), size, F.lit("}{"), w, F.lit("}"))

    a = F.when(way == 0, formula(other, letter)).when(way == 1, formula(letter, letter, lambda s: s)).when(way == 2, F.concat(F.lit("{"), formula(letter, letter))).otherwise(formula(letter, letter))

    def atoms(text, script=None, role=None, styled=False):
        styles = F.when(F.lit(styled) & (way == 4), F.array(F.lit("mathbf"))).otherwise(F.array().cast("array<string>"))
        each = F.filter(F.split(text, ""), lambda c: c != "")
        return F.transform(each, lambda c: F.struct(c.alias("text"), F.lit(script).cast("string").alias("script"), styles.alias("styles"), F.lit(role).cast("string").alias("role"), F.array().cast("array<string>").alias("accents"))).cast(formulas.ATOMS)

    glyphs = F.concat(atoms(letter, styled=True), atoms(size, "sup"), atoms(F.lit("=")), atoms(size, role="numerator"), atoms(letter, role="denominator", styled=True))
    return table(spark, sf_dir, "part").select("p_partkey", a.alias("a"), F.when(key % 7 != 0, formula(bold, bold)).alias("b"), glyphs.alias("glyphs"))


@query("""WITH f AS (SELECT p_partkey, p_partkey % 5 AS way, p_partkey % 7 <> 0 AS other, length(p_size::varchar) AS digits FROM part)
    SELECT p_partkey, CASE WHEN way = 3 THEN 'a' WHEN other THEN 'b' WHEN way = 2 THEN 'a' ELSE 'repair' END AS engine, CASE WHEN way = 2 AND NOT other THEN 'unresolved' ELSE 'confirmed' END AS status, CASE WHEN way = 2 AND NOT other THEN 3 ELSE 0 END AS score,
        CASE way WHEN 0 THEN 1 WHEN 1 THEN digits WHEN 4 THEN 2 ELSE 0 END::int AS changes FROM f""")
def formula_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-14, FUN-35: which of two engines' formulas the glyphs prove, or the repair of the first."""
    return formulas.assessed(formula_rows(spark, sf_dir), ["p_partkey"], ["a", "b"]).select("p_partkey", "engine", "status", "score", "changes")
