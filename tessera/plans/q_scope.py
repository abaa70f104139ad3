"""Scope algebra over documents and over questions that name products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scope as S
from tessera.plans.base import Plans
from tessera.sources import views as V

PLANS = Plans()
queries, oracle_sql, add = PLANS.queries, PLANS.oracle_sql, PLANS.add

CATALOG = """catalog AS (SELECT project AS product, list_sort(list(DISTINCT build)) AS revisions FROM kb_docs
  WHERE project <> '' AND build <> '' AND project <> 'global' AND build <> 'common' GROUP BY 1)"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(qid, query): questions whose scope words vary with their number."""
    i = F.col("o_orderkey")
    k = i % 8
    p = F.concat(F.lit("prj"), (i % 3).cast("string"))
    b = F.concat(F.lit("b"), (i % 5).cast("string"))
    q = (F.when(k == 0, F.concat(F.lit("what is the GLOBAL rule for "), p)).when(k == 1, F.concat(F.lit("show "), p, F.lit(" common guide")))
         .when(k == 2, F.concat(p, F.lit(" / "), b, F.lit(" rail voltage"))).when(k == 3, F.concat(F.lit("rail of "), F.upper(p), F.lit(" "), b, F.lit(" board")))
         .when(k == 4, F.concat(F.lit("which parts use "), p)).when(k == 5, F.concat(b, F.lit(" only"))).when(k == 6, p).otherwise("plain words"))
    return V.table(spark, d, "orders").select(i.alias("qid"), q.alias("query"))


ASKED = """asked AS (SELECT o_orderkey AS qid, 'prj' || (o_orderkey % 3) AS p, 'b' || (o_orderkey % 5) AS b, o_orderkey % 8 AS k FROM orders)"""


def products(spark: SparkSession, d: str) -> DataFrame:
    return S.catalog(V.kb_docs(spark, d))


def scoped(spark: SparkSession, d: str) -> DataFrame:
    """(qid, project, build): where orders' questions aim."""
    o = F.col("o_orderkey")
    project = F.when(o % 7 == 0, "global").otherwise(F.concat(F.lit("prj"), (o % 3).cast("string")))
    build = F.when(o % 7 == 0, "x").when(o % 5 == 0, "common").otherwise(F.concat(F.lit("b"), (o % 4).cast("string")))
    return V.table(spark, d, "orders").select(o.alias("qid"), project.alias("project"), build.alias("build"))


SCOPED = """scoped AS (SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 7 = 0 THEN 'global' ELSE 'prj' || (o_orderkey % 3) END AS project,
  CASE WHEN o_orderkey % 7 = 0 THEN 'x' WHEN o_orderkey % 5 = 0 THEN 'common' ELSE 'b' || (o_orderkey % 4) END AS build FROM orders)"""
RANKS = """ranks AS (SELECT qid, project, build, scope_rank FROM (
  SELECT qid, 'global' AS project, 'global' AS build, 0 AS scope_rank FROM scoped WHERE project = 'global'
  UNION ALL SELECT qid, project, build, 0 FROM scoped WHERE project <> 'global'
  UNION ALL SELECT qid, project, 'common', 1 FROM scoped WHERE project <> 'global' AND build <> 'common'
  UNION ALL SELECT qid, 'global', 'global', CASE WHEN build = 'common' THEN 1 ELSE 2 END FROM scoped WHERE project <> 'global'))"""


@add("X05_catalog", f"WITH {V.KB_DOCS}, {CATALOG} SELECT product, array_to_string(revisions, ',') AS revisions FROM catalog")
def x05(spark, d):
    return products(spark, d).select("product", F.array_join("revisions", ",").alias("revisions"))


@add("X06_known_products", f"WITH {V.KB_DOCS}, {CATALOG} SELECT coalesce(string_agg('- ' || product || ': ' || array_to_string(revisions, ', '), chr(10) ORDER BY product), '(none)') AS listing FROM catalog")
def x06(spark, d):
    return S.known_products(products(spark, d))


@add("X07_known_scope", f"""
WITH {V.KB_DOCS}, {CATALOG}, {SCOPED} SELECT qid, product IS NOT NULL AS known_product, coalesce(list_contains(revisions, build), FALSE) AS known_revision
FROM scoped LEFT JOIN catalog ON product = project
""")
def x07(spark, d):
    rows = scoped(spark, d).join(products(spark, d).withColumnRenamed("product", "project"), "project", "left")
    return rows.select("qid", F.col("revisions").isNotNull().alias("known_product"), F.coalesce(F.array_contains("revisions", F.col("build")), F.lit(False)).alias("known_revision"))


@add("F01_document_type", f"WITH {V.KB_DOCS} SELECT doc_id FROM kb_docs WHERE document_type = 'schematic'")
def f01(spark, d):
    return S.flat_pool(V.kb_docs(spark, d), None, "b1", document_type="schematic").select("doc_id")


@add("F02_flat_scope", f"WITH {V.KB_DOCS} SELECT doc_id FROM kb_docs WHERE (project, build) IN (('prj1', 'b2'), ('prj1', 'common'), ('global', 'global'))")
def f02(spark, d):
    return S.flat_pool(V.kb_docs(spark, d), "prj1", "b2").select("doc_id")


@add("F02_exact_scope", f"WITH {V.KB_DOCS} SELECT doc_id FROM kb_docs WHERE project = 'prj1' AND build = 'b2' AND document_type = 'note'")
def f02_exact(spark, d):
    return S.flat_pool(V.kb_docs(spark, d), "prj1", "b2", inherit=False, document_type="note").select("doc_id")


@add("F03_scope_expansion", f"WITH {SCOPED}, {RANKS} SELECT qid, project, build, scope_rank FROM ranks")
def f03(spark, d):
    return S.ranks(scoped(spark, d))


BUILDS, PRODUCTS = "aimed AS (SELECT * FROM scoped WHERE qid % 2 = 1)", "whole AS (SELECT * FROM scoped WHERE qid % 2 = 0)"


@add("F04_rank_resolution", f"""
WITH {V.KB_DOCS}, {CATALOG}, {SCOPED}, {BUILDS}, {PRODUCTS}, {RANKS.replace('FROM scoped', 'FROM aimed')} SELECT qid, project, build, scope_rank FROM ranks
UNION ALL SELECT qid, product, unnest(revisions), 0 FROM whole JOIN catalog ON product = project
UNION ALL SELECT qid, project, 'common', 1 FROM whole UNION ALL SELECT qid, 'global', 'global', 2 FROM whole
""")
def f04(spark, d):
    """Questions that name a build, and questions that name a product alone."""
    rows = scoped(spark, d)
    aimed, whole = rows.filter("qid % 2 = 1"), rows.filter("qid % 2 = 0").select("qid", F.col("project").alias("product"))
    return S.ranks(aimed).unionByName(S.inherit_ranks(whole, products(spark, d)))


@add("F05_inherit_ranks", f"""
WITH {V.KB_DOCS}, {CATALOG}, {SCOPED} SELECT qid, product AS project, unnest(revisions) AS build, 0 AS scope_rank FROM scoped JOIN catalog ON product = project
UNION ALL SELECT qid, project, 'common', 1 FROM scoped UNION ALL SELECT qid, 'global', 'global', 2 FROM scoped
""")
def f05(spark, d):
    return S.inherit_ranks(scoped(spark, d).select("qid", F.col("project").alias("product")), products(spark, d))


TIER = "CASE WHEN project = 'global' AND build = 'global' THEN 2 WHEN build = 'common' THEN 1 ELSE 0 END"


@add("F06_tier", f"WITH {V.KB_DOCS} SELECT doc_id, {TIER} AS tier FROM kb_docs")
def f06(spark, d):
    return V.kb_docs(spark, d).select("doc_id", S.tier(F.col("project"), F.col("build")).alias("tier"))


@add("T30_tier_label", f"WITH {V.KB_DOCS} SELECT doc_id, (['build','project_common','global'])[{TIER} + 1] AS label FROM kb_docs")
def t30(spark, d):
    return V.kb_docs(spark, d).select("doc_id", S.tier_label(F.col("project"), F.col("build")).alias("label"))


@add("F07_phases", f"WITH {SCOPED}, {RANKS} SELECT qid, {TIER} AS tier, string_agg(project || '/' || build, ' ' ORDER BY project || '/' || build) AS pairs FROM ranks GROUP BY 1, 2")
def f07(spark, d):
    return S.phases(S.ranks(scoped(spark, d))).select("qid", "tier", F.array_join("pairs", " ").alias("pairs"))


@add("F08_cascade_gate", "SELECT o_orderkey AS qid, o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0) AS cascade FROM orders")
def f08(spark, d):
    o = F.col("o_orderkey")
    gate = S.cascades(F.lit(True), o % 2 == 0, o % 3 == 0, F.when(o % 5 != 0, "prj1"))
    return V.table(spark, d, "orders").select(o.alias("qid"), gate.alias("cascade"))


@add("F09_scope_extraction", f"""
WITH {V.KB_DOCS}, {CATALOG}, {ASKED}, known AS (SELECT asked.*, product IS NOT NULL AS kp, coalesce(list_contains(revisions, b), FALSE) AS kr FROM asked LEFT JOIN catalog ON product = p)
SELECT qid, CASE WHEN kp AND k IN (1, 2, 3, 4, 6) THEN p END AS product, CASE WHEN k IN (2, 3) AND kp AND kr THEN b END AS revision,
  CASE WHEN k = 0 THEN 'enterprise' WHEN NOT kp THEN NULL WHEN k = 1 THEN 'project_common' WHEN k IN (2, 3) AND kr THEN 'build' WHEN k IN (2, 3, 4, 6) THEN 'inherit' END AS layer,
  CASE WHEN k = 0 THEN 'what is the rule for ' || p WHEN k = 1 THEN CASE WHEN kp THEN 'show guide' ELSE 'show ' || p || ' common guide' END
    WHEN k = 2 THEN CASE WHEN kp AND kr THEN 'rail voltage' WHEN kp THEN '/ ' || b || ' rail voltage' ELSE p || ' / ' || b || ' rail voltage' END
    WHEN k = 3 THEN CASE WHEN kp AND kr THEN 'rail of board' WHEN kp THEN 'rail of ' || b || ' board' ELSE 'rail of ' || upper(p) || ' ' || b || ' board' END
    WHEN k = 4 THEN CASE WHEN kp THEN 'which parts use' ELSE 'which parts use ' || p END WHEN k = 5 THEN b || ' only' WHEN k = 6 THEN p ELSE 'plain words' END AS stripped
FROM known
""")
def f09(spark, d):
    return S.extracted(asked(spark, d), products(spark, d))


@add("F10_layer_name", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'inherit' WHEN 1 THEN 'build' WHEN 2 THEN 'project_common' WHEN 3 THEN 'enterprise' END AS layer FROM part
""")
def f10(spark, d):
    raw = F.element_at(F.array(*map(F.lit, [" ALL", "Board", "project-common", "GLOBAL ", "other", ""])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", S.layer_name(raw).alias("layer"))


def proposed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    p = F.when(i % 11 == 0, "nope").when(i % 11 == 1, "Global").when(i % 11 != 2, F.concat(F.lit(" PRJ"), (i % 3).cast("string")))
    r = F.when(i % 4 == 0, "common").when(i % 4 == 1, F.concat(F.lit("B"), (i % 6).cast("string")))
    return V.table(spark, d, "orders").select(i.alias("qid"), p.alias("product"), r.alias("revision"), F.when(i % 13 == 0, "enterprise").when(i % 13 == 1, "project_common").alias("layer"))


VALID = f"""proposed AS (SELECT o_orderkey AS qid, o_orderkey % 11 AS m, CASE WHEN o_orderkey % 11 = 0 THEN 'nope' WHEN o_orderkey % 11 = 1 THEN 'global' WHEN o_orderkey % 11 <> 2 THEN 'prj' || (o_orderkey % 3) END AS p,
  CASE o_orderkey % 4 WHEN 0 THEN 'common' WHEN 1 THEN 'b' || (o_orderkey % 6) END AS r, CASE o_orderkey % 13 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'project_common' ELSE 'inherit' END AS l FROM orders),
valid AS (SELECT qid, p, r, CASE WHEN l = 'enterprise' OR p = 'global' THEN 'enterprise' WHEN r = 'common' THEN CASE WHEN product IS NOT NULL THEN 'project_common' END
  WHEN p IS NOT NULL AND product IS NULL THEN NULL WHEN r IS NOT NULL THEN CASE WHEN product IS NOT NULL AND list_contains(revisions, r) THEN 'build' END WHEN p IS NOT NULL THEN l END AS layer
  FROM proposed LEFT JOIN catalog ON product = p)"""


@add("F11_validated_scope", f"""
WITH {V.KB_DOCS}, {CATALOG}, {VALID} SELECT qid, CASE WHEN layer <> 'enterprise' THEN p END AS product, CASE WHEN layer = 'build' THEN r END AS revision, layer FROM valid
""")
def f11(spark, d):
    return S.validated(proposed(spark, d), products(spark, d))


@add("F12_merged_scope", f"""
WITH {V.KB_DOCS}, {CATALOG}, {VALID} SELECT qid, CASE WHEN layer IS NULL THEN 'prj2' WHEN layer <> 'enterprise' THEN p END AS product, CASE WHEN layer = 'build' THEN r END AS revision, coalesce(layer, 'inherit') AS layer FROM valid
""")
def f12(spark, d):
    given = proposed(spark, d)
    rules = given.select("qid", F.lit("prj2").alias("product"), F.lit(None).cast("string").alias("revision"), F.lit("inherit").alias("layer"))
    return S.merged(rules, S.validated(given, products(spark, d)))


@add("F13_targets", f"""
WITH {V.KB_DOCS}, {CATALOG}, {VALID}, top AS (SELECT qid, 'global' AS project, 'global' AS build, 0 AS scope_rank FROM valid WHERE layer = 'enterprise')
SELECT * FROM top
UNION ALL SELECT qid, p, 'common', 0 FROM valid WHERE layer = 'project_common' UNION ALL SELECT qid, 'global', 'global', 1 FROM valid WHERE layer = 'project_common'
UNION ALL SELECT qid, p, r, 0 FROM valid WHERE layer = 'build' UNION ALL SELECT qid, p, 'common', 1 FROM valid WHERE layer = 'build' UNION ALL SELECT qid, 'global', 'global', 2 FROM valid WHERE layer = 'build'
UNION ALL SELECT qid, p, unnest(revisions), 0 FROM valid JOIN catalog ON product = p WHERE layer = 'inherit' UNION ALL SELECT qid, p, 'common', 1 FROM valid WHERE layer = 'inherit' UNION ALL SELECT qid, 'global', 'global', 2 FROM valid WHERE layer = 'inherit'
""")
def f13(spark, d):
    known = products(spark, d)
    return S.targets(S.validated(proposed(spark, d), known), known)


@add("F15_build_schematic", f"""
WITH {V.KB_DOCS} SELECT doc_id FROM kb_docs WHERE document_type = 'schematic' AND project <> 'global' AND build <> 'common' AND project = 'prj' || (doc_id % 3) AND (doc_id % 2 = 0 OR build = 'b1')
""")
def f15(spark, d):
    i = F.col("doc_id")
    own = S.is_build_schematic(F.col("document_type"), F.col("project"), F.col("build"), F.concat(F.lit("prj"), (i % 3).cast("string")), F.when(i % 2 != 0, "b1"))
    return V.kb_docs(spark, d).filter(own).select("doc_id")


@add("F16_minimum_gate", """
SELECT qid, pos FROM (SELECT l_orderkey AS qid, l_linenumber AS pos, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE top >= 50000
""")
def f16(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("score"))
    return S.gated(rows, 50000.0).select("qid", "pos")


@add("F17_tier_pool", f"WITH {V.KB_DOCS} SELECT doc_id FROM kb_docs WHERE build = 'common' AND project IN ('prj0', 'prj2') AND document_type IN ('sop')")
def f17(spark, d):
    pairs = V.kb_docs(spark, d).filter("build = 'common' and project in ('prj0', 'prj2')").select("project", "build").distinct()
    return S.in_scope(V.kb_docs(spark, d), pairs, "sop").select("doc_id")
