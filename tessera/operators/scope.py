"""Scope algebra: which projects and builds a question may draw on, and in what order.

Scopes are rows (project, build, scope_rank) or columns derived from them; membership is a semi
join.  The catalog of products and revisions is a table too; it is collected only up to a checked size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schema import LAYOUT, Layout

BUILD, SHARED, GLOBAL = 0, 1, 2
ENTERPRISE_WORDS = r"(?i)\bglobal\b|全局|企业通用"


def tier(project: Column, build: Column, layout: Layout = LAYOUT) -> Column:
    return F.when((project == layout.enterprise) & (build == layout.enterprise), GLOBAL).when(build == layout.shared_build, SHARED).otherwise(BUILD)


def tier_label(project: Column, build: Column, layout: Layout = LAYOUT) -> Column:
    return F.element_at(F.array(F.lit("build"), F.lit("project_common"), F.lit("global")), tier(project, build, layout) + 1)


def expanded(project: Column, build: Column, layout: Layout = LAYOUT) -> Column:
    """Array of (project, build): the build, its project's shared build, the enterprise; each once."""
    pair = lambda p, b: F.struct(p.alias("project"), b.alias("build"))
    top, shared = F.lit(layout.enterprise), F.lit(layout.shared_build)
    whole = F.array_distinct(F.array(pair(project, build), pair(project, shared), pair(top, top)))
    return F.when(project == layout.enterprise, F.array(pair(top, top))).otherwise(whole)


def ranks(targets: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """``targets`` (qid, project, build) to (qid, project, build, scope_rank)."""
    return targets.select("qid", F.posexplode(expanded(F.col("project"), F.col("build"), layout)).alias("scope_rank", "pair")).select("qid", "pair.project", "pair.build", "scope_rank")


def catalog(pairs: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(product, revisions): distinct builds of each project; reserved names and blanks do not count."""
    real = (F.col("project") != "") & (F.col("build") != "") & (F.col("project") != layout.enterprise) & (F.col("build") != layout.shared_build)
    return pairs.filter(real).groupBy(F.col("project").alias("product")).agg(F.array_sort(F.collect_set("build")).alias("revisions"))


def known_products(products: DataFrame) -> DataFrame:
    """One row, ``listing``: the catalog as lines for a prompt."""
    line = F.concat(F.lit("- "), "product", F.lit(": "), F.array_join("revisions", ", "))
    lines = products.agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lines.select(F.when(F.size("lines") == 0, "(none)").otherwise(F.array_join("lines", "\n")).alias("listing"))


def inherit_ranks(asked: DataFrame, products: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """``asked`` (qid, product) to ranks: every revision 0, the shared build 1, the enterprise 2."""
    revisions = asked.join(products, "product").select("qid", F.col("product").alias("project"), F.explode("revisions").alias("build"), F.lit(0).alias("scope_rank"))
    shared = asked.select("qid", F.col("product").alias("project"), F.lit(layout.shared_build).alias("build"), F.lit(1).alias("scope_rank"))
    top = asked.select("qid", F.lit(layout.enterprise).alias("project"), F.lit(layout.enterprise).alias("build"), F.lit(2).alias("scope_rank"))
    return revisions.unionByName(shared).unionByName(top)


def in_scope(chunks: DataFrame, scopes: DataFrame, document_type: str | None = None) -> DataFrame:
    """Rows of ``chunks`` whose (project, build) is in ``scopes``; a type filter reaches the scan."""
    kept = chunks if document_type is None else chunks.filter(F.col("document_type") == document_type)
    return kept.join(scopes.select("project", "build").distinct(), ["project", "build"], "left_semi")


def flat_pool(chunks: DataFrame, project: str | None, build: str | None, *, inherit: bool = True, document_type: str | None = None, scopes: DataFrame | None = None, layout: Layout = LAYOUT) -> DataFrame:
    """The pool of a flat search.  A build without a project is ignored."""
    if scopes is not None:
        return in_scope(chunks, scopes, document_type)
    kept = chunks if document_type is None else chunks.filter(F.col("document_type") == document_type)
    if not project:
        return kept
    if inherit and build:
        pairs = expanded(F.lit(project), F.lit(build), layout)
        return kept.filter(F.exists(pairs, lambda p: (p["project"] == F.col("project")) & (p["build"] == F.col("build"))))
    return kept.filter((F.col("project") == project) & (F.lit(True) if build is None else F.col("build") == build))


def cascades(inherit: Column, cascade: Column, has_ranks: Column, project: Column) -> Column:
    return inherit & cascade & (has_ranks | project.isNotNull())


def layer_name(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return (F.when(word.isin("none", "inherit", "all"), "inherit").when(word.isin("build", "revision", "board"), "build")
            .when(word.isin("project_common", "common", "project-common"), "project_common").when(word.isin("enterprise", "global"), "enterprise"))


#: Products and revisions up to which a catalog goes to every task as an automaton.
SMALL_CATALOG = 200_000
WORD = re.compile(r"\w")


class Names:
    """All product names of a catalog in one automaton, and the revisions of each by name and length."""

    def __init__(self, rows: list[tuple[str, list[str]]], layout: Layout):
        self.automaton, self.layout = ahocorasick.Automaton(), layout
        self.products: dict[str, list[str]] = {}
        self.revisions: dict[str, dict[str, list[str]]] = {}
        for product, revisions in rows:
            self.products.setdefault(product.lower(), []).append(product)
            own = self.revisions.setdefault(product, {})
            for revision in revisions or []:
                own.setdefault(revision.lower(), []).append(revision)
        for name in filter(None, self.products):
            self.automaton.add_word(name, name)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.lengths = {product: sorted({len(r) for r in own}, reverse=True) for product, own in self.revisions.items()}

    def named(self, query: str) -> list[tuple[str, list[int]]]:
        """The products that stand in a query as words, in order, and where each ends."""
        low = query.lower()
        if len(low) != len(query):  # some letters grow; places must agree
            low = "".join(x if len(x := c.lower()) == 1 else c for c in query)
        ends: dict[str, list[int]] = {}
        for last, name in self.automaton.iter(low) if len(self.automaton) else ():
            if bounded(low, last - len(name) + 1) and bounded(low, last + 1):
                for product in self.products[name]:
                    ends.setdefault(product, []).append(last + 1)
        return sorted(ends.items())

    def rule(self, query: str) -> tuple[str | None, str | None, str | None, str | None]:
        """(product, revision, layer, separator) by the first rule that holds."""
        if ENTERPRISE.search(query):
            return None, None, "enterprise", None
        found = self.named(query)
        shared = re.compile(rf"\s+{re.escape(self.layout.shared_build)}\b", re.IGNORECASE)
        for product, ends in found:
            if any(shared.match(query, end) for end in ends):
                return product, None, "project_common", None
        for product, ends in found:
            best = None
            for end in ends:
                for separator, pattern in ((0, SLASH), (1, BLANK)):
                    if not (gap := pattern.match(query, end)):
                        continue
                    rest = query[gap.end() :].lower()
                    for length in self.lengths[product]:
                        for revision in self.revisions[product].get(rest[:length], ()) if length <= len(rest) and bounded(query, gap.end() + length) else ():
                            best = min(best or (1, 0, ""), (-2 * length + separator, separator, revision), key=lambda x: (x[0], x[2]))
            if best and best[2]:
                return product, best[2], "build", "/" if best[1] == 0 else " "
        if found:
            return min(found, key=lambda x: (-len(x[0]), x[0]))[0], None, "inherit", None
        return None, None, None, None


SLASH, BLANK = re.compile(r"\s*/\s*"), re.compile(r"\s+")
ENTERPRISE = re.compile(ENTERPRISE_WORDS)


def bounded(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    before, after = at > 0 and WORD.match(text[at - 1]), at < len(text) and WORD.match(text[at])
    return bool(before) != bool(after)


def extracted(queries: DataFrame, products: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """``queries`` (qid, query) with (product, revision, layer, stripped): the scope that rules find.

    Precedence: an enterprise word; a product with the shared build; a product with a revision,
    products in order, longer revisions first, a slash before a blank; a product alone, longer names
    first.  Null layer: nothing matched.  One automaton finds all products of a query in a pass over its
    text, whatever the size of the catalog; catalogs that are too large to send to every task are joined
    with the words of the queries instead (``joined_rules``), with the same rows."""
    size = products.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("revisions")), F.lit(0)).alias("r")).first()
    if size["n"] + size["r"] > SMALL_CATALOG:
        return joined_rules(queries, products, layout)
    told = [(r["product"], r["revisions"]) for r in products.select("product", "revisions").collect() if r["product"] is not None]
    catalog = queries.sparkSession.sparkContext.broadcast(told)
    asked = queries.select("qid", F.trim("query").alias("query"))
    schema = T.StructType([*asked.schema, *(T.StructField(c, T.StringType()) for c in ("product", "revision", "layer", "separator"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(catalog.value, layout)
        for batch in batches:
            found = [names.rule(q) if q else (None,) * 4 for q in batch.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    out = asked.mapInArrow(run, schema)
    # What goes from the query is decided by one pattern, of the rule that holds.
    quoted = lambda c: F.concat(F.lit("\\Q"), F.col(c), F.lit("\\E"))
    name = F.concat(F.lit(r"(?iU)\b"), quoted("product"))
    pattern = F.when(F.col("layer") == "enterprise", ENTERPRISE_WORDS.replace("(?i)", "(?iU)")).when(F.col("layer") == "project_common", F.concat(name, F.lit(rf"\s+{layout.shared_build}\b")))
    pattern = pattern.when(F.col("layer") == "build", F.concat(name, F.when(F.col("separator") == "/", r"\s*/\s*").otherwise(r"\s+"), quoted("revision"), F.lit(r"\b"))).when(F.col("layer") == "inherit", F.concat(name, F.lit(r"\b")))
    clean = F.trim(F.regexp_replace(F.regexp_replace("query", F.coalesce(pattern, F.lit("$^")), F.lit(" ")), r"\s+", " "))
    return out.select("qid", "product", "revision", "layer", F.when(F.col("layer").isNull() | (clean == ""), F.col("query")).otherwise(clean).alias("stripped"))


def joined_rules(queries: DataFrame, products: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """The same as ``extracted``, for catalogs of any size: products and queries meet on a word they share,
    and a pattern decides for each pair."""
    escape = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    asked = queries.select("qid", F.trim("query").alias("query"))
    first_word = lambda c: F.lower(F.regexp_extract(c, r"(?U)[\w]+", 0))
    words = asked.select("qid", "query", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit(r"(?U)\w+"), F.lit(0)), F.lower))).alias("word"))
    near = words.join(products.select("product", "revisions", first_word(F.col("product")).alias("word")), "word").select("qid", "query", "product", "revisions")
    name = escape(F.col("product"))
    end = r"\b"
    shared = F.concat(F.lit(r"(?iU)\b"), name, F.lit(rf"\s+{layout.shared_build}{end}"))
    alone = F.concat(F.lit(r"(?iU)\b"), name, F.lit(end))
    revision = near.withColumn("revision", F.explode("revisions"))
    slash = F.concat(F.lit(r"(?iU)\b"), name, F.lit(r"\s*/\s*"), escape(F.col("revision")), F.lit(end))
    blank = F.concat(F.lit(r"(?iU)\b"), name, F.lit(r"\s+"), escape(F.col("revision")), F.lit(end))
    none = F.lit(None).cast("string")

    def rule(rows: DataFrame, pattern: Column, step: int, product: Column, rev: Column, layer: str, order: Column, second: Column) -> DataFrame:
        hit = rows.filter(F.regexp_like("query", pattern))
        return hit.select("qid", F.struct(F.lit(step).alias("step"), order.alias("o1"), second.alias("o2"), product.alias("product"), rev.alias("revision"), F.lit(layer).alias("layer"), pattern.alias("pattern")).alias("rule"))

    fixed = F.lit(0).cast("int")
    text = F.lit("")
    found = rule(asked, F.lit(ENTERPRISE_WORDS.replace("(?i)", "(?iU)")), 1, none, none, "enterprise", text, fixed)
    found = found.unionAll(rule(near, shared, 2, F.col("product"), none, "project_common", F.col("product"), fixed))
    found = found.unionAll(rule(revision, slash, 3, F.col("product"), F.col("revision"), "build", F.col("product"), -F.length("revision") * 2))
    found = found.unionAll(rule(revision, blank, 3, F.col("product"), F.col("revision"), "build", F.col("product"), -F.length("revision") * 2 + 1))
    found = found.unionAll(rule(near, alone, 4, F.col("product"), none, "inherit", text, -F.length("product")))
    best = found.groupBy("qid").agg(F.min("rule").alias("rule"))
    out = asked.join(best, "qid", "left")
    clean = F.trim(F.regexp_replace(F.regexp_replace("query", F.coalesce("rule.pattern", F.lit("$^")), F.lit(" ")), r"\s+", " "))
    return out.select("qid", "rule.product", "rule.revision", "rule.layer", F.when(F.col("rule").isNull() | (clean == ""), F.col("query")).otherwise(clean).alias("stripped"))


def validated(rows: DataFrame, products: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """``rows`` (qid, product, revision, layer) as a model proposed them: the scope if the catalog
    knows it, else null layer."""
    low = rows.select("qid", F.lower(F.trim("product")).alias("p"), F.lower(F.trim("revision")).alias("r"), F.coalesce("layer", F.lit("inherit")).alias("l"))
    low = low.withColumns({"p": F.when(F.col("p") != "", F.col("p")), "r": F.when(F.col("r") != "", F.col("r"))})
    known = low.join(products.withColumnRenamed("product", "p"), "p", "left")
    has_product, has_revision = F.col("revisions").isNotNull(), F.coalesce(F.array_contains("revisions", F.col("r")), F.lit(False))
    top = (F.col("l") == "enterprise") | (F.col("p") == layout.enterprise)
    shared = F.col("r") == layout.shared_build
    layer = (F.when(F.coalesce(top, F.lit(False)), "enterprise").when(F.coalesce(shared, F.lit(False)), F.when(has_product, "project_common"))
             .when(F.col("p").isNotNull() & ~has_product, None).when(F.col("r").isNotNull(), F.when(has_product & has_revision, "build")).when(F.col("p").isNotNull(), F.col("l")))
    out = known.withColumn("layer", layer)
    named = F.col("layer").isNotNull() & (F.col("layer") != "enterprise")
    return out.select("qid", F.when(named, F.col("p")).alias("product"), F.when(F.col("layer").eqNullSafe("build") & F.col("r").isNotNull(), F.col("r")).alias("revision"), "layer")


def merged(rules: DataFrame, prepared: DataFrame) -> DataFrame:
    """A valid prepared scope wins over the rules' (both: qid, product, revision, layer)."""
    a, b = prepared.alias("a"), rules.alias("b")
    both = b.join(a, "qid", "full_outer")
    use = F.col("a.layer").isNotNull()
    return both.select("qid", *[F.when(use, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("product", "revision", "layer")])


def targets(inferred: DataFrame, products: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """``inferred`` (qid, product, revision, layer) to (qid, project, build, scope_rank)."""
    top = inferred.filter("layer = 'enterprise'").select("qid", F.lit(layout.enterprise).alias("project"), F.lit(layout.enterprise).alias("build"))
    shared = inferred.filter("layer = 'project_common' and product is not null").select("qid", F.col("product").alias("project"), F.lit(layout.shared_build).alias("build"))
    build = inferred.filter("layer = 'build' and product is not null and revision is not null").select("qid", F.col("product").alias("project"), F.col("revision").alias("build"))
    fixed = ranks(top.unionAll(shared).unionAll(build), layout)
    open_ = inherit_ranks(inferred.filter("layer = 'inherit' and product is not null").select("qid", "product"), products, layout)
    return fixed.unionByName(open_)


def is_build_schematic(kind: Column, project: Column, build: Column, target_project: Column, target_build: Column, layout: Layout = LAYOUT) -> Column:
    own = (kind == "schematic") & (project != "") & (build != "") & (project != layout.enterprise) & (build != layout.shared_build)
    return own & F.coalesce(project == target_project, F.lit(True)) & F.coalesce(build == target_build, F.lit(True))


def phases(scopes: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(qid, tier, pairs): scopes grouped by tier, in the order in which they are searched."""
    rows = scopes.withColumn("tier", tier(F.col("project"), F.col("build"), layout))
    return rows.groupBy("qid", "tier").agg(F.array_sort(F.collect_set(F.concat_ws("/", "project", "build"))).alias("pairs"))


def gated(hits: DataFrame, minimum: float | None) -> DataFrame:
    """Hits of questions whose best score reaches ``minimum``; null lets all through."""
    if minimum is None:
        return hits
    top = F.max("score").over(Window.partitionBy("qid"))
    return hits.withColumn("top_score", top).filter(F.col("top_score") >= minimum)
