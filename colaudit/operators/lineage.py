"""Columns that SQL statements read and write.

Statements are first reduced to templates (literals and parameters become markers) and made distinct.  A state machine
(``statements``) lists on the executors what each template mentions; the names are then resolved by a join with the
catalogue: candidates are rows of (statement, name, level of the query, table), owners are counted, and the innermost
query that has one owner wins.  No template and no catalogue passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LINEAGE
from ..scratch import reach_workers
from .statements import mentions

Catalog = dict[str, list[str]]
_CANDIDATE = "struct<table:string,alias:string,derived:boolean>"
_REF = f"struct<kind:string,qualifier:string,name:string,levels:array<array<{_CANDIDATE}>>>"
_TEXTS = "array<string>"


def template_of(sql: Column) -> Column:
    """Comments dropped, literals, numbers and $1 markers as ?, white space as one space."""
    text = r"'[^']*+(?:''[^']*+)*+'|\$(?<tag>(?:[A-Za-z_]\w*+)?)\$(?s:.*?)\$\k<tag>\$"
    t = F.regexp_replace(sql, rf"({text})|--[^\n]*+|/\*(?s:.*?)\*/", "$1 ")
    t = F.regexp_replace(t, text, "?")
    t = F.regexp_replace(t, r"\$\d+|%s|%\(\w+\)s|(?<![\w.])\d+(?:\.\d+)?(?!\w)", "?")
    t = F.regexp_replace(t, r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def references(sql: str) -> tuple[str, list[tuple[str, str, str, list]]]:
    """(method, references) of a statement: each with the tables it may belong to, by level from the inside out.

    A qualified name has the tables of that alias in the innermost query that knows it; at no level, the table so named.
    """
    method, found = mentions(sql)
    tables: dict[int, list[tuple[str, str, bool]]] = {}
    for kind, scopes, alias, name in found:
        if kind in ("table", "derived") and (row := (name, alias, kind == "derived")) not in tables.setdefault(scopes[0], []):
            tables[scopes[0]].append(row)
    out = []
    for kind, scopes, qualifier, name in found:
        if kind in ("write", "all"):
            table = qualifier if kind == "write" else name
            out.append((kind, "", name, [[(table, table, False)]]))
        elif kind in ("read", "both", "star"):
            levels = [tables.get(s, []) for s in scopes]
            if qualifier:
                wanted = qualifier.lower()
                hits = [[t for t in level if wanted == t[1].lower()] or [t for t in level if wanted == t[0].lower()] for level in levels]
                levels = [next((h[:1] for h in hits if h), [(qualifier, qualifier, False)])]
            elif kind != "read":
                levels = levels[:1]
            out.append((kind, qualifier, name, levels))
    return method, list(dict.fromkeys((k, q, n, tuple(map(tuple, levels))) for k, q, n, levels in out))


def parsed(templates: DataFrame) -> DataFrame:
    """templates(sql, …) -> (sql, method, refs), a row for each row."""

    def run(batches):
        import pyarrow as pa

        ref = pa.struct([("kind", pa.string()), ("qualifier", pa.string()), ("name", pa.string()), ("levels", pa.list_(pa.list_(pa.struct([("table", pa.string()), ("alias", pa.string()), ("derived", pa.bool_())]))))])
        for b in batches:
            sql = b.column(0)
            done = [references(s) for s in sql.to_pylist()]
            refs = [[{"kind": k, "qualifier": q, "name": n, "levels": [[dict(zip(("table", "alias", "derived"), t)) for t in level] for level in levels]} for k, q, n, levels in r] for _, r in done]
            yield pa.RecordBatch.from_arrays([sql, pa.array([m for m, _ in done], pa.string()), pa.array(refs, pa.list_(ref))], ["sql", "method", "refs"])

    reach_workers(templates.sparkSession)
    return templates.mapInArrow(run, f"sql string, method string, refs array<{_REF}>")


def _known(spark: SparkSession, catalog: Catalog | DataFrame | None) -> DataFrame | None:
    """(_key, _table, _names): a row for each table, with the spelling of its columns by lower case."""
    if catalog is None:
        return None
    if isinstance(catalog, dict):
        catalog = spark.createDataFrame([(t, c) for t, names in catalog.items() for c in names], "`table` string, name string")
    names = F.map_from_entries(F.collect_set(F.struct(F.lower("name").alias("k"), F.col("name").alias("v"))))
    return catalog.select("table", "name").dropDuplicates(["table", "name"]).groupBy(F.lower("table").alias("_key")).agg(F.min("table").alias("_table"), names.alias("_names"))


def resolve(statements: DataFrame, catalog: Catalog | DataFrame | None, expand: bool = False) -> DataFrame:
    """(sql, method, refs) -> LINEAGE, by a join of the candidates with the catalogue.

    Rows are dealt by statement once; all groups lie within one.  expand: an INSERT without a column list, which stands
    among the wildcards, counts as reads of the known table's columns.
    """
    known = _known(statements.sparkSession, catalog)
    keys = ["sql", "method", "ref", "kind", "qualifier", "name"]
    x = statements.repartition("sql").select("sql", "method", F.posexplode_outer("refs").alias("ref", "r")).select(*keys[:3], "r.kind", "r.qualifier", "r.name", F.posexplode_outer("r.levels").alias("level", "tables"))
    x = x.select(*keys, "level", F.explode_outer("tables").alias("t")).select("*", "t.table", "t.derived").drop("t")
    if known is None:
        x = x.withColumns({"_table": F.lit(None).cast("string"), "_names": F.lit(None).cast("map<string,string>")})
    else:
        x = x.join(known, F.lower("table") == F.col("_key"), "left")
    base = F.coalesce(~F.col("derived"), F.lit(False))
    listed = base & F.col("_table").isNotNull()
    owned = F.when(listed, F.element_at("_names", F.lower("name")))
    spelled = F.concat_ws(".", F.coalesce("_table", "table"), F.coalesce(owned, "name"))
    free = base if known is None else F.lit(False)  # without a catalogue the only table of a query has the column
    per_level = x.groupBy(*keys, "level").agg(
        F.collect_set(F.when(owned.isNotNull(), spelled)).alias("owners"),
        F.collect_set(F.when(free, spelled)).alias("open"),
        F.count("table").alias("n"),
        F.max("table").alias("one"),
        F.flatten(F.collect_list(F.when(listed, F.transform(F.map_values("_names"), lambda c: F.concat_ws(".", "_table", c))))).alias("columns"),
        F.collect_set(F.when(base & F.col("_table").isNull(), F.concat(F.col("table"), F.lit(".*")))).alias("stars"),
        F.max(F.when(base, spelled)).alias("written"),
    )
    # what a level says of a name: one owner, more than one (it stays open there), or nothing
    lone = (F.size("open") == 1) & (F.col("n") == 1)
    says = F.when(F.size("owners") == 1, F.col("owners")[0]).when(F.size("owners") > 1, F.lit("")).when(lone, F.col("open")[0]).when(F.lit(known is None) & (F.col("n") > 0), F.lit(""))
    best = per_level.withColumn("says", says).groupBy(*keys).agg(
        F.min_by("says", F.when(F.col("says").isNotNull(), F.col("level"))).alias("says"),
        F.max(F.when(F.col("level") == 0, F.col("one"))).alias("one"),
        *[F.flatten(F.collect_list(F.when(F.col("level") == 0, F.col(c)))).alias(c) for c in ("owners", "open", "columns", "stars")],
        F.max("written").alias("written"),
    )
    none = F.array().cast(_TEXTS)
    hit = F.nullif("says", F.lit(""))
    named = F.when(F.col("qualifier") == "", F.col("name")).otherwise(F.concat_ws(".", F.coalesce("one", "qualifier"), "name"))
    reads = F.when(F.col("kind") == "read", F.when(hit.isNotNull(), F.array(hit)).otherwise(none)).when(F.col("kind") == "both", F.when(F.size("owners") > 0, F.col("owners")).otherwise(F.col("open"))).when((F.col("kind") == "star") | F.lit(expand) & (F.col("kind") == "all"), F.col("columns")).otherwise(none)
    writes = F.when(F.col("kind") == "write", F.array("written")).otherwise(none)
    wild = F.when(F.col("kind") == "star", F.col("stars")).when((F.col("kind") == "all") & ~(F.lit(expand) & (F.size("columns") > 0)), F.array(F.concat("one", F.lit(".*")))).otherwise(none)
    unknown = F.when((F.col("kind") == "read") & hit.isNull(), F.array(named)).otherwise(none)
    lists = {"reads": reads, "writes": writes, "wildcards": wild, "unresolved": unknown}
    out = best.groupBy("sql", "method").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(v)))).alias(k) for k, v in lists.items()])
    full = {k: F.col(k) for k in lists}
    some = F.size(F.concat(full["reads"], full["writes"], full["wildcards"])) > 0
    ok = F.when(F.col("method") == "none", False).when(F.col("method") == "delete", True).otherwise(some)
    how = F.when(~ok, "none").when(F.col("method") == "insert-regex", F.col("method")).otherwise("parser")
    return out.select("sql", *[v.alias(k) for k, v in full.items()], ok.alias("parsed_ok"), how.alias("method"))


def lineage_table(statements: DataFrame, catalog: Catalog | DataFrame | None = None, templated: bool = False, expand: bool = False) -> DataFrame:
    """statements(sql) -> LINEAGE, one row per distinct template.

    catalog: rows (table, name) or a dict; without it, a name belongs to the only table of its query.  templated: sql
    holds templates already.
    """
    distinct = statements.select((F.col("sql") if templated else template_of(F.col("sql"))).alias("sql")).where("sql <> ''").distinct()
    return resolve(parsed(distinct), catalog, expand)


def lineage(spark: SparkSession, sql: str, catalog: Catalog | DataFrame | None = None) -> dict:
    """reads, writes, wildcards, unresolved, parsed_ok and method of one statement; it never raises."""
    row = resolve(parsed(spark.createDataFrame([(sql or "",)], "sql string")), catalog).first()
    return {c.split()[0]: row[c.split()[0]] for c in LINEAGE.split(", ")[1:]}


def expand_wildcards(table: DataFrame, columns: DataFrame) -> DataFrame:
    """``t.*`` becomes reads of all known columns of t; unknown tables' wildcards stay."""
    known = columns.groupBy(F.concat("table", F.lit(".*")).alias("w")).agg(F.collect_set("qualified_name").alias("names"))
    found = table.select("sql", F.explode("wildcards").alias("w")).join(known, "w", "left")
    found = found.groupBy("sql").agg(F.flatten(F.collect_list("names")).alias("more"), F.array_compact(F.collect_list(F.when(F.col("names").isNull(), F.col("w")))).alias("left_over"))
    none = F.array().cast(_TEXTS)
    joined = table.join(found, "sql", "left")
    return joined.select("sql", F.array_sort(F.array_union("reads", F.coalesce("more", none))).alias("reads"), "writes", F.coalesce("left_over", none).alias("wildcards"), "unresolved", "parsed_ok", "method")
