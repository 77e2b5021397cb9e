"""The symbol graph from source text: tables of an extract, resolved references, calls, and updates.

`write_extracts` reads every file once; all tables are selections of what it wrote. Ids are language:path:name:line.
Resolution is joins on names; where a name has many symbols, counts by name decide before any pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import graph
from quillon.sources.store import keep
from quillon.sources import symbols as source

KINDS = ("class", "interface", "struct", "enum", "type")
OWN = ("this", "self", "cls")


def write_extracts(corpus: DataFrame, path: str) -> DataFrame:
    source.extracts(corpus).write.mode("overwrite").parquet(path)
    return corpus.sparkSession.read.parquet(path)


def _id(ordinal: Column) -> Column:
    """The id of a file's symbol by its ordinal."""
    x = F.get("symbols", ordinal)
    return F.when(ordinal.isNotNull(), graph.symbol_id(F.col("language"), F.col("rel_path"), x["qualified_name"], x["start_line"]))


def _rows(extracts: DataFrame, part: str, *columns: Column) -> DataFrame:
    return extracts.select("rel_path", "language", "symbols", F.explode(part).alias("x")).select("rel_path", "language", *columns)


def symbols(extracts: DataFrame) -> DataFrame:
    """One row a symbol. A file that declares a name twice on a line keeps the first."""
    rows = _rows(extracts, "symbols", _id(F.col("x.symbol_ord").cast("int")).alias("id"), F.col("x.*"), _id(F.col("x.container_ord")).alias("container_id")).drop("container_ord")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("rel_path", "id").orderBy("symbol_ord"))).where("_k = 1").drop("_k")


def imports(extracts: DataFrame) -> DataFrame:
    """Imports with the file they name: the first of its candidates that is in the corpus, or null."""
    rows = _rows(extracts, "imports", F.col("x.local_name"), F.col("x.imported_name"), F.col("x.kind").alias("import_kind"), F.col("x.specifier"), F.col("x.candidates"), F.col("x.line"))
    wanted = rows.select("rel_path", "specifier", "candidates").distinct().select("rel_path", "specifier", "candidates", F.posexplode("candidates").alias("_k", "target"))
    files = extracts.select(F.col("rel_path").alias("target"))
    found = wanted.join(files, "target").groupBy("rel_path", "specifier", "candidates").agg(F.min_by("target", "_k").alias("target_rel_path"))
    return rows.join(found, ["rel_path", "specifier", "candidates"], "left").drop("candidates")


def tokens(extracts: DataFrame) -> DataFrame:
    """Names in code, each with an id, its innermost symbol and the type around that."""
    rows = _rows(extracts, "tokens", F.col("x.*"), _id(F.col("x.enclosing_ord")).alias("enclosing_symbol_id"), _id(F.col("x.container_ord")).alias("container_id"))
    return rows.drop("enclosing_ord", "container_ord").withColumn("ref_id", F.concat_ws(":", "rel_path", "line", "column")).dropDuplicates(["ref_id"])


def bindings(extracts: DataFrame, types: DataFrame) -> DataFrame:
    """(scope_id, variable, class_id): the last type that a scope binds a name to, where that type's name is unique, or is in its file."""
    rows = _rows(extracts, "bindings", F.coalesce(_id(F.col("x.scope_ord")), F.col("rel_path")).alias("scope_id"), F.col("x.variable"), F.col("x.type_name"), F.col("x.line"))
    last = rows.groupBy("rel_path", "scope_id", "variable").agg(F.max_by("type_name", "line").alias("name"))
    return _named_type(last, types).where("type_id is not null").select("scope_id", "variable", F.col("type_id").alias("class_id"))


def _named_type(rows: DataFrame, types: DataFrame) -> DataFrame:
    """rows(rel_path, name) with type_id: the first of the file, else the only one of all, else null."""
    here = types.groupBy("rel_path", "name").agg(F.min_by("id", "symbol_ord").alias("_here"))
    all_ = types.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_one"))
    out = rows.join(here, ["rel_path", "name"], "left").join(all_, "name", "left")
    return out.withColumn("type_id", F.coalesce("_here", F.when(F.col("_n") == 1, F.col("_one")))).drop("_here", "_n", "_one")


def _members(rows: DataFrame, sym: DataFrame, closure: DataFrame) -> DataFrame:
    """rows(ref_id, name, owner, up) to (ref_id, callee): the owner's member of that name, else its ancestors' only or nearest by id."""
    own = sym.where("container_id is not null").groupBy(F.col("container_id").alias("owner"), "name").agg(F.min_by("id", "symbol_ord").alias("callee"))
    direct = rows.where("not up").join(own, ["owner", "name"]).select("ref_id", "callee", F.lit(0).alias("tier"))
    above = closure.select(F.col("descendant").alias("owner"), "ancestor")
    over = rows.join(above, "owner").drop("owner").withColumnRenamed("ancestor", "owner").join(own, ["owner", "name"]).select("ref_id", "callee", F.lit(1).alias("tier"))
    return direct.unionByName(over).groupBy("ref_id").agg(F.min(F.struct("tier", "callee")).alias("m")).select("ref_id", F.col("m.callee").alias("callee"))


def resolve_members(toks: DataFrame, sym: DataFrame, closure: DataFrame, bound: DataFrame, imps: DataFrame) -> DataFrame:
    """(ref_id, target_symbol_id) of names after a receiver.

    this, self and cls give the class around and then its ancestors, super the ancestors; else a binding of the receiver in
    the enclosing symbol, the type around it or the file, an imported module, or a type of that name, in this order.
    """
    rows = toks.where("receiver is not null and receiver <> ''").select("ref_id", "name", "receiver", "rel_path", "enclosing_symbol_id", "container_id")
    types = sym.where(F.col("kind").isin(*KINDS))
    own = rows.where(F.col("receiver").isin(*OWN, "super") & F.col("container_id").isNotNull()).select("ref_id", "name", F.col("container_id").alias("owner"), (F.col("receiver") == "super").alias("up"))
    far = rows.where(~F.col("receiver").isin(*OWN, "super"))
    scopes = F.filter(F.array("enclosing_symbol_id", "container_id", "rel_path"), lambda x: x.isNotNull())
    scoped = far.select("ref_id", "name", F.col("receiver").alias("variable"), F.posexplode(scopes).alias("_k", "scope_id"))
    typed = scoped.join(bound, ["scope_id", "variable"]).groupBy("ref_id", "name").agg(F.min_by("class_id", "_k").alias("owner"))
    named = _named_type(far.select("ref_id", F.col("name").alias("member"), "rel_path", F.col("receiver").alias("name")), types).where("type_id is not null")
    # every reference has at most one owner: its binding's type, or the type that its receiver names
    named = named.select("ref_id", F.col("member").alias("name"), F.col("type_id").alias("owner")).join(typed, "ref_id", "left_anti")
    owned = own.unionByName(typed.unionByName(named).withColumn("up", F.lit(False)))
    members = _members(owned, sym, closure).withColumn("tier", F.lit(0))
    tops = sym.where("container_id is null").groupBy("rel_path", "name").agg(F.min_by("id", "symbol_ord").alias("callee")).withColumnRenamed("rel_path", "target_rel_path")
    modules = imps.where("imported_name is null and target_rel_path is not null").groupBy("rel_path", F.col("local_name").alias("receiver")).agg(F.min("target_rel_path").alias("target_rel_path"))
    there = far.join(modules, ["rel_path", "receiver"]).join(tops, ["target_rel_path", "name"]).select("ref_id", "callee", F.lit(1).alias("tier"))
    return members.unionByName(there).groupBy("ref_id").agg(F.min_by("callee", "tier").alias("target_symbol_id"))


def resolve_selections(extracts: DataFrame, sym: DataFrame) -> DataFrame:
    """Selections of GraphQL operations to the fields of the schema, level by level through the types of the parents' fields."""
    rows = _rows(extracts, "selections", F.col("x.*"), _id(F.col("x.enclosing_ord")).alias("enclosing_symbol_id"))
    fields = sym.where("language = 'graphql' or kind = 'method'").where("container_name is not null").groupBy(F.col("container_name").alias("type"), "name").agg(F.min("id").alias("target_symbol_id"), F.min(F.get("extends_names", F.lit(0))).alias("gives"))
    level = rows.where("root is not null").withColumn("type", F.col("root")).join(fields, ["type", "name"], "left")
    level = level.withColumn("gives", F.when(F.col("parent") == -2, F.col("root")).otherwise(F.col("gives")))
    below, out = rows.where("root is null"), []
    while not (level := keep(level)).isEmpty():
        out.append(level)
        up = level.where("gives is not null").select("rel_path", F.col("node").alias("parent"), F.col("gives").alias("type"))
        level = below.join(up, ["rel_path", "parent"]).join(fields, ["type", "name"], "left").select(*out[0].columns)
    found = level
    for x in out:
        found = found.unionByName(x)
    return found.where("target_symbol_id is not null").select("target_symbol_id", F.lit("usage").alias("edge_kind"), "name", "rel_path", "line", "column", "enclosing_symbol_id").distinct()


def references(extracts: DataFrame, sym: DataFrame, closure: DataFrame) -> DataFrame:
    """refs(target_symbol_id, edge_kind, name, rel_path, line, column, enclosing_symbol_id): members by receiver, else by name.

    Where only a type may stand, other targets do not count. An edge is a call or a construct only within a symbol.
    """
    toks, imps = tokens(extracts), imports(extracts)
    declared = sym.select("rel_path", F.col("start_line").alias("line"), F.col("start_column").alias("column"))
    toks = toks.join(declared.distinct(), ["rel_path", "line", "column"], "left_anti")
    members = resolve_members(toks, sym, closure, bindings(extracts, sym.where(F.col("kind").isin(*KINDS))), imps)
    names = graph.resolve(toks.where("receiver is null").select("ref_id", "name", "rel_path", "line", "column"), sym, imps.where("imported_name is not null and target_rel_path is not null")).select("ref_id", "target_symbol_id")
    loose = toks.where("receiver is not null").join(members, "ref_id", "left_anti").select("ref_id", "name", "rel_path", "line", "column")
    # an unknown receiver falls back to the name
    names = names.unionByName(graph.resolve(loose, sym).select("ref_id", "target_symbol_id")).where("target_symbol_id is not null")
    kinds = sym.select(F.col("id").alias("target_symbol_id"), F.col("kind").alias("target_kind"))
    rows = toks.join(members.unionByName(names), "ref_id").join(kinds, "target_symbol_id")
    is_type = F.col("target_kind").isin(*KINDS)
    rows = rows.where(~F.col("in_type") | is_type)
    edge = F.when(F.col("enclosing_symbol_id").isNotNull() & (F.col("is_call") | F.col("is_new")), F.when(F.col("is_new") | is_type, "construct").otherwise("call")).otherwise("usage")
    out = rows.select("target_symbol_id", edge.alias("edge_kind"), "name", "rel_path", "line", "column", "enclosing_symbol_id")
    return out.unionByName(resolve_selections(extracts, sym)).dropDuplicates(["target_symbol_id", "rel_path", "line", "column"])


def call_sites(extracts: DataFrame) -> DataFrame:
    """calls of `graph.resolve_calls`: names that are called within a symbol; where one is declared is no call."""
    declared = symbols(extracts).select("rel_path", "name", F.col("start_line").alias("line"), F.col("start_column").alias("column"))
    return tokens(extracts).where("is_call and enclosing_symbol_id is not null").join(declared, ["rel_path", "name", "line", "column"], "left_anti").select(F.col("ref_id").alias("call_id"), "name", F.when(F.col("receiver") != "", F.col("receiver")).alias("receiver"), "rel_path", "language", "container_id", "enclosing_symbol_id", "line", "column")


def write_graph(corpus: DataFrame, path: str) -> None:
    """Extracts, symbols, hierarchy and references as tables under a folder."""
    spark = corpus.sparkSession
    parts = write_extracts(corpus, f"{path}/extracts")
    save = lambda df, name: (df.write.mode("overwrite").parquet(f"{path}/{name}"), spark.read.parquet(f"{path}/{name}"))[1]
    sym = save(symbols(parts), "symbols")
    closure = save(graph.descendants(graph.parents(sym)), "hierarchy")
    save(references(parts, sym, closure), "refs")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("extracts", "symbols", "hierarchy", "refs")}


def exported(symbols: DataFrame) -> DataFrame:
    """Symbols outside of any container that other files may use, by their signatures: `export`, `public`, no private mark, no leading underscore in Python."""
    text = F.col("signature")
    script = text.rlike(r"^(export|module\.exports)\b")
    java = text.rlike(r"\bpublic\b") | (F.col("kind") == "interface")
    kotlin = ~text.rlike(r"\b(private|internal|protected)\b")
    python = ~F.startswith("name", F.lit("_"))
    symbols = symbols.where(F.col("container_name").isNull())
    return symbols.where(F.when(F.col("language").isin(*source.SCRIPT), script).when(F.col("language") == "java", java).when(F.col("language") == "kotlin", kotlin).when(F.col("language") == "python", python).otherwise(F.lit(True)))
