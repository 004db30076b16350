"""Point lookups an editor asks for, as joins: definitions, references, hovers, blame, diagnostics, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import xref

# Numeric codes of symbol kinds in editor protocols.
KIND_CODES = {"module_definition": 2, "class_definition": 5, "method_definition": 6, "constructor_definition": 9, "enum_definition": 10, "interface_definition": 11, "function_definition": 12, "variable_definition": 13, "constant_definition": 14, "struct_definition": 23, "type_definition": 26}


def workspace_symbols(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols whose name has the text in it, in any case; all for an empty text."""
    return symbols.where(F.lower(F.coalesce("name", F.lit(""))).contains(text.lower()))


def document_symbols(symbols: DataFrame, file: str) -> DataFrame:
    code = F.create_map(*[F.lit(x) for kv in KIND_CODES.items() for x in kv])
    return symbols.where(F.col("file") == file).select("name", "kind", F.coalesce(code[F.col("kind")], F.lit(13)).alias("code"), "start_line", "end_line")


def hover(at: DataFrame, symbols: DataFrame) -> DataFrame:
    """at (ref_id, file, line) with the first symbol, in the order of its file, whose span holds the line."""
    w = Window.partitionBy("file").orderBy("start_line", "name")
    s = symbols.select("file", F.struct("name", "kind", "start_line").alias("id"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.row_number().over(w).alias("ord"))
    bins = s.where("start <= end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))))
    met = at.withColumn("_bin", F.floor(F.col("line") / 64)).join(bins, ["file", "_bin"]).where("line BETWEEN start AND end")
    best = met.groupBy("ref_id").agg(F.min(F.struct("ord", "id")).alias("b"))
    return at.join(best.select("ref_id", F.col("b.id.name").alias("name"), F.col("b.id.kind").alias("kind")), "ref_id", "left")


def definition_of(at: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """at (ref_id, file, line, name) with target_file, target_line: a resolved reference on the line, else the first symbol of the name.

    resolved: file, line, target_file, target_line.
    """
    on_line = resolved.groupBy("file", "line").agg(F.min(F.struct("target_file", "target_line")).alias("_r"))
    by_name = symbols.groupBy("name").agg(F.min(F.struct("file", "start_line")).alias("_s"))
    met = at.join(on_line, ["file", "line"], "left").join(by_name, "name", "left")
    return met.select("ref_id", F.coalesce("_r.target_file", "_s.file").alias("target_file"), F.coalesce("_r.target_line", "_s.start_line").alias("target_line"))


def references_of(name: str, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, line, what: every declaration and reference with the bare name (also what a rename touches)."""
    return symbols.where(F.col("name") == name).select("file", F.col("start_line").alias("line"), F.lit("declaration").alias("what")).unionByName(refs.where(F.col("name") == name).select("file", "line", F.lit("reference").alias("what"))).distinct()


def blamed(symbols: DataFrame, blame: DataFrame) -> DataFrame:
    """symbols with author and time of the commit their first line comes from. blame: file, line, author, time."""
    return symbols.join(blame.select("file", F.col("line").alias("start_line"), "author", "time"), ["file", "start_line"], "left")


def diagnosed(symbols: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """file, name, start_line, messages: the messages of all lines within each definition."""
    s = symbols.select("file", "name", "start_line", "end_line")
    met = diagnostics.join(s, "file").where("line BETWEEN start_line AND end_line")
    return met.groupBy("file", "name", "start_line").agg(F.sort_array(F.collect_set(F.struct("line", "message"))).alias("messages"))


def ancestors(scopes: DataFrame, most: int = 32) -> DataFrame:
    """scope_id, ancestor, dist: every scope with the scopes around it, itself at 0. scopes: scope_id, parent_id."""
    from tessera.session import materialise

    level = materialise(scopes.select("scope_id", F.col("scope_id").alias("ancestor"), F.lit(0).alias("dist")), "scopes")
    out = level
    up = scopes.select(F.col("scope_id").alias("ancestor"), "parent_id").where("parent_id IS NOT NULL")
    for k in range(1, most + 1):
        level = materialise(level.join(up, "ancestor").select("scope_id", F.col("parent_id").alias("ancestor"), F.lit(k).alias("dist")), "scopes")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def resolve_in_scopes(refs: DataFrame, scopes: DataFrame, defs: DataFrame) -> DataFrame:
    """refs (ref_id, scope_id, name) with def_id: the definition in the innermost scope outwards, the first by order.

    defs: def_id, scope_id, name, ord. Unknown names get NULL.
    """
    chain = ancestors(scopes)
    met = refs.join(chain, "scope_id").join(defs.select(F.col("scope_id").alias("ancestor"), "name", "def_id", "ord"), ["ancestor", "name"])
    best = met.groupBy("ref_id").agg(F.min(F.struct("dist", "ord", "def_id")).alias("b")).select("ref_id", F.col("b.def_id").alias("def_id"))
    return refs.join(best, "ref_id", "left")


def visible_at(imports: DataFrame, package: DataFrame, params: DataFrame, locals_: DataFrame, line: int) -> DataFrame:
    """name, kind, decl_line visible at a line. Each input has name, kind, decl_line; later ones shadow earlier ones.

    Locals declared after the line aren't visible.
    """
    parts = [imports, package, params, locals_.where(F.col("decl_line") <= line)]
    both = None
    for k, p in enumerate(parts):
        q = p.select("name", "kind", "decl_line", F.lit(k).alias("_o"))
        both = q if both is None else both.unionByName(q)
    return both.groupBy("name").agg(F.max(F.struct("_o", "decl_line", "kind")).alias("r")).select("name", "r.kind", "r.decl_line")


def import_targets(imports: DataFrame, files: DataFrame, module: str | None = None) -> DataFrame:
    """file, import, target: files of the index an import may mean, by the rules of the importing file's language.

    Candidate paths are laid out as rows and looked up by equality: Go by directory below the module, Python by dotted
    name and relative dots, JavaScript and TypeScript by relative path with the usual endings.
    """
    here = F.regexp_extract("file", r"^(?:(.*)/)?[^/]*$", 1)
    join = lambda *p: F.regexp_replace(F.concat(*p), r"^/|(?<=/)/", "")
    imp = F.col("import")
    go = imports.where("file LIKE '%.go'").select("file", "import", xref.local_package("import", module).alias("dir")).where("dir IS NOT NULL")
    by_dir = files.select(F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1).alias("dir"), F.col("path").alias("target")).where("target LIKE '%.go'")
    go = go.join(by_dir, "dir").select("file", "import", "target")
    dots = F.length(F.regexp_extract("import", r"^(\.*)", 1))
    parts = F.split(here, "/")
    base = F.when(dots > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")).otherwise(F.lit(""))
    tail = F.regexp_replace(F.regexp_replace("import", r"^\.+", ""), r"\.", "/")
    py = imports.where("file LIKE '%.py'").select("file", "import", F.explode(F.array(join(base, F.lit("/"), tail, F.lit(".py")), join(base, F.lit("/"), tail, F.lit("/__init__.py")))).alias("target"))
    js = imports.where(F.col("file").rlike(r"\.[jt]sx?$") & imp.rlike(r"^\.{1,2}/"))
    up = F.size(F.split("import", r"\.\./")) - 1
    root = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), "/")
    rest = F.regexp_replace("import", r"^(?:\.{1,2}/)+", "")
    js = js.select("file", "import", F.explode(F.array(*[join(root, F.lit("/"), rest, F.lit(x)) for x in ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")])).alias("target"))
    known = files.select(F.col("path").alias("target"))
    return go.unionByName(py.join(known, "target").select("file", "import", "target")).unionByName(js.join(known, "target").select("file", "import", "target")).distinct()
