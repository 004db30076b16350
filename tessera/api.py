"""One entry for the analyses: Engine(spark, tables).call(name, **arguments) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed, globs, selector, text
from tessera.operators import chunks, diff, graph, metrics, rules, similarity, xref
from tessera.sources import scopes, structural


class Engine:
    """Analyses over an index: tables files, symbols, refs, imports and, where known, sources, functions, churn.

    Definitions and call edges are built once per engine and kept; every method gives a DataFrame. `generated` says per
    call whether generated files count: 'exclude', 'only', or 'include'.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], module: str | None = None) -> None:
        self.spark, self.tables, self.module = spark, tables, module
        self._graph: tuple[DataFrame, DataFrame] | None = None

    # --- relations ---

    def files(self, generated: str = "include") -> DataFrame:
        f = self.tables["files"]
        if generated == "include" or "gen_reason" not in f.columns:
            return f
        return f.where("gen_reason IS NULL" if generated == "exclude" else "gen_reason IS NOT NULL")

    def symbols(self, generated: str = "include") -> DataFrame:
        s = self.tables["symbols"]
        return s if generated == "include" else s.join(self.files(generated).select(F.col("path").alias("file")), "file", "left_semi")

    def definitions(self) -> DataFrame:
        s = self.symbols().where(F.col("kind").isin(*xref.CALLABLE))
        ident = F.concat_ws("\x00", "file", "kind", "name", F.col("start_line").cast("string"))
        return s.select(ident.alias("id"), "file", text.dirname("file").alias("package"), "name", "kind", F.coalesce("receiver", F.lit("")).alias("receiver"), "start_line", "end_line")

    def _located(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        defs = self.definitions()
        refs = self.tables["refs"].where(F.col("kind").startswith("reference.call")).withColumn("ref_id", F.xxhash64("file", "line", "col", "name"))
        spans = defs.select("file", "id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        inside = xref.enclosing(refs, spans).select("ref_id", "file", "name", "line", "col", F.col("span_id").alias("caller_id")).withColumn("package", text.dirname("file"))
        paths = self.tables["imports"].select("file", F.explode(xref.import_paths(F.col("import"))).alias("_p"))
        imports = paths.select("file", xref.local_package("_p", self.module).alias("package")).where("package IS NOT NULL").distinct()
        return inside, defs, imports

    def edges(self) -> DataFrame:
        if self._graph is None:
            refs, defs, imports = self._located()
            self._graph = (xref.call_edges(refs, defs, imports).cache(), refs)
        return self._graph[0]

    def _steps(self) -> DataFrame:
        return self.edges().select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "count")

    def find(self, name: str, regex: bool = False, kind: str = "", file: str = "") -> DataFrame:
        """Definitions by name; `path:Name` narrows to files that end in the path."""
        if ":" in name and not regex:
            file, name = name.rsplit(":", 1)
        d = self.definitions().where(F.col("name").rlike(selector.java_pattern(name)) if regex else F.col("name") == name)
        if kind:
            d = d.where(F.col("kind").contains(kind))
        if file:
            d = d.where(F.col("file") == file) if "/" in file else d.where(F.col("file").endswith(file))
        return d

    # --- index ---

    def call_map(self, generated: str = "include") -> DataFrame:
        return self.symbols(generated).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start_line", "kind", "name"))).alias("symbols"))

    def call_files(self, language: str = "", min_symbols: int = 0, sort: str = "symbols", top: int = 50, generated: str = "include") -> DataFrame:
        a = self.symbols().groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
        b = self.tables["imports"].groupBy(F.col("file").alias("path")).agg(F.count("*").alias("imports"))
        f = self.files(generated).join(a, "path", "left").join(b, "path", "left").na.fill(0, ["symbols", "imports"]).where(F.col("symbols") >= min_symbols)
        f = f.where(F.lower("language") == language.lower()) if language else f
        order = [F.asc("path")] if sort == "path" else [F.desc("size_bytes" if sort == "size" else sort), F.asc("path")]
        return metrics.top(f, order, top)

    def call_stats(self, generated: str = "include") -> DataFrame:
        s = self.symbols(generated).groupBy(F.lit("kind").alias("by"), F.col("kind").alias("key")).agg(F.count("*").alias("n"))
        f = self.files(generated).groupBy(F.lit("language").alias("by"), F.coalesce("language", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))
        return s.unionByName(f)

    def call_diff(self, before: DataFrame) -> DataFrame:
        return diff.table_diff(before, self.symbols(), ["file", "kind", "receiver", "name"], ["signature", "start_line", "end_line"])

    def call_errors(self) -> DataFrame:
        return self.tables["errors"].orderBy("path")

    # --- search ---

    def call_grep(self, pattern: str, limit: int = 1000, generated: str = "include") -> DataFrame:
        found = self.symbols(generated).where(selector.parse(pattern))
        return found.orderBy("file", "start_line", "name").limit(limit)

    def call_structural(self, pattern: str, where: dict[str, str] | None = None, rewrite: str | None = None) -> DataFrame:
        return structural.structural_grep(self.tables["sources"], pattern, where, rewrite)

    def call_query(self, query: str, limit: int = 1000) -> DataFrame:
        return structural.tree_query(self.tables["sources"], query).limit(limit)

    def call_refs(self, name: str, regex: bool = False, language: str = "", limit: int = 1000) -> DataFrame:
        r = self.tables["refs"].where(F.col("name").rlike(selector.java_pattern(name)) if regex else F.col("name") == name)
        if language:
            r = r.join(self.files().where(F.lower("language") == language.lower()).select(F.col("path").alias("file")), "file", "left_semi")
        return r.orderBy("file", "line", "col").limit(limit)

    def call_symbols(self, kind: str = "", name: str = "", file: str = "", limit: int = 100) -> DataFrame:
        s = self.symbols()
        for c, v in (("kind", kind), ("name", name), ("file", file)):
            s = s.where(F.lower(c).contains(v.lower())) if v else s
        return s.orderBy("file", "start_line").limit(limit)

    def call_imports(self, pattern: str = "", reverse: bool = False) -> DataFrame:
        i = self.tables["imports"]
        i = i.where(F.col("import").rlike(selector.java_pattern(pattern))) if pattern else i
        return i.groupBy("file").agg(F.sort_array(F.collect_set("import")).alias("imports")) if reverse else i

    def call_context(self, concept: str, tokens: int = 800) -> DataFrame:
        """Bodies of symbols whose name has the concept in it, packed in order into a budget."""
        lower = concept.lower()
        found = self.symbols().where(F.lower("name").contains(lower) | F.lower(F.regexp_extract("file", r"([^/]*)$", 1)).contains(lower))
        met = found.join(self.tables["sources"].select(F.col("path").alias("file"), "content"), "file").withColumn("body", text.body("content", "start_line", "end_line")).drop("content")
        cost = met.withColumn("tokens", text.token_estimate("body") + 4).withColumn("_all", F.lit(1))
        return metrics.packed(cost, ["_all"], ["file", "start_line", "name"], "tokens", tokens).drop("_all")

    def call_symbol_at(self, file: str, line: int) -> DataFrame:
        """The innermost definition that holds a line."""
        return self.symbols().where(F.col("file") == file).where("start_line <= %d AND end_line >= %d" % (line, line)).orderBy(F.expr("end_line - start_line"), F.desc("start_line")).limit(1)

    def call_scope(self, file: str, line: int) -> DataFrame:
        """name, kind, decl_line of what is visible at a line: imports, symbols of the package, enclosing definitions."""
        here = text.dirname(F.lit(file))
        own = self.symbols().where((text.dirname("file") == here) & (text.is_test_file("file") == text.is_test_file(F.lit(file))))
        package = own.where((F.col("file") != file) | (F.col("start_line") <= line)).select("name", "kind", F.col("start_line").alias("decl_line"), F.lit(1).alias("_o"))
        imports = self.tables["imports"].where(F.col("file") == file).select(F.regexp_extract("import", r"([^/.:]+)$", 1).alias("name"), F.lit("import").alias("kind"), F.lit(1).alias("decl_line"), F.lit(0).alias("_o"))
        both = imports.unionByName(package)
        return both.groupBy("name").agg(F.max(F.struct("_o", "decl_line", "kind")).alias("r")).select("name", "r.kind", "r.decl_line")

    # --- graph ---

    def call_callgraph(self, name: str, depth: int = 2, reverse: bool = False, regex: bool = False, kind: str = "", file: str = "") -> DataFrame:
        steps = self._steps()
        return graph.walk_edges(steps, graph.distances(steps, self.find(name, regex, kind, file).select("id"), depth, reverse), depth, reverse)

    def call_dead(self, include_entry_points: bool = False, include_tests: bool = False) -> DataFrame:
        d = xref.dead(self.definitions(), self.edges(), () if include_entry_points else ("main", "init"))
        return d if include_tests else d.where(~text.is_test_file("file"))

    def call_impact(self, names: list[str], depth: int = 10) -> DataFrame:
        roots = self.definitions().where(F.col("name").isin(*names)).select("id")
        n = graph.distances(self._steps(), roots, depth, reverse=True).where("dist > 0")
        return n.join(self.definitions(), "id").withColumn("risk", F.lit(1.0) / (F.col("dist") + 1))

    def call_testmap(self, depth: int = 3) -> DataFrame:
        d = self.definitions()
        test = text.is_test_file("file")
        tests = d.where(test).select("id", F.col("id").alias("test"))
        best = graph.distances(self._steps(), tests, depth, keys=("test",)).where("dist > 0").groupBy("id").agg(F.min("dist").alias("distance"))
        state = F.when(F.col("distance") == 1, "tested").when(F.col("distance") > 1, "indirectly_tested").otherwise("untested")
        return d.where(~test).join(best, "id", "left").withColumn("coverage", state)

    def call_fanin(self, least: int = 1, top: int = 20) -> DataFrame:
        f = xref.fan(self.edges()).where(F.col("fan_in") >= least)
        return metrics.top(f.join(self.definitions(), "id"), [F.desc("fan_in"), F.asc("file"), F.asc("start_line")], top)

    def call_unresolved(self, reason: str = "", limit: int = 50) -> DataFrame:
        u = xref.unresolved(*self._located())
        return (u.where(F.col("reason").contains(reason)) if reason else u).orderBy("file", "line", "col").limit(limit)

    def package_edges(self) -> DataFrame:
        d = self.definitions().select("id", "package")
        e = self._steps()
        return e.join(d.select(F.col("id").alias("src"), F.col("package").alias("_a")), "src").join(d.select(F.col("id").alias("dst"), F.col("package").alias("_b")), "dst").groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("count").alias("count"))

    def import_edges(self) -> DataFrame:
        paths = self.tables["imports"].select(text.dirname("file").alias("src"), F.explode(xref.import_paths(F.col("import"))).alias("_p"))
        return paths.select("src", F.coalesce(xref.local_package("_p", self.module), "_p").alias("dst"), xref.local_package("_p", self.module).isNotNull().alias("internal")).distinct()

    def call_deps(self, focus: str = "", depth: int = 1, reverse: bool = False) -> DataFrame:
        e = self.import_edges()
        if not focus:
            return e
        roots = self.spark.createDataFrame([(focus,)], "id STRING")
        return graph.walk_edges(e, graph.distances(e, roots, depth, reverse), depth, reverse)

    def call_cycles(self, longest: int = 6) -> DataFrame:
        return graph.cycles(self.import_edges().where("internal"), longest)

    def call_bridge(self, top: int = 20, focus: str = "", depth: int = 1, reverse: bool = False) -> DataFrame:
        e = self.import_edges().where("internal")
        if focus:
            between = e.select(text.component("src").alias("src"), text.component("dst").alias("dst")).where("src <> dst").distinct()
            near = graph.distances(between, self.spark.createDataFrame([(focus,)], "id STRING"), depth, reverse).select(F.col("id").alias("_c"))
            e = e.join(near, text.component("dst" if reverse else "src") == F.col("_c"), "left_semi")
        return metrics.bridges(e.select(text.component("src").alias("from_component"), text.component("dst").alias("to_component"), F.concat_ws(" -> ", "src", "dst").alias("sample")), top)

    def call_drift(self, base: Engine) -> DataFrame:
        mine, theirs = self.import_edges().where("internal"), base.import_edges().where("internal")
        return diff.set_diff(theirs, mine, ["src", "dst"])

    # --- analysis ---

    def functions(self) -> DataFrame:
        f = self.tables.get("functions")
        if f is not None:
            return f
        s = self.symbols().where(F.col("kind").isin(*xref.CALLABLE))
        ident = F.concat_ws("\x00", "file", "kind", "name", F.col("start_line").cast("string"))
        keep = [c for c in ("cyclomatic", "cognitive", "max_nesting", "returns") if c in s.columns]
        base = s.select(ident.alias("id"), "file", text.dirname("file").alias("package"), "name", "kind", "signature", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), text.parameter_count("signature").alias("parameters"), *keep)
        return base.join(xref.fan(self.edges()), "id", "left").na.fill(0, ["fan_in", "fan_out"])

    def call_complexity(self, least: int = 0, sort: str = "cyclomatic", top: int = 100) -> DataFrame:
        return metrics.top(self.functions().where(F.col("cyclomatic") >= least), [F.desc(sort), F.asc("file"), F.asc("start_line")], top)

    def call_coupling(self) -> DataFrame:
        s = self.symbols().select(text.dirname("file").alias("package"), "kind")
        return metrics.coupling(s.select("package"), self.package_edges(), s)

    def call_cohesion(self) -> DataFrame:
        d = self.definitions().select("id", "package")
        e = self._steps().join(d.select(F.col("id").alias("src"), F.col("package").alias("_a")), "src").join(d.select(F.col("id").alias("dst"), F.col("package").alias("_b")), "dst").where("_a = _b")
        return graph.components(e, d.select("id")).join(d, "id").groupBy("package").agg(F.countDistinct("component").alias("lcom"))

    def call_types(self) -> DataFrame:
        """Types with their fields, interface width and nesting where the texts are at hand, and their method sets."""
        methods = self.symbols().where("kind = 'method_definition'").select("receiver")
        if "sources" in self.tables:
            shapes = scopes.type_shapes(self.tables["sources"]).withColumnRenamed("path", "file")
            return metrics.type_methods(shapes, methods)
        s = self.symbols()
        return metrics.type_methods(s.where(F.col("kind").contains("type_definition") | F.col("kind").contains("struct") | F.col("kind").contains("class")), methods)

    def call_hotspot(self, top: int = 20) -> DataFrame:
        return metrics.top(metrics.hotspots(self.functions(), self.tables["churn"]), [F.desc("score"), F.asc("file"), F.asc("start_line")], top)

    def call_risk(self, least: float = 0.0, top: int = 20) -> DataFrame:
        tested = self.call_testmap().where("coverage = 'tested'").select("id")
        return metrics.top(metrics.risks(self.functions(), self.tables["churn"], tested).where(F.col("risk") >= least), [F.desc("risk"), F.asc("file"), F.asc("start_line")], top)

    def call_smells(self, severity: str = "") -> DataFrame:
        """subject, smell, severity: of functions, packages, types and the calls between them, errors first."""
        at = F.concat_ws(":", "file", "name", F.col("start_line").cast("string")).alias("subject")
        parts = [rules.function_smells(self.functions(), ["file", "name", "start_line"]).select(at, "smell", "severity")]
        coupling = self.call_coupling()
        sizes = self.symbols().groupBy(text.dirname("file").alias("package")).agg(F.count("*").alias("symbols"))
        packages = coupling.join(sizes, "package", "left").join(self.call_cohesion(), "package", "left").na.fill(0)
        parts.append(rules.package_smells(packages).select(F.col("package").alias("subject"), "smell", "severity"))
        if "sources" in self.tables:
            parts.append(rules.type_smells(self.call_types()).select(F.concat_ws(":", "file", "name").alias("subject"), "smell", "severity"))
        warn = lambda df, subject, smell: df.select(subject.alias("subject"), F.lit(smell).alias("smell"), F.lit("warning").alias("severity"))
        d = self.definitions().select("id", "package", "file", "name")
        calls = self.edges().join(d.select(F.col("id").alias("caller_id"), "package", "file", "name"), "caller_id").join(d.select(F.col("id").alias("callee_id"), F.col("package").alias("callee_package")), "callee_id")
        envy = rules.feature_envy(calls.select(F.concat_ws(":", "file", "name").alias("caller_id"), "package", "callee_package", "count"))
        parts.append(warn(envy, F.concat_ws(" -> ", "caller_id", "target"), "feature_envy"))
        parts.append(warn(rules.unstable_dependencies(self.package_edges(), coupling), F.concat_ws(" -> ", "src", "dst"), "unstable_dep"))
        if "signature" in self.functions().columns:
            parts.append(warn(rules.data_clumps(self.functions()), F.col("params"), "data_clump"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.where(F.col("severity") == severity) if severity else out
        return out.orderBy(F.col("severity") != "error", "subject", "smell")

    def call_lint(self, limits: dict[str, int] | None = None, text_rules: tuple[str, ...] = ()) -> DataFrame:
        """file, name, start_line, rule, value: threshold rules and `no ...` sentences; suppressed lines are left out."""
        f = self.functions()
        out = rules.violations(f, limits or rules.THRESHOLDS, ["file", "name", "start_line"]).select("file", "name", "start_line", F.concat(F.lit("complexity/"), "metric").alias("rule"), "value")
        for t in text_rules:
            kind, x = rules.parse_text_rule(t)
            if kind == "lines":
                out = out.unionByName(f.where(F.col("lines") > x).select("file", "name", "start_line", F.lit(t).alias("rule"), F.col("lines").cast("bigint").alias("value")))
            else:
                hit = self.tables["imports"].where(F.col("import") == x)
                out = out.unionByName(hit.select("file", F.col("import").alias("name"), F.lit(1).alias("start_line"), F.lit(t).alias("rule"), F.lit(1).cast("bigint").alias("value")))
        if "sources" not in self.tables:
            return out
        off = rules.suppressions(self.tables["sources"], "path", "content").withColumnRenamed("path", "file")
        return rules.unsuppressed(out.withColumn("line", F.col("start_line")), off, "file").drop("line")

    def call_boundaries(self, config: str) -> DataFrame:
        return rules.boundary_violations(self.import_edges().where("internal"), rules.parse_boundaries(config))

    def call_capa(self, category: str = "", min_confidence: str = "low") -> DataFrame:
        return rules.capabilities(self.tables["refs"].where("kind = 'reference.call'"), ["file"], least=min_confidence, category=category)

    def call_reachability(self, package: str, category: str = "", apis: list[str] | None = None, depth: int = 10) -> DataFrame:
        """Call paths from a package to definitions that carry the name of a call of some capability."""
        apis = apis or sorted({a for r in fixed.SUPPLY_CHAIN if category in ("", r[2]) for a in r[5].split()})
        d = self.definitions()
        roots = d.where((F.col("package") == package) | F.col("file").startswith(package)).select("id")
        return graph.reach_paths(self._steps(), roots, d.where(F.col("name").isin(*apis)).select("id"), depth)

    def call_similarity(self, threshold: float = 0.7) -> DataFrame:
        b = self.symbols().where(F.col("kind").isin(*xref.CALLABLE)).join(self.tables["sources"].select(F.col("path").alias("file"), "content"), "file")
        ident = F.concat_ws("\x00", "file", "name", F.col("start_line").cast("string"))
        return similarity.similar(b.select(ident.alias("id"), text.body("content", "start_line", "end_line").alias("body")), "id", "body", threshold)

    def call_licenses(self) -> DataFrame:
        return rules.pattern_lines(self.tables["sources"], "path", "content", rules.LICENCES)

    def call_packages(self) -> DataFrame:
        """package, files: the files of each directory."""
        return self.files().groupBy(text.dirname("path").alias("package")).agg(F.sort_array(F.collect_list("path")).alias("files"))

    def call_services(self, modules: DataFrame) -> DataFrame:
        """repo, target, files: imports of other repositories of a federated index. modules: repo, module."""
        i = self.tables["imports"].select(F.split_part("file", F.lit(":"), F.lit(1)).alias("repo"), "file", "import")
        parts = F.split("import", "/")
        prefixes = i.withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
        met = prefixes.join(modules.select(F.col("repo").alias("target"), "module"), "module").where("repo <> target")
        return met.groupBy("repo", "target").agg(F.countDistinct("file").alias("files"))

    def call_secrets(self) -> DataFrame:
        return rules.pattern_lines(self.tables["sources"], "path", "content", rules.SECRETS)

    def call_check(self, limits: dict[str, int] | None = None) -> DataFrame:
        return rules.gate(self.functions(), limits or rules.GATE)

    def call_report(self, owners: list[tuple[str, str]] | None = None) -> DataFrame:
        who: Column = globs.owner("file", owners or [])
        f = self.functions().groupBy(who.alias("team")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("functions"), F.max("cyclomatic").alias("max_cyclomatic"))
        dead = self.call_dead().groupBy(who.alias("team")).agg(F.count("*").alias("dead"))
        return f.join(dead, "team", "left").na.fill(0, ["dead"])

    def call_review(self, changed: list[str], depth: int = 5) -> DataFrame:
        """Functions of changed files with how many others they reach backwards."""
        f = self.functions().where(F.col("file").isin(*changed))
        reach = graph.distances(self._steps(), f.select("id", F.col("id").alias("root")), depth, reverse=True, keys=("root",)).where("dist > 0").groupBy(F.col("root").alias("id")).agg(F.count("*").alias("blast_radius"))
        return f.join(reach, "id", "left").na.fill(0, ["blast_radius"])

    def call_guardrails(self, file: str) -> DataFrame:
        f = self.functions().where(F.col("file") == file)
        return f.groupBy("file").agg(F.max("cyclomatic").alias("max_cyclomatic"), F.max("fan_in").alias("max_fan_in"), (F.max("cyclomatic") >= 15).alias("hotspot"), (F.max("fan_in") >= 10).alias("widely_used"))

    # --- transformation ---

    def call_chunk(self, tokens: int = 800) -> DataFrame:
        return chunks.line_chunks(self.tables["sources"], "path", "content", tokens)

    def call_refactor(self, pattern: str, new_name: str, callsites: bool = False) -> DataFrame:
        """Edits (file, line, kind, old, new) of a rename; nothing is written."""
        if not new_name.isidentifier():
            raise ValueError(f"not a name: {new_name!r}")
        found = self.symbols().where(selector.parse(pattern))
        edits = found.select("file", F.col("start_line").alias("line"), F.lit("declaration").alias("edit"), F.col("name").alias("old"))
        if callsites:
            uses = self.tables["refs"].join(found.select("name").distinct(), "name", "left_semi")
            edits = edits.unionByName(uses.select("file", "line", F.lit("reference").alias("edit"), F.col("name").alias("old")))
        return edits.distinct().withColumn("new", F.lit(new_name))

    def names(self) -> list[str]:
        return sorted(n[5:] for n in dir(self) if n.startswith("call_"))

    def call(self, analysis: str, /, **arguments) -> DataFrame:
        if analysis not in self.names():
            raise KeyError(f"no analysis {analysis!r}; there are {', '.join(self.names())}")
        return getattr(self, f"call_{analysis}")(**arguments)
