"""Building a code graph: imports, links, calls and snapshots, resolved by joins over all files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knowloom.functions import code, scalar
from knowloom.functions.text import trim_space

#: What a relative import may leave out, in the order of preference.
SUFFIXES = ("", ".ts", ".js", ".tsx", ".jsx", ".astro", ".sh", ".lua", ".py", ".pyi", "/index.ts", "/index.js", "/index.tsx", "/index.jsx", "/index.py", "/__init__.py", "/__init__.pyi")
#: Share of changed files above which a graph is rebuilt.
CHURN = 0.30


def clean_path(p: Column) -> Column:
    """A path without ``.``, ``..`` and doubled slashes; what climbs above the root keeps its ``..``."""
    none = F.array().cast("array<string>")
    up = lambda acc: F.when((F.size(acc) == 0) | (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) == ".."), F.concat(acc, F.array(F.lit("..")))).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(p, "/"), none, step), "/")


def folder(p: Column) -> Column:
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def relative_target(source: Column, imported: Column) -> Column:
    """Where a relative import points: one leading dot is the importing file's folder, each further one a folder above."""
    dots = F.length(F.regexp_extract(imported, r"^(\.*)", 1))
    rest = F.regexp_replace(imported, r"^\.+", "")
    return clean_path(F.concat_ws("/", folder(source), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest))


def resolve_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, source_path, imported, target_id, kind): the node each import means.

    Candidates of a relative import are tried with every suffix; then the name itself, then the name below the root. The
    first that is a node wins, found by one join over all candidates. What is left is a package, unless it belongs to the standard library or cannot be a name.
    """
    c = F.col
    rows = imports.select("project_id", "source_path", "imported").distinct()
    base = relative_target(c("source_path"), c("imported"))
    relative = F.when(c("imported").startswith("."), F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(base, s))).otherwise(F.array().cast("array<string>"))
    rooted = F.when(c("imported").startswith("/"), F.array(F.substring(c("imported"), F.lit(2), F.length("imported")))).otherwise(F.array().cast("array<string>"))
    tried = rows.select("*", F.posexplode(F.concat(relative, F.array("imported"), rooted)).alias("pos", "id"))
    known = nodes.select("project_id", "id").distinct()
    best = tried.join(known, ["project_id", "id"]).groupBy("project_id", "source_path", "imported").agg(F.min_by("id", "pos").alias("target_id"))
    out = rows.join(best, ["project_id", "source_path", "imported"], "left")
    package = code.is_external(c("imported")) & ~code.is_stdlib(c("imported"), code.extension(c("source_path")))
    kind = F.when(c("target_id").isNotNull(), "file").when(package, "package")
    return out.withColumn("kind", kind).withColumn("target_id", F.when(c("kind") == "package", F.concat(F.lit("pkg:"), c("imported"))).otherwise(c("target_id"))).where("kind IS NOT NULL")


def resolve_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, source_path, target, node_id): Markdown links by relative path, the same with .md, from the root, then by file name whatever its case; the least id of several."""
    c = F.col
    rows = links.select("project_id", "source_path", "target").distinct().withColumn("t", trim_space(F.regexp_replace("target", "[#?].*$", "")))
    rows = rows.where((c("t") != "") & ~c("t").rlike("^(https?://|mailto:)"))
    no_ext = ~F.substring_index(c("t"), "/", -1).contains(".")
    relative, rooted = clean_path(F.concat_ws("/", folder(c("source_path")), "t")), clean_path(c("t"))
    md = lambda p: F.when(no_ext, F.concat(p, F.lit(".md")))
    tried = rows.select("project_id", "source_path", "target", "t", F.posexplode(F.array(relative, md(relative), rooted, md(rooted))).alias("pos", "id")).where("id IS NOT NULL")
    exact = tried.join(nodes.select("project_id", "id").distinct(), ["project_id", "id"]).groupBy("project_id", "source_path", "target").agg(F.min_by("id", "pos").alias("exact"))
    files = nodes.where("node_type IN ('file', 'document')").groupBy("project_id", F.lower(code.base_name(c("path"))).alias("name")).agg(F.min("id").alias("by_name"))
    name = F.lower(code.base_name(c("t")))
    names = rows.select("project_id", "source_path", "target", F.explode(F.array_compact(F.array(name, F.when(no_ext, F.concat(name, F.lit(".md")))))).alias("name"))
    loose = names.join(files, ["project_id", "name"]).groupBy("project_id", "source_path", "target").agg(F.min("by_name").alias("by_name"))
    out = rows.join(exact, ["project_id", "source_path", "target"], "left").join(loose, ["project_id", "source_path", "target"], "left")
    return out.select("project_id", "source_path", "target", F.coalesce("exact", "by_name").alias("node_id")).where("node_id IS NOT NULL")


def symbols(nodes: DataFrame) -> DataFrame:
    """(project_id, path, id, label, line, grp): functions and classes with the line they begin at, 0 if unknown."""
    rows = nodes.where("node_type IN ('function', 'class')")
    return rows.select("project_id", "path", "id", "label", F.coalesce(scalar.json_long(F.col("metadata"), "line"), F.lit(0)).alias("line"), code.language_group(F.col("path")).alias("grp"))


def symbol_spans(syms: DataFrame) -> DataFrame:
    """``syms`` with ``next``, the line at which the next symbol of the file begins, and ``last``, the line before it; null for a file's last symbol."""
    w = Window.partitionBy("project_id", "path").orderBy("line", "id")
    return syms.withColumn("next", F.lead("line").over(w)).withColumn("last", F.col("next") - 1)


def containing_symbol(refs: DataFrame, syms: DataFrame) -> DataFrame:
    """``refs`` (project_id, path, line, ...) with ``caller_id``: the last symbol that begins at or before the line, null before the first.

    An as-of join as one window over each file's symbols and references; of symbols on one line the greatest id counts.
    """
    keep = [c for c in refs.columns if c not in ("project_id", "path", "line")]
    marks = syms.select("project_id", "path", "line", F.col("id").alias("_sym"), F.lit(0).alias("_ref"), F.lit(None).cast(refs.select(F.struct(*keep)).schema[0].dataType).alias("_keep"))
    rows = refs.select("project_id", "path", F.col("line").cast("bigint").alias("line"), F.lit(None).cast("string").alias("_sym"), F.lit(1).alias("_ref"), F.struct(*keep).alias("_keep"))
    w = Window.partitionBy("project_id", "path").orderBy("line", "_ref", "_sym").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows).withColumn("caller_id", F.last("_sym", ignorenulls=True).over(w))
    return both.where("_ref = 1").select("project_id", "path", "line", "_keep.*", "caller_id")


def call_edges(refs: DataFrame, syms: DataFrame) -> DataFrame:
    """(project_id, source_id, target_id, source_location): calls whose callee is a symbol of the same file, or else the only one of that name in the language."""
    called = containing_symbol(refs, syms).where("caller_id IS NOT NULL").withColumn("grp", code.language_group(F.col("path")))
    here = syms.groupBy("project_id", "path", F.col("label").alias("callee")).agg(F.min("id").alias("same_file"))
    there = syms.where("grp <> ''").groupBy("project_id", "grp", F.col("label").alias("callee")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    both = called.join(here, ["project_id", "path", "callee"], "left").join(there, ["project_id", "grp", "callee"], "left")
    c = F.col
    # unique once the caller itself is left out
    other = F.when((c("n") == 1) & (c("lo") != c("caller_id")), c("lo")).when((c("n") == 2) & (c("lo") == c("caller_id")), c("hi")).when((c("n") == 2) & (c("hi") == c("caller_id")), c("lo"))
    out = both.withColumn("target_id", F.coalesce("same_file", other)).where("target_id IS NOT NULL")
    spot = F.concat(F.lit("L"), c("line").cast("string"), F.lit(":"), c("col").cast("string")) if "col" in refs.columns else F.concat(F.lit("L"), c("line").cast("string"))
    first = F.min(F.struct("line", spot.alias("at"))).alias("f")
    return out.groupBy("project_id", F.col("caller_id").alias("source_id"), "target_id").agg(first).select("project_id", "source_id", "target_id", F.col("f.at").alias("source_location"))


def heuristic_calls(files: DataFrame, syms: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Calls guessed from names in a symbol's body, for files (project_id, path, content) that ``covered`` does not name.

    A body runs to the line before the next symbol. Its words join the symbols of the same language by label; the first line of a word counts.
    """
    start = F.greatest(F.col("line"), F.lit(1))
    spans = symbol_spans(syms.where("grp <> ''")).select("project_id", "path", F.col("id").alias("source_id"), "grp", start.alias("first"), "next")
    todo = files if covered is None else files.join(covered.select("project_id", "path").distinct(), ["project_id", "path"], "left_anti")
    lines = todo.select("project_id", "path", F.split("content", "\n").alias("lines")).join(spans, ["project_id", "path"]).withColumn("last", F.when(F.col("next") > F.col("first"), F.col("next") - 1).otherwise(F.size("lines")))
    body = lines.where(F.col("first") <= F.size("lines")).select("project_id", "source_id", "grp", "first", F.posexplode(F.slice("lines", F.col("first").cast("int"), F.greatest(F.lit(0), F.least(F.col("last"), F.size("lines")) - F.col("first") + 1).cast("int"))).alias("k", "text"))
    words = body.select("project_id", "source_id", "grp", (F.col("first") + F.col("k")).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)")))).alias("label"))
    first = words.groupBy("project_id", "source_id", "grp", "label").agg(F.min("line").alias("line"))
    found = first.join(syms.select("project_id", "grp", "label", F.col("id").alias("target_id")), ["project_id", "grp", "label"]).where("source_id <> target_id")
    return found.select("project_id", "source_id", "target_id", F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location"))


def all_calls(parsed: DataFrame, guessed: DataFrame) -> DataFrame:
    """Call edges of both kinds with their confidence; each file contributes to one side only."""
    return parsed.withColumn("confidence", F.lit("EXTRACTED")).unionByName(guessed.withColumn("confidence", F.lit("INFERRED")))


def contained(nodes: DataFrame) -> DataFrame:
    """(project_id, source_id, target_id): documents and schemas with their sections and tables, by an equal join on the part before the colon."""
    parents = nodes.where("node_type IN ('document', 'sql')").select("project_id", F.col("id").alias("source_id"))
    children = nodes.where(F.col("id").contains(":")).select("project_id", F.col("path").alias("source_id"), F.col("id").alias("target_id"))
    return children.join(parents, ["project_id", "source_id"]).where(F.col("target_id").startswith(F.concat("source_id", F.lit(":"))))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, path, status) of files that are new, changed in time or size, or deleted; sides: (project_id, path, mtime_ms, size)."""
    tag = lambda df, k: df.select("project_id", "path", F.struct("mtime_ms", "size").alias(k))
    both = tag(old, "o").join(tag(new, "n"), ["project_id", "path"], "full_outer")
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(~F.equal_null("o", "n"), "changed")
    return both.select("project_id", "path", status.alias("status")).where("status IS NOT NULL")


def rebuilds(diff: DataFrame, old: DataFrame) -> DataFrame:
    """(project_id, needs_full): whether so many tracked files changed that a rebuild is cheaper, or none was tracked yet."""
    n = old.groupBy("project_id").agg(F.count(F.lit(1)).alias("tracked"))
    c = diff.groupBy("project_id").agg(F.count(F.lit(1)).alias("churn"))
    return n.join(c, "project_id", "full_outer").select("project_id", F.coalesce(F.coalesce("churn", F.lit(0)) / F.col("tracked") > CHURN, F.lit(True)).alias("needs_full"))


def keep_untouched(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and old ones with other keys: what an incremental sync keeps."""
    return fresh.unionByName(old.join(fresh.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def unique_validator(files: DataFrame) -> DataFrame:
    """(project_id, n, newest): what tells whether a cached graph is still good."""
    return files.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.max("mtime_ms").alias("newest"))


def snippet(files: DataFrame, nodes: DataFrame, most: int = 60) -> DataFrame:
    """(project_id, id, line, text): up to ``most`` lines of source from where each node begins, redacted, with a notice if more follow."""
    from knowloom.functions.text import redact

    at = nodes.select("project_id", "id", "path", F.greatest(F.coalesce(scalar.json_long(F.col("metadata"), "line"), F.lit(1)), F.lit(1)).cast("int").alias("line"))
    rows = at.join(files.select("project_id", "path", F.split("content", "\n").alias("lines")), ["project_id", "path"]).where(F.col("line") <= F.size("lines"))
    body = F.array_join(F.slice("lines", F.col("line"), F.lit(most)), "\n")
    more = F.when(F.size("lines") - F.col("line") + 1 > most, F.concat(F.lit("\n... [truncated, "), (F.size("lines") - F.col("line") + 1 - most).cast("string"), F.lit(" more lines]"))).otherwise("")
    return rows.select("project_id", "id", "line", F.concat(redact(body), more).alias("text"))
