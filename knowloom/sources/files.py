"""Scanning a project's file tree: which files take part, and their content."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions.code import LANGUAGES, base_name, extension

#: Fixed values.
SKIPPED_FOLDERS = (".git", "node_modules", "vendor", "dist", "build", "out", ".config", "__pycache__", ".venv", "venv", ".idea", ".vscode")
MANIFESTS = ("package.json", "go.mod", "requirements.txt", "Cargo.toml", "composer.json", "Gemfile")
IGNORE_FILES = (".memoryignore", ".gitignore")
#: What a new ignore file holds: what a build or an editor makes, and what must not be read for its secrets.
DEFAULT_IGNORES = {
    "made by tools": ("*.min.js", "*.map", "*.lock", "coverage/", "target/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".gradle/", ".terraform/", ".next/", "*.egg-info/"),
    "left by editors": ("*.swp", "*~", ".project", ".settings/"),
    "keys and passwords": (".env*", "*.key", "*.pem", "*.kdbx", "*.pfx", ".netrc", ".pgpass", "*_rsa", "*_ed25519", "**/secrets/", "**/credentials*"),
}


def glob_regex(part: str) -> str:
    """One path part of an ignore rule as a regular expression."""
    return "".join("[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch) for ch in part)


def rule_regex(rule: str) -> tuple[str, bool] | None:
    """(pattern over whole relative paths, whether a match is un-ignored), or None for comments and blanks.

    A rule matches a path itself and, since ignored folders are not entered, everything below it. A trailing slash
    restricts it to folders, a leading one to the root; ``**`` stands for any number of folders.
    """
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated or rule.startswith("\\!") else rule
    only_folder, rule = rule.endswith("/"), rule.rstrip("/")
    rooted, rule = rule.startswith("/"), rule.lstrip("/")
    out = "^" if rooted else "^(?:.*/)?"
    parts = rule.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        out += (".*" if last else "(?:[^/]+/)*") if part == "**" else glob_regex(part) + ("" if last else "/")
    return out + ("/.*$" if only_folder else "(?:/.*)?$"), negated


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule ignores a relative path, as one expression that is evaluated before any content is read."""
    out = F.lit(False)
    for rule in rules:
        r = rule_regex(rule)
        if r:
            out = F.when(path.rlike(r[0]), not r[1]).otherwise(out)
    return out


def is_ignored(path: str, rules: list[str]) -> bool:
    """The same on the driver."""
    out = False
    for rule in rules:
        r = rule_regex(rule)
        if r and re.search(r[0], path):
            out = not r[1]
    return out


def load_rules(root: str) -> list[str]:
    """The rules of a project's ignore files, the engine's own first, so that later ones win."""
    rules: list[str] = []
    for name in IGNORE_FILES:
        p = os.path.join(root, name)
        if os.path.isfile(p):
            with open(p, encoding="utf-8", errors="replace") as f:
                rules += f.read().splitlines()
    return rules


def ensure_ignore_file(root: str) -> bool:
    """Write the default ignore file unless there is one; whether it was written."""
    p = os.path.join(root, IGNORE_FILES[0])
    if os.path.exists(p):
        return False
    with open(p, "w", encoding="utf-8") as f:
        f.write("".join(f"# {why}\n" + "\n".join(rules) + "\n" for why, rules in DEFAULT_IGNORES.items()))
    return True


def takes_part(path: Column, rules: list[str]) -> Column:
    folders = "|".join(re.escape(x) for x in SKIPPED_FOLDERS)
    known = extension(path).isin(*LANGUAGES) | base_name(path).isin(*MANIFESTS)
    return known & ~path.rlike(f"(^|/)({folders})/") & ~ignored(path, rules)


def scan(spark: SparkSession, root: str, project_id: str, rules: list[str] | None = None, content: bool = True) -> DataFrame:
    """(project_id, path, mtime_ms, size[, content]) of the files that take part. Without ``content`` only the listing is read."""
    root = os.path.abspath(root) if "://" not in root else root.rstrip("/")
    rules = load_rules(root) if rules is None and "://" not in root else rules or []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root) + "/", "") if "://" not in root else F.regexp_replace("path", "^" + re.escape(root) + "/", "")
    out = files.withColumn("path", rel).where(takes_part(F.col("path"), rules))
    cols = [F.lit(project_id).alias("project_id"), "path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size")]
    return out.select(*cols, *([F.expr("decode(content, 'UTF-8')").alias("content")] if content else []))


def file_nodes(files: DataFrame) -> DataFrame:
    """Graph nodes of files with language, lines, entry point and exports in their metadata."""
    from knowloom.functions import code

    lines = F.size(F.split("content", "\n"))
    exports = F.when(extension(F.col("path")).isin(".js", ".jsx", ".ts", ".tsx", ".astro"), F.size(F.regexp_extract_all("content", F.lit(r"(export\s+(?:default\s+)?(?:function|class|const|let|var)\s+\w+|module\.exports\s*=|exports\.\w+)")))).otherwise(0)
    meta = F.to_json(F.struct(code.language(F.col("path")).alias("language"), lines.alias("loc"), code.is_entry_point(F.col("path")).alias("entry_point"), exports.alias("exports_count")))
    kind = F.when(extension(F.col("path")) == ".md", "document").when(extension(F.col("path")) == ".sql", "sql").otherwise("file")
    return files.select("project_id", F.col("path").alias("id"), kind.alias("node_type"), base_name(F.col("path")).alias("label"), "path", meta.alias("metadata"))


def symbol_nodes(found: DataFrame) -> DataFrame:
    """Graph nodes of extracted symbols; of equal names in a file the last one counts. Names come out redacted."""
    from knowloom.functions import code
    from knowloom.functions.text import redact

    structural = F.col("type").isin("section", "code_block", "diagram")
    rows = found.where("kind = 'symbol'").where(structural | code.is_symbol_name(F.col("name"))).withColumn("name", redact(F.col("name")))
    node = F.concat("path", F.lit(":"), F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.concat(F.lit("L"), F.col("line").cast("string"))))
    meta = F.to_json(F.struct("line", "exported", F.col("meta").alias("detail")))
    last = rows.groupBy("project_id", node.alias("id"), "path").agg(F.max_by(F.struct(F.col("type").alias("node_type"), F.col("name").alias("label"), meta.alias("metadata")), "line").alias("n"))
    return last.select("project_id", "id", "n.node_type", "n.label", "path", "n.metadata")


def mirror_slugs(spark: SparkSession, root: str) -> DataFrame:
    """(slug): the active change documents in a project's ``changes`` folder, by name; archived ones lie below it. Without the folder none."""
    folder = f"{root.rstrip('/')}/changes"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "slug string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug")).orderBy("slug")


#: Seconds for which a working copy's metadata are taken as they were.
GIT_SECONDS = 30.0
_git_known: dict[str, tuple[float, dict[str, str]]] = {}


def cached_git_metadata(root: str) -> dict[str, str]:
    """:func:`git_metadata`, asked at most once in GIT_SECONDS for each working copy."""
    now = time.monotonic()
    held = _git_known.get(root)
    if held is None or now - held[0] >= GIT_SECONDS:
        held = _git_known[root] = (now, git_metadata(root))
    return held[1]


def git_metadata(root: str) -> dict[str, str]:
    """Branch, commit and author of a working copy, empty where git does not know; for the driver, as literals of a plan."""
    import subprocess

    def ask(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return ""

    return {"git_branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "git_commit": ask("rev-parse", "--short", "HEAD"), "author": ask("config", "user.name")}

