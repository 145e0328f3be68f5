"""What a file's name and an import's name say about code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and language.
LANGUAGES = {
    ".astro": "astro", ".css": "css", ".go": "go", ".html": "html", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".lua": "lua",
    ".md": "markdown", ".php": "php", ".py": "python", ".rb": "ruby", ".rs": "rust", ".sh": "bash", ".sql": "sql", ".svelte": "svelte",
    ".ts": "typescript", ".tsx": "typescript", ".vue": "vue",
}
#: Languages that call one another.
GROUPS = {
    ".astro": "js", ".css": "css", ".go": "go", ".java": "java", ".js": "js", ".jsx": "js", ".lua": "lua", ".php": "php", ".py": "python",
    ".rb": "ruby", ".rs": "rust", ".sh": "bash", ".svelte": "js", ".ts": "js", ".tsx": "js", ".vue": "js",
}
#: Names of files that start a program.
ENTRY_POINTS = (
    "__main__.py app.js app.py app.ts cli.js cli.py cli.ts index.go index.htm index.html index.js index.jsx index.php index.ts index.tsx main.go main.js "
    "main.py main.ts server.js server.ts"
).split()
#: Top-level names of the standard libraries.
STDLIB = {
    "go": (
        "archive arena bufio bytes cmp compress container context crypto database debug embed encoding errors expvar flag fmt go hash html image index io iter log "
        "maps math mime net os path plugin reflect regexp runtime slices sort strconv strings structs sync syscall testing text time unicode unique unsafe"
    ).split(),
    "python": (
        "__future__ abc argparse array ast asyncio base64 binascii bisect builtins calendar collections configparser contextlib copy csv ctypes dataclasses datetime "
        "decimal difflib dis email enum errno functools gc getpass glob gzip hashlib heapq hmac html http importlib inspect io itertools json logging lzma math "
        "multiprocessing operator os pathlib pickle platform pprint profile pstats queue random re readline reprlib resource runpy selectors shlex shutil signal "
        "site smtplib socket socketserver sqlite3 ssl stat statistics string struct subprocess symtable sys tabnanny tarfile tempfile textwrap threading time "
        "timeit tkinter tokenize tomllib trace traceback tracemalloc turtle types typing unicodedata unittest urllib uuid venv warnings wave weakref winreg "
        "winsound xml xmlrpc zipfile zipimport zoneinfo"
    ).split(),
    "node": (
        "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module "
        "net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi "
        "worker_threads zlib"
    ).split(),
}
_STDLIB_OF = {".go": "go", ".py": "python", ".js": "node", ".ts": "node", ".jsx": "node", ".tsx": "node"}


def extension(path: Column) -> Column:
    """The lower-case extension of the last path part with its dot, empty if it has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def language(path: Column) -> Column:
    return F.coalesce(_looked_up(LANGUAGES, extension(path)), F.lit(""))


def language_group(path: Column) -> Column:
    return F.coalesce(_looked_up(GROUPS, extension(path)), F.lit(""))


def is_entry_point(path: Column) -> Column:
    return base_name(path).isin(*ENTRY_POINTS)


def is_stdlib(imported: Column, ext: Column) -> Column:
    """Whether an import names the standard library of the importing file's language; submodules count as their top module."""
    top = F.when(ext == ".py", F.regexp_extract(imported, r"^([^.]+|\.)", 1)).otherwise(F.regexp_extract(imported, r"^([^/]+|/)", 1))
    out = F.lit(False)
    for e, lang in _STDLIB_OF.items():
        out = F.when(ext == e, top.isin(*STDLIB[lang])).otherwise(out)
    return out


def is_external(imported: Column) -> Column:
    """Whether an import can name a package: not relative, not rooted, not blank, without white space."""
    return ~imported.rlike(r"^[./]") & ~imported.rlike(r"[ \t\n\r]") & (F.trim(imported) != "")


def is_symbol_name(name: Column) -> Column:
    """Whether an extracted name can be a symbol: no brackets, blanks or operators, and at least one word character."""
    return F.coalesce(~name.rlike(r"[{}()\[\] \t\n\r=+*/%<>&|!^~]") & name.rlike("[A-Za-z0-9_]"), F.lit(False))


def parent_prefix(rel_path: Column) -> Column:
    """``../`` for each folder above a file, to link from it to the root."""
    return F.repeat(F.lit("../"), F.size(F.split(rel_path, "/")) - 1)


def first_line(content: Column, matched: Column) -> Column:
    """The 1-based number of the first line that holds the trimmed text, cut to 80 characters; 0 if none does."""
    wanted = F.substring(F.trim(matched), 1, 80)
    return F.array_position(F.transform(F.split(content, "\n"), lambda line: line.contains(wanted)), True).cast("int")
