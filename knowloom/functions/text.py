"""Text functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Secrets and what replaces them, in the order in which they apply.
SECRETS = (
    (r"(?i)sk-[a-zA-Z0-9_-]{40,}", "[REDACTED_SECRET]"),
    (r"(?i)sk-ant-[a-zA-Z0-9_-]{30,}", "[REDACTED_SECRET]"),
    (r"AIzaSy[a-zA-Z0-9_-]{33}", "[REDACTED_SECRET]"),
    (r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", "[REDACTED_SECRET]"),
    (r"(?s)-----BEGIN [A-Z ]+ PRIVATE KEY-----.*?-----END [A-Z ]+ PRIVATE KEY-----", "[REDACTED_SECRET]"),
    (r"(?i)(postgres|mysql|mongodb|redis|amqp|amqps|sqlite|mssql)://([^:]+):([^@]+)@", "$1://$2:[REDACTED_SECRET]@"),
    (r"""(?i)(password|passwd|secret|token|api_key|apikey|private_key)(\s*[:=]\s*)(['"])([a-zA-Z0-9_-]{12,})(['"])""", "$1$2$3[REDACTED_SECRET]$5"),
    (r"(?i)(password|passwd|secret|token|api_key|apikey|private_key)(\s*[:=]\s*)([a-zA-Z0-9_-]{12,})", "$1$2[REDACTED_SECRET]"),
)

#: Words that do not count in titles.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is it be are was were been being have has had do does did will would could should "
    "may might not no nor this that these those i me my we our you your he she his her they them their use using used set via per all each every "
    "some any both its if then else than so"
).split()

#: Normative words; a negated one hides its plain form.
RFC2119 = ("MUST", "SHALL", "SHOULD", "MAY")

#: Fixed value: white space as a character class, beyond ASCII as well.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_TOKEN_BREAK = r"[^\p{L}\p{Nd}_-]+"


def redact(c: Column) -> Column:
    """Replaces API keys, tokens, private keys, passwords of connection strings and assigned secrets. Null stays null."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), SECRETS, c)


def trim_space(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def raw_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits, ``-`` and ``_``, in order, with repeats."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), _TOKEN_BREAK), lambda t: t != "")


def title_tokens(c: Column) -> Column:
    """The tokens of a title without stop words and one-byte tokens; an empty array for null."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(raw_tokens(c), lambda t: (F.octet_length(t) > 1) & ~F.array_contains(stop, t))


def cut_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most ``most`` bytes."""
    prefixes = F.transform(F.sequence(F.lit(most), F.lit(most // 4), F.lit(-1)), lambda n: F.substring(c, F.lit(1), n))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.element_at(F.filter(prefixes, lambda s: F.octet_length(s) <= most), 1))


def topic_key(category: Column, what: Column) -> Column:
    """``category/title-in-kebab-case``, at most 80 bytes."""
    kebab = F.regexp_replace(F.regexp_replace(F.lower(what), "[ _-]", "-"), r"[^\p{L}\p{Nd}-]", "")
    key = F.regexp_replace(F.concat(category, F.lit("/"), kebab), "-{2,}", "-")
    return F.regexp_replace(cut_bytes(F.regexp_replace(key, "^-+|-+$", ""), 80), "-+$", "")


def truncate(c: Column, most: int) -> Column:
    """At most ``most`` characters, then a notice of how many were cut."""
    over = F.length(c) - most
    return F.when(over > 0, F.concat(F.substring(c, 1, most), F.lit("... [truncated "), over.cast("string"), F.lit(" chars]"))).otherwise(c)


def node_path(c: Column) -> Column:
    """A path as graph nodes have it: slashes, no leading ``./``, no trailing ``:line`` or ``:line:column``."""
    p = F.regexp_replace(F.replace(trim_space(c), F.lit("\\"), F.lit("/")), r"^\./", "")
    return trim_space(F.regexp_replace(p, r"^([^:]+):(?:[0-9]+:?[0-9]*|:[0-9]*)$", "$1"))


def short_label(c: Column, most: int = 64) -> Column:
    t = trim_space(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def clean_label(label: Column, is_file: Column, most: int = 50) -> Column:
    """A community's label: the first line of a node's label, at most ``most`` characters; a file's label keeps its lines."""
    cut = F.substring(trim_space(label), 1, most)
    return F.when(is_file, cut).otherwise(trim_space(F.substring_index(cut, "\n", 1)))


def cypher_string(c: Column) -> Column:
    """Escaped for a double-quoted Cypher string."""
    pairs = (("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def cypher_label(c: Column) -> Column:
    return F.upper(F.translate(c, "- /.", "____"))


def file_name(c: Column) -> Column:
    """Characters that file systems refuse become ``_``."""
    return F.translate(c, '/\\:*?"<>|', "_" * 9)


def mermaid(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit("\\"), F.lit("/")), F.lit('"'))


def table_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def wiki_label(c: Column) -> Column:
    """HTML entities for unsafe characters, and the pipe escaped."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;"), ("|", "\\|"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def keyword_score(goal_tokens: list[str], *texts: Column) -> Column:
    """How many of the goal's tokens, repeats counted, occur in the lower-cased texts joined by blanks."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))
    return sum((hay.contains(t).cast("int") for t in goal_tokens), F.lit(0))


def rfc2119(body: Column) -> Column:
    """The normative words of a text in canonical order, whole words only."""
    up = F.upper(F.coalesce(body, F.lit("")))
    has = lambda w: up.rlike(f"(^|[^A-Z]){w}($|[^A-Z])")
    return F.array_compact(F.array(*[F.when(has(f"{w} NOT"), F.lit(f"{w} NOT")).when(has(w), F.lit(w)) for w in RFC2119]))


def task_counts(tasks: Column) -> Column:
    """struct(total, done) of a Markdown check list."""
    lines = F.transform(F.split(F.coalesce(tasks, F.lit("")), "\n"), trim_space)
    done = F.size(F.filter(lines, lambda x: x.rlike(r"^[-*] \[[xX]\]")))
    open_ = F.size(F.filter(lines, lambda x: x.rlike(r"^[-*] \[ \]")))
    return F.struct((done + open_).alias("total"), done.alias("done"))


def task_summary(tasks: Column) -> Column:
    """``done/total (percent%)``, empty without tasks."""
    c = task_counts(tasks)
    percent = F.floor(100 * c["done"] / c["total"]).cast("int")
    return F.when(c["total"] > 0, F.format_string("%d/%d (%d%%)", c["done"], c["total"], percent)).otherwise("")


def fts_phrases(query: str) -> list[tuple[str, bool]]:
    """Search phrases of a query: blank-separated, quotes dropped; phrases of two or more characters match prefixes."""
    cleaned = [t.replace('"', "") for t in query.split()]
    return [(t, len(t) >= 2) for t in cleaned if t]


def match_expression(query: str, mode: str = "all") -> str:
    """The query as a full-text match expression, empty when nothing is left of it."""
    return (" OR " if mode == "any" else " ").join(f'"{t}"' + ("*" if prefix else "") for t, prefix in fts_phrases(query))
