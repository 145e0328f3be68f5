"""SQL fragments shared by the checks of several operators."""

from __future__ import annotations

from knowloom.functions import code
from knowloom.functions.scalar import CATEGORY_WEIGHT, REVIEW_DAYS, REVIEW_DEFAULT
from knowloom.functions.text import RFC2119, SECRETS, SPACE, STOP_WORDS

#: The moment that stands for now in registered queries.
AS_OF = "2026-01-01 00:00:00"
AS_OF_SQL = f"TIMESTAMPTZ '{AS_OF}+00'"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values: list[str] | tuple[str, ...]) -> str:
    return ", ".join(quote(v) for v in values)


def redact(c: str) -> str:
    for pattern, to in SECRETS:
        for i in range(1, 6):
            to = to.replace(f"${i}", f"\\{i}")
        c = f"regexp_replace({c}, {quote(pattern)}, {quote(to)}, 'g')"
    return c


def raw_tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\p{{L}}\p{{Nd}}_-]+'), lambda x: x <> '')"


def title_tokens(c: str) -> str:
    return f"list_filter({raw_tokens(c)}, lambda x: strlen(x) > 1 AND x NOT IN ({names(STOP_WORDS)}))"


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / {union} END)"


def age_days(t: str) -> str:
    return f"CAST(trunc((epoch_us({AS_OF_SQL}) - epoch_us({t})) / 86400000000) AS BIGINT)"


def recency(t: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + 0.001::DOUBLE * coalesce(greatest(0::DOUBLE, (epoch_us({AS_OF_SQL}) - epoch_us({t})) / 86400000000), 0::DOUBLE)))"


def importance(pinned: str, category: str, revisions: str) -> str:
    tier = " ".join(f"WHEN {quote(k)} THEN {v}::DOUBLE" for k, v in CATEGORY_WEIGHT.items())
    return f"(1.0::DOUBLE + CAST(coalesce({pinned}, false) AS INT) * 0.25::DOUBLE + (CASE {category} {tier} ELSE 0.0::DOUBLE END) + least(coalesce({revisions}, 0), 10) * 0.01::DOUBLE)"


def review_days(category: str) -> str:
    return f"(CASE lower({category}) " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in REVIEW_DAYS.items()) + f" ELSE {REVIEW_DEFAULT} END)"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def node_path(c: str) -> str:
    return trim(rf"regexp_replace(regexp_replace(replace({trim(c)}, '\', '/'), '^\./', ''), '^([^:]+):(?:[0-9]+:?[0-9]*|:[0-9]*)$', '\1')")


def extension(c: str) -> str:
    return rf"lower(regexp_extract({c}, '(\.[^./]*)$', 1))"


def looked_up(values: dict[str, str], key: str) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items()) + " ELSE '' END)"


def language_group(c: str) -> str:
    return looked_up(code.GROUPS, extension(c))


def rfc2119(c: str) -> str:
    has = lambda w: f"regexp_matches(upper(coalesce({c}, '')), '(^|[^A-Z]){w}($|[^A-Z])')"
    each = ", ".join(f"CASE WHEN {has(w + ' NOT')} THEN '{w} NOT' WHEN {has(w)} THEN '{w}' END" for w in RFC2119)
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"
