"""Best representative of each duplicate group.

Two ways to a surviving record. :func:`best_members` ranks whole members and fills each optional field from the
best member that has it. :func:`truth_model` infers from all members which of several conflicting values are true.
:func:`surviving_records` joins both: what the order chooses, with its posterior, and every other value judged true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.runtime import cut, release

OPTIONAL_FIELDS = ("author", "git_commit", "impact", "errors_faced", "next_steps")
#: What stands for "nothing recorded" once case, blanks and outer punctuation are gone.
STAND_INS = (
    "desconocida", "desconocido", "empty", "entfällt", "k.a", "keine", "keine angabe", "n.a", "n/a", "na", "nada", "nichts", "nil", "ninguna",
    "ninguno", "no data", "none", "not applicable", "not available", "not recorded", "nothing", "nothing recorded", "null", "sin datos", "tba",
    "tbc", "tbd", "to be decided", "to be determined", "unbekannt", "undefined", "unknown",
)


def topic_form(c: Column) -> Column:
    """Lower case, each run of blanks, ``_`` and ``-`` one ``-``, none at the ends or beside ``/``; null stays null."""
    joined = F.regexp_replace(F.lower(c), r"[\s\u00a0\u2000-\u200a_-]+", "-")
    return F.regexp_replace(F.regexp_replace(joined, "-?/-?", "/"), "^-|-$", "")


def is_filled(c: Column) -> Column:
    """False for null, blank, punctuation only, and stand-ins for "nothing recorded"."""
    bare = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return c.isNotNull() & (bare != "") & ~bare.isin(*STAND_INS)


def live_groups(memories: DataFrame) -> DataFrame:
    """Live memories with a topic, keyed by (project_id, topic_key in normal form)."""
    live = memories.where(F.col("deleted_at").isNull()).withColumn("topic_key", topic_form(F.col("topic_key")))
    return live.where(F.col("topic_key") != "")


def best_members(memories: DataFrame, fields: tuple[str, ...] = OPTIONAL_FIELDS) -> DataFrame:
    """(project_id, topic_key, field_name, memory_id): the first member, and for each field the first that has it filled.

    Groups are two or more live memories of a project and topic. Members rank by revision_count descending, last_seen_at
    descending, nulls last in both, then id ascending, so repeated rows and ties have one outcome. A field no
    member has filled gives no row; blank topics form no group, null projects one of their own. One aggregation
    with map-side combine keeps a single best candidate per group and field, whatever the size of a group.
    """
    rank = [
        F.col("revision_count").isNull().alias("a"), (-F.col("revision_count")).alias("b"),
        F.col("last_seen_at").isNull().alias("c"), (-F.unix_micros("last_seen_at")).alias("d"), F.col("id").alias("id"),
    ]
    place = F.struct(*rank)
    best = [F.min(place).alias("record"), *[F.min(F.when(is_filled(F.col(f)), place)).alias(f) for f in fields]]
    groups = live_groups(memories).groupBy("project_id", "topic_key").agg(F.count(F.lit(1)).alias("_members"), *best).where("_members > 1")
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["id"].alias("memory_id")) for f in ("record", *fields)])
    return groups.select("project_id", "topic_key", F.explode(rows).alias("r")).select("project_id", "topic_key", "r.*").where("memory_id IS NOT NULL")


def memory_claims(memories: DataFrame, fields: tuple[str, ...] = OPTIONAL_FIELDS[1:], source: str = "author") -> DataFrame:
    """(project_id, topic_key, field_name, source, value): what each source says of each group's fields; value null: nothing.

    Values compare without outer blanks; a source without name is ``(none)``.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(is_filled(F.col(f)), F.trim(F.col(f))).alias("value")) for f in fields])
    who = F.when(is_filled(F.col(source)), F.lower(F.trim(F.col(source)))).otherwise(F.lit("(none)"))
    return live_groups(memories).select("project_id", "topic_key", who.alias("source"), F.explode(cells).alias("c")).select("project_id", "topic_key", "c.*", "source")


#: Pseudo-counts (hits, misses) behind a source's sensitivity and specificity before it is heard.
SENSITIVITY_PRIOR, SPECIFICITY_PRIOR = (3.0, 2.0), (9.0, 1.0)


def truth_model(claims: DataFrame, rounds: int = 8, prior: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """Latent truth by expectation-maximisation over sources with their own sensitivity and specificity.

    ``claims``: (project_id, topic_key, field_name, source, value). A fact is one value of one field of one group.
    A source that speaks of a group asserts some facts of each field and thereby denies that field's others.
    M-step: sensitivity is the share of the true facts in its fields that a source asserts, specificity the share of the
    false ones it denies, each weighed by the facts' posteriors. E-step: the log-odds of a fact add what each source's
    assertion or denial is worth. Denials are summed once for each field and corrected at the asserted facts, so the work
    grows with the claims and not with facts times sources. A field may keep several values: every fact
    with a posterior of at least ``threshold`` is retained.

    Returns (project_id, topic_key, field_name, value, probability, retained, n_sources). Null values only deny; a field
    for which nobody claims anything has no row. Repeated claims count once; null projects form a project of their own.
    Empty claims give an empty result. Extra columns are not looked at.
    """
    names = ["project_id", "topic_key", "field_name"]
    cell = F.unhex(F.md5(F.concat_ws("\x02", *[F.coalesce(F.col(n), F.lit("\x03")) for n in names])))
    claims = cut(claims.select(*names, "source", "value").distinct().withColumn("cell", cell).withColumn("fact", F.unhex(F.md5(F.concat_ws("\x02", F.hex("cell"), "value")))), "claims")
    asserts = cut(claims.where("value IS NOT NULL").select("cell", "fact", "source"), "asserts")
    covers = cut(claims.select("cell", "source").distinct(), "covers")
    facts = cut(claims.where("value IS NOT NULL").groupBy("cell", "fact", *names, "value").agg(F.count(F.lit(1)).alias("n_sources")), "facts")
    speakers = covers.groupBy("cell").agg(F.count(F.lit(1)).alias("n_speakers"))
    release(claims)
    belief = cut(facts.join(speakers, "cell").select("cell", "fact", (F.col("n_sources") / F.col("n_speakers")).alias("p")), "belief")
    start = F.log(F.lit(prior / (1 - prior)))
    for _ in range(rounds):
        mass = belief.groupBy("cell").agg(F.sum("p").alias("true_mass"), F.sum(1 - F.col("p")).alias("false_mass"))
        reach = covers.join(mass, "cell").groupBy("source").agg(F.sum("true_mass").alias("t"), F.sum("false_mass").alias("f"))
        said = asserts.join(belief, ["cell", "fact"]).groupBy("source").agg(F.sum("p").alias("tp"), F.sum(1 - F.col("p")).alias("fp"))
        (a, b), (c, e) = SENSITIVITY_PRIOR, SPECIFICITY_PRIOR
        tp, fp = F.coalesce("tp", F.lit(0.0)), F.coalesce("fp", F.lit(0.0))
        sens, spec = (tp + a) / (F.col("t") + a + b), (F.col("f") - fp + c) / (F.col("f") + c + e)
        denial = F.log((1 - sens) / spec)
        worth = cut(reach.join(said, "source", "left").select("source", denial.alias("denial"), (F.log(sens / (1 - spec)) - denial).alias("gain")), "worth")
        base = covers.join(worth, "source").groupBy("cell").agg(F.sum("denial").alias("base"))
        gain = asserts.join(worth, "source").groupBy("cell", "fact").agg(F.sum("gain").alias("gain"))
        newer = cut(gain.join(base, "cell").select("cell", "fact", (1 / (1 + F.exp(-(start + F.col("base") + F.col("gain"))))).alias("p")), "belief")
        release(belief, worth)
        belief = newer
    out = facts.join(belief, ["cell", "fact"])
    return out.select(*names, "value", F.round("p", 6).alias("probability"), (F.col("p") >= threshold).alias("retained"), "n_sources")


def surviving_records(memories: DataFrame, fields: tuple[str, ...] = OPTIONAL_FIELDS[1:], **model: float) -> DataFrame:
    """(project_id, topic_key, field_name, value, memory_id, chosen, probability, retained, n_sources): the values of each surviving record.

    A row is chosen if the order of :func:`best_members` takes it, then with the member it comes from, and retained if
    :func:`truth_model` judges it true; values that are neither have no row. Values compare without outer blanks. Ties, nulls, repeated
    rows and empty tables are as there. One row a value, so a field may keep any number of them.
    """
    names = ["project_id", "topic_key", "field_name"]
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.when(is_filled(F.col(f)), F.trim(F.col(f))).alias("value")) for f in fields])
    said = live_groups(memories).select(F.col("id").alias("memory_id"), F.explode(cells).alias("c")).select("memory_id", "c.*").where("value IS NOT NULL")
    best = best_members(memories, fields).where("field_name <> 'record'").join(said.dropDuplicates(["memory_id", "field_name"]), ["memory_id", "field_name"])
    key = F.md5(F.concat_ws("\x02", *[F.coalesce(n, F.lit("\x03")) for n in [*names, "value"]]))
    chosen = best.select(key.alias("k"), *names, "value", "memory_id")
    judged = truth_model(memory_claims(memories, fields), **model).withColumn("k", key)
    grouped = best.select("project_id", "topic_key").distinct().select(F.md5(F.concat_ws("\x02", F.coalesce("project_id", F.lit("\x03")), "topic_key")).alias("g"))
    judged = judged.withColumn("g", F.md5(F.concat_ws("\x02", F.coalesce("project_id", F.lit("\x03")), "topic_key"))).join(grouped, "g", "left_semi")
    both = chosen.select("k", F.struct(*names, "value").alias("a"), "memory_id").join(judged.select("k", F.struct(*names, "value").alias("b"), "probability", "retained", "n_sources"), "k", "full_outer")
    row = F.coalesce("a", "b")
    out = both.select(*[row[c].alias(c) for c in [*names, "value"]], "memory_id", F.col("memory_id").isNotNull().alias("chosen"), "probability", F.coalesce("retained", F.lit(False)).alias("retained"), "n_sources")
    return out.where("chosen OR retained")
