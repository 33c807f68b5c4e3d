"""Rule-book data: migration, validation, import classes, merge, upserts, exports.

Tables of rules have the exported shape (``schemas.RULE``). Books are small, but nothing here
relies on it: all is joins, aggregates and projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan import schemas
from loomspan.functions.text import is_web_url

ID = "^risk_[a-z0-9][a-z0-9_-]{2,63}$"


def _either(*names: str) -> Column:
    return F.coalesce(*(F.col(n) for n in names))


def migrated(raw: DataFrame) -> DataFrame:
    """Rules of schema RULE from records of RULE_INPUT: snake or camel case, first or second version.

    Adds version_ok. Defaults: sentence scope, distance 48, revision 1, draft, provided.
    """
    group = lambda name, at: F.coalesce(F.filter(F.col("conditions.all_of"), lambda g: g["group_id"] == name)[0]["any_of"], F.col("conditions.all_of")[at]["any_of"])
    filled = lambda found, *other: F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(F.coalesce(*(F.col(o) for o in other), F.array().cast("array<string>")))
    version = F.coalesce(_either("schema_version", "schemaVersion"), F.lit(""))
    distance = F.coalesce(F.col("conditions.max_distance"), F.col("max_distance"), F.col("maxDistance"), F.lit(48.0))
    status = _either("review_status", "reviewStatus")
    source = F.struct(
        F.coalesce(F.col("source.title"), F.lit("")).alias("title"), F.coalesce(F.col("source.url"), F.lit("")).alias("url"), F.coalesce(F.col("source.date"), F.lit("")).alias("date"),
        F.coalesce(F.col("source.source_id"), F.concat(F.lit("legacy_"), F.col("id"))).alias("source_id"), F.when(F.col("source.provenance_status").isin("verified", "provided", "unverified"), F.col("source.provenance_status")).otherwise("provided").alias("provenance_status"),
    )
    conditions = F.struct(
        F.array(
            F.struct(F.lit("trigger").alias("group_id"), filled(group("trigger", 0), "trigger_patterns", "triggerPatterns").alias("any_of")),
            F.struct(F.lit("context").alias("group_id"), filled(group("context", 1), "context_patterns", "contextPatterns").alias("any_of")),
        ).alias("all_of"),
        filled(F.col("conditions.any_of"), "any_of_patterns", "anyOfPatterns").alias("any_of"),
        filled(F.col("conditions.none_of"), "exclusion_patterns", "exclusionPatterns").alias("none_of"),
        F.when(F.coalesce(F.col("conditions.scope"), F.col("condition_scope"), F.col("conditionScope")) == "paragraph", "paragraph").otherwise("sentence").alias("scope"),
        F.greatest(F.lit(0), F.floor(distance + 0.5)).cast("int").alias("max_distance"),
    )
    text = lambda snake, camel=None: F.coalesce(_either(snake, camel) if camel else F.col(snake), F.lit("")).alias(snake)
    return raw.select(
        F.lit(schemas.RULE_VERSION).alias("schema_version"), F.greatest(F.lit(1), F.floor(F.coalesce("revision", F.lit(1.0)) + 0.5)).cast("int").alias("revision"), text("id"), text("category"), text("subcategory"),
        text("pattern_type", "patternType"), conditions.alias("conditions"), text("surface_meaning", "surfaceMeaning"), text("risk_summary", "riskSummary"), text("social_context", "socialContext"),
        text("legal_or_ethic_issue", "legalOrEthicIssue"), text("risk_reason", "riskReason"), F.coalesce(_either("severity_floor", "severityFloor"), F.lit(0.0)).alias("severity_floor"),
        F.coalesce(_either("dominant_risk", "dominantRisk"), F.lit(False)).alias("dominant_risk"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), text("risk_domain", "riskDomain"),
        F.coalesce(_either("recent_context_tags", "recentContextTags"), F.array().cast("array<string>")).alias("recent_context_tags"), F.coalesce(_either("safe_rewrite", "safeRewrite"), F.array().cast("array<string>")).alias("safe_rewrite"),
        text("false_positive_note", "falsePositiveNote"), text("memo"), source.alias("source"), text("created_at", "createdAt"), text("updated_at", "updatedAt"),
        F.when(status.isin("reviewed", "draft", "rejected"), status).otherwise("draft").alias("review_status"), version.isin("", "1.0.0", schemas.RULE_VERSION).alias("version_ok"),
    )


def rule_errors() -> Column:
    """What is wrong with a rule, in a fixed order; reviewed rules are asked for more."""
    c = F.col
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    group = lambda k: F.coalesce(F.get(c("conditions.all_of"), F.lit(k))["any_of"], F.array().cast("array<string>"))
    reviewed = c("review_status") == "reviewed"
    checks = (
        (~F.coalesce(c("id").rlike(ID), F.lit(False)), "id"), (blank(c("category")), "category"), (blank(c("pattern_type")), "pattern_type"), (F.size(group(0)) == 0, "triggers"), (F.size(group(1)) == 0, "contexts"),
        (F.exists(F.concat(group(0), group(1)), blank), "blank_pattern"), (~F.coalesce(c("severity_floor").between(0, 100), F.lit(False)), "severity_floor"), (~F.coalesce(c("confidence").between(0, 1), F.lit(False)), "confidence"),
        (F.coalesce(c("revision"), F.lit(0)) < 1, "revision"), (~F.coalesce(c("conditions.max_distance").between(0, 2000), F.lit(False)), "max_distance"), (~F.coalesce(c("conditions.scope").isin("sentence", "paragraph"), F.lit(False)), "scope"),
        (~F.coalesce(c("review_status").isin("reviewed", "draft", "rejected"), F.lit(False)), "review_status"), (~blank(c("source.url")) & ~is_web_url(c("source.url")), "source_url"),
        (blank(c("created_at")), "created_at"), (blank(c("updated_at")), "updated_at"), (reviewed & blank(c("risk_reason")), "risk_reason"), (reviewed & (F.size("safe_rewrite") == 0), "safe_rewrite"), (reviewed & blank(c("risk_summary")), "risk_summary"),
        (reviewed & blank(c("risk_domain")), "risk_domain"), (reviewed & blank(c("source.title")), "source_title"), (reviewed & blank(c("source.source_id")), "source_id"),
    )
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in checks)))


def fingerprint(columns: list[str]) -> Column:
    """A hash of the columns in their order; absent and empty arrays differ."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def import_classes(current: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """(id, kind) of the incoming rules: new, same, update (a higher revision) or conflict; of an id's repeats the last, by _order if there is one."""
    if "_order" in incoming.columns:
        incoming = incoming.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_order")))).where("_k = 1")
    a = current.select("id", F.col("revision").alias("old"), fingerprint(columns).alias("had"))
    b = incoming.select("id", F.col("revision").alias("new"), fingerprint(columns).alias("has"))
    kind = F.when(F.col("had").isNull(), "new").when(F.col("had") == F.col("has"), "same").when(F.col("new") > F.col("old"), "update").otherwise("conflict")
    return b.join(a, "id", "left").select("id", kind.alias("kind"))


def merged_book(current: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """What stays and what comes: new rules and updates replace, all else is kept."""
    taken = import_classes(current, incoming, columns).where(F.col("kind").isin("new", "update")).select("id")
    return current.join(taken, "id", "left_anti").unionByName(incoming.select(current.columns).join(taken, "id", "left_semi"))


def import_summary(classes: DataFrame, current: DataFrame, n_errors: int = 0, replace: bool = False) -> DataFrame:
    """Counts of each kind, what is skipped, and the final number of rules."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    one = classes.agg(count("new"), count("same"), count("update"), count("conflict"), F.count("*").alias("_all"))
    skipped = F.lit(n_errors) if replace else F.col("conflict") + n_errors
    final = F.col("_all") if replace else F.col("_had") + F.col("new")
    return one.crossJoin(current.agg(F.count("*").alias("_had"))).select("new", "same", "update", "conflict", skipped.cast("long").alias("skipped"), final.alias("final_count"))


def upserted(current: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """current with rows in: by id, whatever the revision; a rule keeps its created_at."""
    kept = current.select("id", F.col("created_at").alias("_created"))
    fresh = rows.join(kept, "id", "left").withColumns({"created_at": F.coalesce("_created", now.cast("string")), "updated_at": now.cast("string")}).drop("_created")
    return current.join(rows.select("id"), "id", "left_anti").unionByName(fresh.select(current.columns))


def inserted_if_absent(current: DataFrame, rows: DataFrame) -> DataFrame:
    return current.unionByName(rows.select(current.columns).join(current.select("id"), "id", "left_anti"))


def deleted(current: DataFrame, rule_id: str) -> DataFrame:
    import re

    if not re.fullmatch(ID.strip("^$"), rule_id):
        raise ValueError("not a rule's id")
    return current.where(F.col("id") != rule_id)


def seed_upgraded(current: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds replace rows of lower revision that nobody touched: created and updated at one time."""
    old = current.where("created_at = updated_at").select("id", F.col("revision").alias("_old"))
    fresh = seeds.join(old, "id").where("revision > _old").select(current.columns)
    return current.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


# ---- exports ------------------------------------------------------------------------------


def trend_context(rules: DataFrame) -> DataFrame:
    """tag, rule_ids and categories (sorted, distinct) of the reviewed rules."""
    tagged = rules.where("review_status = 'reviewed'").select(F.explode("recent_context_tags").alias("tag"), "id", "category")
    return tagged.groupBy("tag").agg(F.sort_array(F.collect_set("id")).alias("rule_ids"), F.sort_array(F.collect_set("category")).alias("categories"))


def severity_export(rules: DataFrame) -> DataFrame:
    """Each category's greatest floor and its dominant rules."""
    known = rules.where("review_status = 'reviewed'")
    return known.groupBy("category").agg(F.max("severity_floor").alias("max_floor"), F.sort_array(F.collect_list(F.when(F.col("dominant_risk"), F.col("id")))).alias("dominant_ids"))


def rewrite_templates(rules: DataFrame) -> DataFrame:
    return rules.where("review_status = 'reviewed'").select("id", "category", "pattern_type", "safe_rewrite")


def source_index(rules: DataFrame) -> DataFrame:
    return rules.where("review_status = 'reviewed'").select("id", F.coalesce("source.source_id", F.lit("")).alias("source_id"), "source.title", "source.url", "source.date", F.coalesce("source.provenance_status", F.lit("provided")).alias("provenance_status"))


def effective_patterns(rules: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, role, patterns) of a book's triggers and contexts: a rule's own, then its type's variants, each once.

    rules: id, pattern_type, trigger and context (arrays); variants: pattern_type, role, pattern. Variants are
    gathered by type first, so a type of many rules meets one row; nulls and empty patterns are left out.
    """
    own = rules.select("id", "pattern_type", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(r, F.array().cast("array<string>")).alias("own")) for r in ("trigger", "context")))).alias("x")).select("id", "pattern_type", "x.*")
    added = variants.where("pattern <> ''").groupBy("pattern_type", "role").agg(F.array_sort(F.collect_set("pattern")).alias("added"))
    both = own.join(added, ["pattern_type", "role"], "left")
    every = F.array_distinct(F.concat("own", F.coalesce("added", F.array().cast("array<string>"))))
    return both.select("id", "role", F.filter(every, lambda p: F.coalesce(p != "", F.lit(False))).alias("patterns"))


def rules_jsonl(rules: DataFrame, drafts: bool = False) -> DataFrame:
    """One JSON line (value) for each valid rule, by id; drafts too if asked."""
    names = StructType.fromDDL(schemas.RULE).fieldNames() if hasattr(StructType, "fromDDL") else rules.columns
    known = rules.where(F.size(rule_errors()) == 0)
    known = known if drafts else known.where("review_status = 'reviewed'")
    return known.orderBy("id").select(F.to_json(F.struct(*(n for n in names if n in rules.columns))).alias("value"))
