"""Draft rules from texts, patched rule books, frozen case sets and causes of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan import schemas
from loomspan.functions.text import let, squeezed
from loomspan.operators import matching, ranks
from loomspan.operators.rules import LanguagePack, Policy, Rule

#: What a draft says where no rule matched its text; a language pack may give other words.
TEMPLATE = {
    "category": "to be sorted",
    "subcategory": "needs context",
    "pattern_type": "candidate_expression + contextual_review",
    "risk_summary": "Someone has to review where and with what the expression is used.",
    "legal_or_ethic_issue": "A draft is no legal judgement.",
    "risk_reason": "Say which context has to stand beside the expression.",
    "false_positive_note": "Look for quotation, teaching, criticism and neutral information.",
}
#: Where no rule matched: (expression over the squeezed text and description, category, domain); the first counts.
CASCADE = (
    (r"sentence|dismiss|lawsuit|court|legal", "professional services", "legal"),
    (r"location|track|personal data|surveil", "privacy", "privacy"),
    (r"cure|treat|medic|disease", "health", "health"),
    (r"profit|invest|principal", "finance", "finance"),
    (r"admission|grades|exam", "education", "education"),
)
OTHERWISE = ("reputation", "campaign")
SEVERITY_FLOOR, CONFIDENCE, MAX_DISTANCE, PREVIEW_ROWS = 55.0, 0.45, 48, 50
_NAMES = [part.split()[0] for part in schemas.RULE.replace(schemas.CONDITIONS, "x").replace(schemas.SOURCE, "x").split(", ")]


def edge_words(text: Column) -> Column:
    """The first and last of the levelled text's words of two characters or more; null for fewer than two."""
    words = F.filter(F.split(squeezed(text), r"[^\p{L}\p{N}%·.]+"), lambda w: F.length(w) >= 2)
    return let(words, lambda ws: F.when(F.size(ws) >= 2, F.array(F.element_at(ws, 1), F.element_at(ws, -1))))


def inferred(text: Column, cascade=CASCADE, otherwise: tuple[str, str] = OTHERWISE) -> Column:
    """struct<category, domain> of the first expression that the squeezed text holds; a null text holds none."""
    both = lambda category, domain: F.struct(F.lit(category).alias("category"), F.lit(domain).alias("domain"))

    def first(plain: Column) -> Column:
        out = both(*otherwise)
        for pattern, category, domain in reversed(cascade):
            out = F.when(plain.rlike(pattern), both(category, domain)).otherwise(out)
        return out

    # The form is taken once, not for each expression.
    return let(squeezed(F.coalesce(text, F.lit(""))), first)


def interpreted(cases: DataFrame, rules: list[Rule], book: DataFrame, policy: Policy | None = None, pack: LanguagePack | None = None, cascade=CASCADE, otherwise: tuple[str, str] = OTHERWISE) -> DataFrame:
    """A draft rule for each case from the engine's reading of its text.

    cases: text, description, domain, occurred_at, source_url, memo and at; other columns are ignored.
    rules is what the engine judges by, drafts among it too, and book their table (``schemas.RULE``). A
    case whose text a rule matches gets a copy of the best one; of others category and domain are
    inferred from text and description, and the first and last word stand for trigger and context.
    """
    names = ("text", "description", "domain", "occurred_at", "source_url", "memo", "at")
    judged = matching.analyze(cases.select(*names), rules, policy, pack, drafts=True)
    told = inferred(F.concat_ws(" ", "text", "description"), cascade, otherwise)
    rows = judged.select(*names, F.get("matches", F.lit(0))["rule_id"].alias("matched_id"), told.alias("_told"))
    own = F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.col("_told.domain"))
    # The table has as many rows as the list of rules: sent to the texts, it needs no task for all that match nothing.
    return drafts(rows.withColumns({"domain": own, "category": F.col("_told.category")}).drop("_told"), F.broadcast(book))


def drafts(cases: DataFrame, book: DataFrame) -> DataFrame:
    """A draft rule (``schemas.RULE``) for each case: a copy of the rule it matched, else the template.

    cases: text, description, domain, occurred_at, source_url, memo, matched_id (null for
    none) and at, the time that names the draft; a column category is the template's. Null texts count as empty.
    """
    filled = lambda c, other: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(other))
    had = book.select(F.col("id").alias("matched_id"), F.struct(*_NAMES).alias("_rule"))
    rows = cases.join(had, "matched_id", "left").withColumns({"_text": F.coalesce("text", F.lit("")), "_domain": filled("domain", TEMPLATE["category"]), "_at": F.date_format("at", "yyyyMMddHHmmss")})
    rows = rows.withColumn("_edge", edge_words(F.col("_text")))
    none = F.array().cast("array<string>")
    whole = F.filter(F.array(F.trim("_text")), lambda x: x != "")
    group = lambda name, k, other: F.struct(F.lit(name).alias("group_id"), F.when(F.col("_edge").isNotNull(), F.array(F.get("_edge", F.lit(k)))).otherwise(other).alias("any_of"))
    category = {"category": filled("category", TEMPLATE["category"])} if "category" in cases.columns else {}
    template = {name: F.lit(text) for name, text in TEMPLATE.items()} | category | {
        "schema_version": F.lit(schemas.RULE_VERSION),
        "conditions": F.struct(F.array(group("trigger", 0, whole), group("context", 1, F.array("_domain"))).alias("all_of"), none.alias("any_of"), none.alias("none_of"), F.lit("sentence").alias("scope"), F.lit(MAX_DISTANCE).alias("max_distance")),
        "social_context": filled("description", ""), "severity_floor": F.lit(SEVERITY_FLOOR), "dominant_risk": F.lit(False), "confidence": F.lit(CONFIDENCE), "risk_domain": F.col("_domain"), "recent_context_tags": F.array(F.lit("to review")), "safe_rewrite": none,
    }
    url, stamp = filled("source_url", ""), F.col("at").cast("string")
    source = F.struct(filled("description", "entered by hand").alias("title"), url.alias("url"), filled("occurred_at", "").alias("date"), F.concat(F.lit("manual_"), "_at").alias("source_id"), F.when(url != "", "provided").otherwise("synthetic_unverified").alias("provenance_status"))
    own = {"id": F.concat(F.lit("risk_draft_"), "_at"), "revision": F.lit(1), "surface_meaning": F.col("_text"), "memo": filled("memo", ""), "source": source, "created_at": stamp, "updated_at": stamp, "review_status": F.lit("draft")}
    return rows.select(*(own[n].alias(n) if n in own else F.coalesce(F.col("_rule")[n], template[n]).alias(n) for n in _NAMES))


def draft_cases(rows: DataFrame, at: Column, name: str = "") -> DataFrame:
    """Cases for ``drafts`` from a table (row_no from 1, keyword, category): its first rows with a keyword, a second apart."""
    first = rows.where((F.col("row_no") <= PREVIEW_ROWS) & (F.trim(F.coalesce("keyword", F.lit(""))) != ""))
    second = F.row_number().over(Window.orderBy("row_no")) - 1  # over the preview's rows alone
    nothing = F.lit(None).cast("string")
    return first.select(
        F.trim("keyword").alias("text"), F.lit(f"table {name}".strip()).alias("description"), F.col("category").alias("domain"), nothing.alias("occurred_at"), nothing.alias("source_url"), F.lit("review queue").alias("memo"),
        nothing.alias("matched_id"), (at + F.make_dt_interval(secs=second)).alias("at"),
    )


def patched(base: DataFrame, sources: DataFrame, overrides: DataFrame, tag: str, memo: str, at: str, revision: int = 2) -> DataFrame:
    """base with each rule's source (a missing one is an error) and the fields of overrides that are not null."""
    fields = [c for c in overrides.columns if c != "id"]
    found = base.join(sources.select("id", F.col("source").alias("_source")), "id", "left").join(overrides.select("id", *(F.col(c).alias(f"_{c}") for c in fields)), "id", "left")
    fixed = {
        "revision": F.lit(revision), "source": F.when(F.col("_source").isNull(), F.raise_error(F.concat(F.lit("no source for "), "id")).cast(base.schema["source"].dataType)).otherwise(F.col("_source")),
        "recent_context_tags": F.array_append(F.coalesce("recent_context_tags", F.array().cast("array<string>")), F.lit(tag)), "memo": F.lit(memo), "updated_at": F.lit(at), "review_status": F.lit("draft"),
    }
    return found.select(*(fixed[c].alias(c) if c in fixed else F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def numbered(cases: DataFrame, order: str, prefix: str = "FB", width: int = 3) -> DataFrame:
    """case_id by order. A set that the width cannot number is an error."""
    n = F.col("_n")
    given = F.when(n < 10**width, F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))).otherwise(F.raise_error(F.lit("too many cases for the width")))
    return ranks.numbered(cases, order, "_n").withColumn("case_id", given).drop("_n")


def set_checks(cases: DataFrame, sizes: dict[str, int], least_sources: int, source_cap: int, domains: tuple[str, ...]) -> DataFrame:
    """One row of checks of a frozen set (source_type, source_url, domain, text), and ``passed``."""
    whole = cases.agg(*(F.count_if(F.col("source_type") == t).alias(f"n_{t}") for t in sizes), F.count("*").alias("n"), F.count_distinct("source_url").alias("urls"), F.collect_set(F.when(F.col("domain").isin(*domains), F.col("domain"))).alias("seen"))
    repeated = cases.groupBy(F.trim("text").alias("t")).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("per_text"))
    capped = cases.groupBy("source_url").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("per_url"))
    composition = F.col("n") == sum(sizes.values())
    for t, n in sizes.items():
        composition = composition & (F.col(f"n_{t}") == n)
    checks = {"composition": composition, "enough_sources": F.col("urls") >= least_sources, "source_cap": F.col("per_url") <= source_cap, "all_domains": F.size("seen") == len(domains), "texts_once": F.col("per_text") <= 1}
    one = whole.crossJoin(repeated).crossJoin(capped).select(*(c.alias(k) for k, c in checks.items()))  # single rows
    return one.withColumn("passed", F.forall(F.array(*checks), lambda x: x))


def root_cause(issue: Column, expected: Column) -> Column:
    """(cause, layer) of a failed case; null where nothing failed."""
    both = lambda cause, layer: F.struct(F.lit(cause).alias("cause"), F.lit(layer).alias("layer"))
    return (
        F.when(F.coalesce(issue, F.lit("none")) == "none", None)
        .when(issue == "false_positive", both("engine_context", "engine"))
        .when(issue == "score_mismatch", both("scoring_or_output", "scoring"))
        .when((issue == "false_negative") & (expected == "risky"), both("missing_skill", "skill_bundle"))
        .otherwise(both("scoring_or_output", "evaluation_only"))
    )
