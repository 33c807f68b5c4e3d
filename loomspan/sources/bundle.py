"""The five-file bundle of a rule book: rules as JSON lines, and four JSON documents beside them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomspan.operators import matching, rulebook
from loomspan.operators.rules import LanguagePack, Policy, Rule, rules_from
from loomspan.sources import files

# The names of the files of a bundle.
RULES = "risk_skills.jsonl"
SEVERITY, TREND, REWRITES, SOURCES = "severity_rules.json", "trend_context.json", "rewrite_templates.json", "source_index.json"
DOCUMENTS = (SEVERITY, TREND, REWRITES, SOURCES)


@dataclass
class Bundle:
    """Valid rules, the issues of the rules' lines, the policy, and what is wrong with the files."""

    rules: DataFrame | None
    line_issues: DataFrame | None
    policy: Policy = field(default_factory=Policy)
    issues: list[str] = field(default_factory=list)
    usable: bool = False


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    return sorted(s.getPath().getName() for s in found)


def _is_object(spark: SparkSession, path: str) -> bool:
    rows = spark.read.text(path, wholetext=True).limit(2).select(F.json_object_keys(F.trim("value")).isNotNull().alias("ok")).collect()
    return len(rows) == 1 and bool(rows[0]["ok"])


def read_bundle(spark: SparkSession, folder: str) -> Bundle:
    """A bundle's rules and policy. A missing file of rules, a name that is none of the bundle's, and
    a document that is no JSON object are issues; the four documents may be missing."""
    return read_selected(spark, [f"{folder}/{n}" for n in _names(spark, folder)])


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).limit(1).collect()
    except (PySparkException, Py4JError):
        return False
    return True


def read_selected(spark: SparkSession, paths: list[str]) -> Bundle:
    """``read_bundle`` of files chosen one by one, from any folders.

    Of two files of one name the first counts, but two files of rules are none that can be used; a
    file that cannot be read is an issue. ``usable`` tells whether the rules may be taken over.
    """
    out, known, broken = Bundle(None, None), {}, set()
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if name not in (RULES, *DOCUMENTS):
            out.issues.append(f"{name}: not a file of a bundle")
        elif name in known:
            out.issues.append(f"{name}: chosen twice")
            broken.add(name)
        else:
            known[name] = path
            if not _readable(spark, path):
                out.issues.append(f"{name}: cannot be read")
                broken.add(name)
                known[name] = None
    if known.get(RULES):
        out.rules, out.line_issues = files.read_rules(spark, known[RULES])
    elif RULES not in known:
        out.issues.append(f"{RULES}: missing")
    for name in (n for n in DOCUMENTS if known.get(n)):
        if not _is_object(spark, known[name]):
            out.issues.append(f"{name}: not a JSON object")
        elif name == SEVERITY:
            out.policy, faults = files.read_policy(spark, known[name])
            out.issues += [f"{name}: {f}" for f in faults]
    out.usable = out.rules is not None and RULES not in broken and out.line_issues.isEmpty() and not out.rules.isEmpty()
    return out


@dataclass(frozen=True)
class Engine:
    """The reviewed rules and the policy of a bundle, ready to judge texts."""

    rules: list[Rule]
    policy: Policy

    def analyze(self, texts: DataFrame, pack: LanguagePack | None = None) -> DataFrame:
        return matching.analyze(texts, self.rules, self.policy, pack)


def load_engine(spark: SparkSession, folder: str) -> Engine:
    """An engine from a bundle. Any issue of its files or lines, and a bundle without a reviewed rule, is an error."""
    found = read_bundle(spark, folder)
    issues = list(found.issues)
    if found.line_issues is not None:  # a book's lines, which people write
        issues += [f"{RULES}: line of {r['id'] or 'no id'}: {', '.join(r['errors'])}" for r in found.line_issues.orderBy("line_no").limit(20).collect()]
    if issues:
        raise ValueError("the bundle cannot be used: " + " ".join(issues))
    rules = rules_from(found.rules.where("review_status = 'reviewed'"))
    if not rules:
        raise ValueError("the bundle cannot be used: it has no reviewed rule")
    return Engine(rules, found.policy)


def _document(rows: DataFrame, key: str) -> DataFrame:
    """One JSON object whose key holds the rows: a report of a book, which is small."""
    listed = F.sort_array(F.collect_list(F.struct(*rows.columns)))
    return rows.agg(F.to_json(F.struct(listed.alias(key))).alias("value"))


def write_bundle(rules: DataFrame, folder: str, policy: Policy | None = None) -> None:
    """The five files as folders of one text file each, named as in a bundle; reads back with ``read_bundle``."""
    p = policy or Policy()
    severity = {
        "no_match_score": p.no_match_score, "category_corroboration_per_pattern": p.corroboration_per_pattern, "max_category_corroboration": p.max_corroboration,
        "secondary_category_weight": p.second_weight, "tertiary_category_weight": p.third_weight, "max_cross_category_support": p.max_support,
    }
    grades = F.array(*(F.struct(F.lit(g).alias("grade"), F.lit(float(a)).alias("min"), F.lit(float(b)).alias("max")) for g, a, b in p.grades))
    categories = F.sort_array(F.collect_list(F.struct("category", "max_floor", "dominant_ids")))
    own = rulebook.severity_export(rules).agg(F.to_json(F.struct(*(F.lit(float(v)).alias(k) for k, v in severity.items()), grades.alias("grade_thresholds"), categories.alias("categories"))).alias("value"))
    files.write_lines(rulebook.rules_jsonl(rules), f"{folder}/{RULES}")
    files.write_lines(own, f"{folder}/{SEVERITY}")
    for name, key, rows in ((TREND, "tags", rulebook.trend_context(rules)), (REWRITES, "templates", rulebook.rewrite_templates(rules)), (SOURCES, "sources", rulebook.source_index(rules))):
        files.write_lines(_document(rows, key), f"{folder}/{name}")
