"""Who decides on a recommendation, and what was done to it: decisions as a plan over a table of recommendations.

Rules of a domain (owners by category, categories and amounts that need approval) are rows of a small table. Each recommendation
comes back with one trail record for every rule that applied: the rule, what it looked at, the value before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.domains import PLUGINS

#: Columns a recommendation may have; what is missing is null.
ADVICE = {"id": "string", "category": "string", "impact": "double", "confidence": "double", "urgency": "double", "amount": "double", "metric": "string", "segment": "string", "evidence": "array<struct<method: string, p: double>>"}
# Recommendations are critical, high or medium from these scores on.
PRIORITIES = (("critical", 80.0), ("high", 60.0), ("medium", 35.0))
#: Who approves and who owns where a domain says nothing.
AUTHORITY, OWNER = "Analytics Lead", "Business Owner"


def priority(score: Column) -> Column:
    out = F.lit("low")
    for name, least in reversed(PRIORITIES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def _owners(df: DataFrame, domain: str) -> DataFrame:
    """(category, owner, needs): the domain's word on each category it names."""
    p = PLUGINS.get(domain)
    named = {} if p is None else {c: (p.owners.get(c), c in p.approve) for c in {*p.owners, *p.approve}}
    return df.sparkSession.createDataFrame([(c, o, n) for c, (o, n) in sorted(named.items())], "category string, owner string, needs boolean")


def decide(advice: DataFrame, domain: str, verdict: str, cap: float | None = None) -> DataFrame:
    """Recommendations with confidence under the cap, score, priority, owner, approval, authority, tests, significance and trail.

    A domain without rules of its own has critical ones approved by AUTHORITY; one with rules goes by category and amount.
    """
    known = {c.lower() for c in advice.columns}
    full = advice.withColumns({c: F.lit(None).cast(k) for c, k in ADVICE.items() if c not in known})
    rules = PLUGINS.get(domain)
    held = F.col("confidence_before") if cap is None else F.least("confidence_before", F.lit(cap))
    x = full.withColumn("category", F.coalesce("category", F.lit("growth"))).withColumnRenamed("confidence", "confidence_before").withColumn("confidence", held)
    x = x.join(F.broadcast(_owners(advice, domain)), "category", "left")
    x = x.withColumn("score", 100 * F.col("impact") * F.col("confidence") * F.col("urgency")).withColumn("priority", priority(F.col("score")))
    large = F.coalesce(F.abs("amount") >= (rules.limit if rules else 0.0), F.lit(False))
    approval = F.col("priority") == "critical" if rules is None else F.coalesce("needs", F.lit(False)) | large
    x = x.withColumns({"owner": F.coalesce("owner", F.lit(OWNER)), "approval": approval, "tests": F.array_distinct(F.filter(F.coalesce(F.col("evidence.method"), F.array().cast("array<string>")), lambda m: m.isNotNull())), "significance": F.array_min(F.col("evidence.p"))})
    x = x.withColumn("authority", F.when(F.col("approval"), F.lit(rules.authority if rules else AUTHORITY)).otherwise(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c

    def record(rule: str, when: Column, looked_at: Column, before: Column, after: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), looked_at.alias("input"), before.alias("before"), after.alias("after")))

    none = F.lit("")
    trail = F.array_compact(F.array(
        record("fired", F.lit(True), F.concat_ws(" / ", "metric", "segment"), none, text("id")),
        record("evidence", F.size("tests") > 0, F.array_join("tests", ","), none, F.size("evidence").cast("string")),
        record("readiness", F.lit(True), F.lit(verdict), none, none),
        record("cap", F.col("confidence") < F.col("confidence_before"), F.lit(verdict), F.format_number("confidence_before", 2), F.format_number("confidence", 2)),
        record("owner", F.lit(True), text("category"), none, text("owner")),
        record("approval", F.col("approval"), F.when(large & F.lit(rules is not None), F.lit("amount")).otherwise(F.lit("category" if rules else "priority")), none, text("authority")),
    ))
    cols = ["id", "category", "metric", "segment", "amount", "impact", "urgency", "confidence", "confidence_before", "score", "priority", "owner", "approval", "authority", "tests", "significance"]
    return x.withColumn("trail", trail).select(*cols, "trail")
