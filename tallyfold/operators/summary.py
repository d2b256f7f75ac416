"""Roll-ups of issues and run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.reconcile import union_all
from tallyfold.session import written

# The issue types of components, in report order.
COMPONENT_TYPES = (
    "component_missing_translations",
    "component_missing_key",
    "component_unused_key",
    "component_hardcoded_text",
    "component_needs_translations",
    "translation_path_mismatch",
    "orphaned_translation_folder",
    "duplicate_use_translation",
    "aliased_translation_function",
)


def observed(df: DataFrame, label: str, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written and read back, with aggregates of its rows that are gathered in the pass that writes it.

    A task that is run again after its executor was lost may be counted twice. So the rows are counted as well, and where they do not
    equal the rows of the files, the counters are taken from the files.
    """
    watch = Observation(label)
    named = [c.alias(n) for n, c in counters.items()]
    fresh, rows = written(df.observe(watch, F.count(F.lit(1)).alias("_rows"), *named), label)
    seen = watch.get
    if seen["_rows"] != rows:
        seen = fresh.agg(F.count(F.lit(1)).alias("_rows"), *named).first().asDict()
    return fresh, {n: seen[n] or 0 for n in counters}


def summary_row(spark: SparkSession, what: str, issues: int, checked: dict[str, int]) -> DataFrame:
    """One row ``(status, valid, message, total_issues, *checked)`` of a check that looked at so many things of each kind."""
    looked = ", ".join(f"{n} {kind.removesuffix('_checked')}" for kind, n in checked.items())
    said = f"{what}: {issues or 'no'} issues" + (f" in {looked}" if looked else "")
    kinds = "".join(f", {kind} long" for kind in checked)
    row = ("validation_errors" if issues else "success", not issues, said, issues, *checked.values())
    return spark.createDataFrame([row], f"status string, valid boolean, message string, total_issues long{kinds}")


def issue_counts(checks: dict[str, DataFrame]) -> DataFrame:
    """``(source, type, issues)`` over several sets of issues."""
    parts = [df.select(F.lit(source).alias("source"), "type") for source, df in checks.items()]
    return union_all(parts).groupBy("source", "type").agg(F.count(F.lit(1)).alias("issues"))


def run_summary(counts: DataFrame, sources: list[str]) -> DataFrame:
    """One row per check: ``(source, status, valid, total_issues, issue_types)``; clean checks included."""
    totals = counts.groupBy("source").agg(F.sum("issues").alias("n"), F.count(F.lit(1)).alias("types"))
    expected = counts.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return expected.join(totals, "source", "left").select(
        "source",
        F.when(n == 0, "success").otherwise("validation_errors").alias("status"),
        (n == 0).alias("valid"),
        n.alias("total_issues"),
        F.coalesce("types", F.lit(0)).cast("long").alias("issue_types"),
    )


def translation_summary(
    file_issues: DataFrame, component_issues: DataFrame, global_issues: DataFrame, **checked: int
) -> DataFrame:
    """One row: all issues, those of components and of bundle files, what was ``checked``, status and message.

    Each set of issues is counted while it is written, and read once.
    """
    of_component = F.col("type").isin(*COMPONENT_TYPES)
    counted = {}
    for name, found in (("file", file_issues), ("component", component_issues), ("global", global_issues)):
        counted[name] = observed(found.select("type"), name, every=F.count(F.lit(1)), component=F.count_if(of_component))[1]
    total = sum(c["every"] for c in counted.values())
    row = summary_row(file_issues.sparkSession, "translations", total, checked)
    parts = {"component_issues": counted["component"]["component"], "file_issues": counted["file"]["every"] - counted["file"]["component"]}
    return row.withColumns({name: F.lit(n).cast("long") for name, n in parts.items()})
