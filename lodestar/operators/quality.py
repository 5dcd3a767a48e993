"""Evaluation against finite oracles: claim lines, record tuples, metrics, gates."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import negated_before

# The claim line and the record sentence.
CLAIM = r"^\s*(?:(?i:(FACT))\s+)?([A-Za-z0-9-]+)\s*:\s*(.*?)\s*$"
FIELDS = ("code", "station", "site", "field", "value", "unit", "date")
RECORD = (
    r"(?:Observation\s+)?(?<code>H\d{3}):\s*station\s+(?<station>S\d{3})\s+at\s+(?<site>\w+)\s+plot\s+measured\s+(?<field>soil moisture|river temperature|wind speed|rainfall)"
    r"\s+(?<value>\d+)\s+(?<unit>percent|degrees Celsius|kilometers per hour|millimeters)\s+on\s+(?<date>\d{4}-\d{2}-\d{2})\."
)


def claim_lines(outputs: DataFrame) -> DataFrame:
    """outputs (case_id, text) as lines: case_id, line_number, prefix, id, statement, format_error."""
    lines = outputs.select("case_id", F.posexplode(F.split("text", "\\r?\\n")).alias("at", "line")).where(F.trim("line") != "")
    line = F.trim("line")
    parsed = line.rlike(CLAIM)
    error = F.when(~parsed, "unparsed-line").when(F.regexp_extract(line, CLAIM, 1) == "", "missing-fact-prefix")
    part = lambda i: F.when(parsed, F.regexp_extract(line, CLAIM, i))
    return lines.select("case_id", (F.col("at") + 1).alias("line_number"), part(2).alias("id"), part(3).alias("statement"), error.alias("format_error"))


def rule_findings(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, line_number, rule_id, kind): rules whose pattern stands in a statement and isn't negated there.

    Rules are a small closed set that goes to all tasks; each line meets each rule, which is the operator's definition."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(text: pd.Series, pattern: pd.Series) -> pd.Series:
        return pd.Series([[m.start() for m in regex.finditer(p, t or "", regex.I)] for t, p in zip(text, pattern, strict=True)])

    met = texts.join(F.broadcast(rules)).withColumn("at", F.explode(places("statement", "pattern")))
    live = met.where(~negated_before(F.col("statement"), F.col("at")))
    return live.select("case_id", "line_number", "rule_id", "kind").distinct()


def fact_match(statement: Column, pattern: Column, negated_by: Column) -> Column:
    """Whether a statement has a fact's pattern and none of what negates it; patterns are columns."""
    has = F.regexp_like(statement, F.concat(F.lit("(?i)"), pattern))
    return has & ~F.coalesce(F.regexp_like(statement, F.concat(F.lit("(?i)"), negated_by)), F.lit(False))


def evaluate_claims(lines: DataFrame, facts: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """lines judged: reason null for a true claim, else the first of unknown-id, duplicate, contradiction, unsupported,
    cross-id and oracle-miss that holds. facts (id, pattern, negated_by) is a small closed set."""
    known = F.broadcast(facts.withColumnRenamed("id", "fact"))
    parsed = lines.where("id is not null")
    own = parsed.join(known, parsed["id"] == F.col("fact"), "left")
    own = own.withColumn("own", F.coalesce(fact_match(F.col("statement"), F.col("pattern"), F.col("negated_by")), F.lit(False))).drop("pattern", "negated_by")
    turn = F.row_number().over(Window.partitionBy("case_id", "id").orderBy("line_number"))
    own = own.withColumn("turn", turn)
    foreign = parsed.join(F.broadcast(facts.withColumnRenamed("id", "other")), F.col("id") != F.col("other")).where(fact_match(F.col("statement"), F.col("pattern"), F.col("negated_by")))
    foreign = foreign.select("case_id", "line_number").distinct().withColumn("foreign", F.lit(True))
    judged = own.join(foreign, ["case_id", "line_number"], "left")
    if findings is not None:
        found = findings.groupBy("case_id", "line_number").agg(F.bool_or(F.col("kind") == "contradiction").alias("con"), F.bool_or(F.col("kind") == "unsupported").alias("uns"))
        judged = judged.join(found, ["case_id", "line_number"], "left")
    else:
        judged = judged.withColumn("con", F.lit(False)).withColumn("uns", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("fact").isNull(), "unknown-id").when(F.col("turn") > 1, "duplicate").when(yes("con"), "contradiction").when(yes("uns"), "unsupported")
        .when(~F.col("own") & yes("foreign"), "cross-id").when(~F.col("own"), "oracle-miss")
    )
    return judged.select("case_id", "line_number", "id", reason.alias("reason"))


def precision_recall(judged: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, tp, fp, fn, precision, recall); a rate with nothing below it is null."""
    total = facts.agg(F.count(F.lit(1)).alias("facts"))
    per = judged.groupBy("case_id").agg(F.count_if(F.col("reason").isNull()).alias("tp"), F.count_if(F.col("reason").isNotNull()).alias("fp")).join(F.broadcast(total))
    fn = F.col("facts") - F.col("tp")
    return per.select("case_id", "tp", "fp", fn.alias("fn"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + fn).alias("recall"))


def missed_facts(judged: DataFrame, facts: DataFrame) -> DataFrame:
    """(case_id, id): facts, a small closed set, that no true claim of a case is about."""
    every = judged.select("case_id").distinct().join(F.broadcast(facts.select("id")))
    return every.join(judged.where("reason is null").select("case_id", "id"), ["case_id", "id"], "left_anti")


def records(texts: DataFrame) -> DataFrame:
    """texts (case_id, text) -> one row for each record sentence: case_id, place and the seven fields."""
    every = F.regexp_extract_all("text", F.lit(f"({RECORD})"), 1)
    found = texts.select("case_id", F.posexplode(every).alias("place", "sentence"))
    return found.select("case_id", "place", *(F.regexp_extract("sentence", RECORD, i + 1).alias(f) for i, f in enumerate(FIELDS)))


def parse_record_lines(lines: DataFrame) -> DataFrame:
    """lines (line) that must each be one record entirely; any other line is an error."""
    whole = F.col("line").rlike(f"^{RECORD}$")
    bad = F.raise_error(F.concat(F.lit("not a record line: "), F.col("line"))).cast("string")
    line = F.when(whole, F.col("line")).otherwise(bad)
    return lines.select(*(F.regexp_extract(line, RECORD, i + 1).alias(f) for i, f in enumerate(FIELDS)))


def score_records(found: DataFrame, oracle: DataFrame) -> DataFrame:
    """found records judged: true, contradiction (code known, a field differs) or unsupported (code unknown)."""
    same = F.col("o.code").isNotNull()
    for f in FIELDS[1:]:
        same = same & (F.col(f"f.{f}") == F.col(f"o.{f}"))
    joined = found.alias("f").join(oracle.alias("o"), F.col("f.code") == F.col("o.code"), "left")
    return joined.select("f.case_id", "f.place", "f.code", F.when(F.col("o.code").isNull(), "unsupported").when(same, "true").otherwise("contradiction").alias("verdict"))


def hierarchy_scores(texts: DataFrame, oracle: DataFrame) -> DataFrame:
    """texts (case_id, part, n, text): the records of each part of a case (retained, generated, overview) judged apart: case_id,
    part, code, verdict. A true record of a code that the part has had is a duplicate and counts for nothing."""
    found = records(texts.select(F.struct("case_id", "part", "n").alias("case_id"), "text"))
    judged = score_records(found, oracle).select("case_id.case_id", "case_id.part", "case_id.n", "place", "code", "verdict")
    turn = F.row_number().over(Window.partitionBy("case_id", "part", "code", F.col("verdict") == "true").orderBy("n", "place"))
    return judged.select("case_id", "part", "code", F.when((F.col("verdict") == "true") & (turn > 1), "duplicate").otherwise(F.col("verdict")).alias("verdict"))


def stray_codes(texts: DataFrame) -> DataFrame:
    """(case_id, strays): codes in a text outside any record sentence; sentences are blanked, what is left is counted."""
    rest = F.regexp_replace("text", RECORD, " ")
    return texts.select("case_id", F.regexp_count(rest, F.lit("(?<![A-Za-z0-9_])H[0-9]{3}(?![A-Za-z0-9_])")).alias("strays")).where("strays > 0")


def gate(metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """metrics (scope, metric, value) against policy (scope, metric, least): what fails; a null value fails."""
    joined = policy.join(metrics, ["scope", "metric"], "left")
    return joined.where(F.col("value").isNull() | (F.col("value") < F.col("least"))).select("scope", "metric", "value", "least")


def compare_artifacts(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, differs): keys that only one side has, or the columns that differ."""
    both = left.alias("a").join(right.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    only = F.when(F.col(f"a.{key}").isNull(), F.array(F.lit("only right"))).when(F.col(f"b.{key}").isNull(), F.array(F.lit("only left")))
    out = both.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), F.array_join(F.coalesce(only, names), ",").alias("differs"))
    return out.where("differs <> ''")
