"""Reports as records: plans of sections, cited evidence, checksums, serialising, and validation on the way back."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.canonical import canonical_json, hash_value

#: Facts of a section, version of a report.
SECTION_FACTS, REPORT_VERSION = 4, 3


def greedy_groups(sizes: list[int], most: int, budget: int) -> list[int]:
    """The group (from 0) of each item in order: a new one begins where the last has ``most`` items or no room. An item beyond
    the budget on its own is an error."""
    out, group, held, used = [], 0, 0, 0
    for n in sizes:
        if n > budget:
            raise ValueError("one item is beyond the budget")
        if held and (held == most or used + n > budget):
            group, held, used = group + 1, 0, 0
        out.append(group)
        held, used = held + 1, used + n
    return out


def planned_sections(facts: DataFrame, tokens: Column, budget: int, most: int = SECTION_FACTS) -> DataFrame:
    """facts (page_id, ordinal, ...) with section (from 0). A page's facts are a sequence, so only their sizes meet in one row."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def groups(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: greedy_groups(list(x), most, budget))

    sized = facts.withColumn("tokens", tokens.cast("int"))
    order = sized.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "tokens"))).alias("items"))
    placed = order.select("page_id", "items", groups(F.transform("items", lambda x: x["tokens"])).alias("at"))
    placed = placed.select("page_id", F.explode(F.arrays_zip("items", "at")).alias("x")).select("page_id", "x.items.ordinal", F.col("x.at").alias("section"))
    return facts.join(placed, ["page_id", "ordinal"])


def section_paragraphs(planned: DataFrame) -> DataFrame:
    """(page_id, section, paragraph_ids): the distinct paragraphs of each section in order of first use."""
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "paragraph_id")))
    return planned.groupBy("page_id", "section").agg(F.array_distinct(F.transform(listed, lambda x: x["paragraph_id"])).alias("paragraph_ids"))


def cited_evidence(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims (page_id, target, fact_id) with the citation of their evidence; an id that no fact has is an error."""
    found = claims.join(facts.select("page_id", "fact_id", F.struct("paragraph_id", "version_id", "start", "end", "quote").alias("citation")), ["page_id", "fact_id"], "left")
    lost = F.raise_error(F.concat(F.lit("unknown evidence "), F.coalesce("fact_id", F.lit("null")))).cast(found.schema["citation"].dataType)
    return found.withColumn("citation", F.when(F.col("citation").isNotNull(), F.col("citation")).otherwise(lost)).select("page_id", "target", "fact_id", "citation.*")


def reference_faults(rows: DataFrame, key: str, listed: Column, available: Column) -> DataFrame:
    """(key, reason): lists that name something that isn't available, or something twice."""
    reason = F.when(F.size(F.array_except(listed, available)) > 0, "unknown").when(F.size(F.array_distinct(listed)) < F.size(listed), "repeated")
    return rows.select(key, reason.alias("reason")).where("reason is not null")


def allowed_fields(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows reduced to the named fields that they have: what is added to them later isn't passed on."""
    return rows.select(*(n for n in names if n in rows.columns))


def all_facts(*lists: DataFrame) -> DataFrame:
    """The facts of several lists, all rows kept."""
    return reduce(DataFrame.unionByName, lists)


def serialized_reports(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """(page_id, report): each page's report as canonical JSON, with the hash of all else as its checksum."""

    @F.pandas_udf("string")
    def text(page: pd.Series, facts: pd.Series, claims: pd.Series) -> pd.Series:
        out = []
        for p, fs, cs in zip(page, facts, claims, strict=True):
            body = {"schemaVersion": REPORT_VERSION, "pageId": str(p), "sourceFacts": [json.loads(x) for x in fs], "claims": [json.loads(x) for x in cs]}
            out.append(canonical_json(body | {"checksum": hash_value(body)}))
        return pd.Series(out)

    fact = F.to_json(F.struct(F.col("fact_id").alias("id"), F.col("paragraph_id").alias("paragraphId"), F.col("version_id").alias("versionId"), F.col("start").alias("startOffset"), F.col("end").alias("endOffset"), "quote"))
    claim = F.to_json(F.struct(F.col("target").alias("id"), F.col("fact_id").alias("evidenceId"), "text"))
    listed = lambda df, order, x, name: df.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, x.alias("x")))), lambda y: y["x"]).alias(name))
    both = listed(facts, "ordinal", fact, "facts").join(listed(claims, "target", claim, "claims"), "page_id")
    return both.select("page_id", text("page_id", "facts", "claims").alias("report"))


def report_faults(value: object) -> list[str]:
    """What is wrong with a parsed report, by itself: version, checksum, facts out of their bounds or repeated, claims without
    evidence or with other words than what they cite."""
    if not isinstance(value, dict) or value.get("schemaVersion") != REPORT_VERSION:
        return ["version"]
    body = {k: v for k, v in value.items() if k != "checksum"}
    faults = [] if value.get("checksum") == hash_value(body) else ["checksum"]
    facts = value.get("sourceFacts")
    if not isinstance(facts, list) or not isinstance(value.get("claims"), list):
        return [*faults, "shape"]
    quotes = {f.get("id"): f.get("quote") for f in facts if isinstance(f, dict)}
    if len(quotes) != len(facts):
        faults.append("repeated fact")
    for f in facts:
        units = len(str(f.get("quote", "")).encode("utf-16-le", "surrogatepass")) // 2
        if not (isinstance(f.get("startOffset"), int) and 0 <= f["startOffset"] < f.get("endOffset", -1) and f["endOffset"] - f["startOffset"] == units):
            faults.append("fact bounds")
            break
    if any(c.get("evidenceId") not in quotes for c in value["claims"]):
        faults.append("unknown evidence")
    if any(c.get("evidenceId") in quotes and c.get("text") != quotes[c["evidenceId"]] for c in value["claims"]):
        faults.append("claim text")
    return faults


def parsed_reports(reports: DataFrame) -> DataFrame:
    """reports (page_id, report) read and validated: page_id, n_facts, n_claims, faults (empty for a valid report). What isn't JSON
    has the one fault json."""

    @F.pandas_udf("n_facts int, n_claims int, faults string")
    def read(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            try:
                value = json.loads(t)
            except (TypeError, ValueError):
                out.append((0, 0, "json"))
                continue
            size = lambda k: len(value.get(k) or []) if isinstance(value, dict) else 0  # noqa: B023, E731
            out.append((size("sourceFacts"), size("claims"), ",".join(report_faults(value))))
        return pd.DataFrame(out, columns=["n_facts", "n_claims", "faults"])

    return reports.select("page_id", read("report").alias("r")).select("page_id", "r.*")


def page_snapshots(paragraphs: DataFrame, urls: DataFrame) -> DataFrame:
    """paragraphs (page_id, ordinal, paragraph_id, text) and urls (page_id, url): page_id and snapshot_id, the hash of the page as
    canonical JSON."""

    @F.pandas_udf("string")
    def digest(url: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([hash_value({"url": u, "images": [], "paragraphs": [{"id": x["paragraph_id"], "text": x["text"]} for x in sorted(xs, key=lambda x: x["ordinal"])]}) for u, xs in zip(url, items, strict=True)])

    listed = paragraphs.groupBy("page_id").agg(F.collect_list(F.struct("ordinal", "paragraph_id", "text")).alias("items"))
    return listed.join(urls, "page_id").select("page_id", digest("url", "items").alias("snapshot_id"))
