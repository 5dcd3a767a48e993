"""Evidence: paragraphs and offsets, fact ledgers, claim audits, coverage, extractive reports and their Markdown."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.canonical import canonical_struct
from ..functions.text import AUDIT, JOINING, SPACE, audit_values, markdown_text, normalize, sentence_key, slice_utf16, untouched_ends, untouched_words, utf16_length

#: Joins the paragraphs of a page when it becomes a document.
SEPARATOR = "\n\n"


def paragraphs_of_lines(docs: DataFrame) -> DataFrame:
    """(page_id, ordinal from 1, paragraph_id, text): each non-blank line of a document as a paragraph.

    White space is collapsed in the whole text, line ends apart, then around line ends. The outer generator keeps the planner from
    making the lines twice more for a filter that a document has some."""
    collapsed = F.regexp_replace(F.regexp_replace("text", f"[{SPACE[1:-1]}&&[^\n]]+", " "), " ?\n[ \n]*", "\n")
    lines = docs.select(F.col("doc_id").alias("page_id"), F.split(F.trim(collapsed, F.lit(" \n")), "\n").alias("lines"))
    cut = lines.select("page_id", F.posexplode_outer("lines").alias("at", "text")).where("text <> ''")
    return cut.select("page_id", (F.col("at") + 1).alias("ordinal"), F.concat(F.lit("p"), F.col("at") + 1).alias("paragraph_id"), "text")


def with_offsets(paragraphs: DataFrame) -> DataFrame:
    """Adds start and end of each paragraph in its page's document: a running sum of lengths and separators."""
    before = Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(utf16_length(F.col("text")) + len(SEPARATOR)).over(before), F.lit(0)).cast("int")
    return paragraphs.withColumn("start", start).withColumn("end", start + utf16_length(F.col("text")))


def document_from_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(page_id, text): paragraphs in order, joined by a blank line."""
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "text")))
    return paragraphs.groupBy("page_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), SEPARATOR).alias("text"))


def with_heading(paragraphs: DataFrame, is_heading: Column) -> DataFrame:
    """Adds the last heading at or before each paragraph of its page."""
    past = Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("heading", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(past))


def fill_gaps(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """ranges (doc_id, name, start, end) and the gaps between them up to each document's length, gaps with a null name."""
    by = Window.partitionBy("doc_id").orderBy("start")
    known = lengths.join(ranges, "doc_id", "left")
    before = known.where("start is not null").select("doc_id", F.lit(None).cast("string").alias("name"), F.coalesce(F.lag("end").over(by), F.lit(0)).alias("a"), F.col("start").alias("b"))
    last = known.groupBy("doc_id").agg(F.coalesce(F.max("end"), F.lit(0)).alias("a"), F.first("length").alias("b")).select("doc_id", F.lit(None).cast("string").alias("name"), "a", "b")
    gaps = before.unionByName(last).where("a < b").select("doc_id", "name", F.col("a").alias("start"), F.col("b").alias("end"))
    return ranges.select("doc_id", "name", "start", "end").unionByName(gaps)


def ledger_breaks(facts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Facts or paragraphs where the ledger isn't a gap-free tiling by exact quotes, offsets in UTF-16 units: (page_id,
    paragraph_id, reason)."""
    joined = facts.join(paragraphs.select("page_id", "paragraph_id", "text"), ["page_id", "paragraph_id"], "left")
    by = Window.partitionBy("page_id", "paragraph_id").orderBy("start")
    checked = joined.withColumn("was", F.coalesce(F.lag("end").over(by), F.lit(0))).withColumn("next", F.lead("start").over(by))
    length = utf16_length(F.col("text"))
    cut = F.when(F.col("end") <= length, slice_utf16(F.col("text"), F.col("start"), F.col("end"))).otherwise("")
    reason = (
        F.when(F.col("text").isNull(), "unknown paragraph").when(F.col("start") != F.col("was"), "gap or overlap").when(F.col("end") <= F.col("start"), "empty")
        .when(cut != F.col("quote"), "quote differs").when(F.col("next").isNull() & (F.col("end") != length), "does not reach the end")
    )
    missing = paragraphs.join(facts.select("page_id", "paragraph_id").distinct(), ["page_id", "paragraph_id"], "left_anti").select("page_id", "paragraph_id", F.lit("no fact").alias("reason"))
    return checked.withColumn("reason", reason).where("reason is not null").select("page_id", "paragraph_id", "reason").unionByName(missing)


def span_breaks(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets whose claims overlap, leave more than white space uncovered or run past the end, offsets in UTF-16 units: (target,
    reason)."""
    by = Window.partitionBy("target").orderBy("start")
    joined = claims.join(targets, "target").withColumn("was", F.coalesce(F.lag("end").over(by), F.lit(0))).withColumn("next", F.lead("start").over(by))
    length = utf16_length(F.col("text"))
    blank = lambda a, b: normalize(slice_utf16(F.col("text"), a, b)) == ""
    reason = (
        F.when(F.col("start") < F.col("was"), "overlap").when((F.col("start") > F.col("was")) & ~blank(F.col("was"), F.col("start")), "gap")
        .when(F.col("end") > length, "past the end").when(F.col("next").isNull() & (F.col("end") < length) & ~blank(F.col("end"), length), "tail")
    )
    return joined.withColumn("reason", reason).where("reason is not null").select("target", "reason")


_MARKS = re.compile(r"([.!?。！？]+)[\"'”’)\]]*(\s+|$)?")


def split_sentences(text: str | None) -> list[str]:
    """Sentences with their end marks; a rule of our own that holds for any language with these marks. What ends at marks without
    white space behind them is not a sentence. One pass, whatever stands between the marks."""
    text, out, at = text or "", [], 0
    for m in _MARKS.finditer(text):
        if m[2] is None:
            at = m.end(1)
        else:
            out.append(text[at : m.end()])
            at = m.end()
    out.append(text[at:])
    return [s.strip() for s in out if s.strip()]


@F.pandas_udf(ArrayType(StringType()))
def sentences(text: pd.Series) -> pd.Series:
    return text.map(split_sentences)


def _masked(text: Column, kind: str) -> Column:
    return sentence_key(F.regexp_replace(text, AUDIT[kind], "" if kind == "negation" else "\u0001"))


def audit_pair(claim: Column, candidate: Column) -> dict[str, Column]:
    """For each kind whether claim and candidate conflict: alike but for one value of the kind, or for words of negation. Values
    are held against each other first, as most pairs have the same and then needn't be masked."""
    out = {}
    for kind in AUDIT:
        a, b = audit_values(claim, kind), audit_values(candidate, kind)
        alike = _masked(claim, kind) == _masked(candidate, kind)
        if kind == "negation":
            out[kind] = ((F.size(a) > 0) != (F.size(b) > 0)) & alike
        else:
            out[kind] = (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 1) & (F.size(F.array_except(b, a)) == 1) & alike
    return out


def audit_claims(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """claims (claim_id, claim) against valid quotes (claim_id, quote): claim_id, status and a status for each kind.

    supported: the claim is part of a quote; contradicted: a quote or a sentence of one conflicts; unknown otherwise. A kind
    is a conflict, absent (the claim has none), matched (supported) or unresolved. Candidates whose words that no pattern can
    touch differ from the claim's can't conflict and are passed over before the patterns are tried.
    """
    hit = F.coalesce((F.length("claim") > 0) & F.contains(F.col("quote"), F.col("claim")), F.lit(False))
    first, last = untouched_ends(F.col("claim"))
    known = claims.select("*", first.alias("first"), last.alias("last"), untouched_words(F.col("claim")).alias("words"), F.col("claim").rlike(JOINING).alias("joins"))
    joined = known.join(quotes, "claim_id", "left").withColumn("hit", hit)
    held = joined.groupBy("claim_id", "claim").agg(F.bool_or("hit").alias("exact"))
    sought = joined.where(~F.col("hit")).withColumn("candidate", F.explode_outer(F.array_distinct(F.concat(F.array("quote"), F.coalesce(sentences("quote"), F.array().cast("array<string>"))))))
    first, last = untouched_ends(F.col("candidate"))  # most candidates differ there, and are cut into words no further
    same = (F.col("first") == first) & (F.col("last") == last) & (F.col("words") == untouched_words(F.col("candidate")))
    like = same | F.col("joins") | F.col("candidate").rlike(JOINING)  # no conflict is lost
    flags = [F.bool_or(F.coalesce(c, F.lit(False))).alias(f"x_{k}") for k, c in audit_pair(F.col("claim"), F.col("candidate")).items()]
    found = sought.where(like).groupBy("claim_id").agg(*flags)
    none = [F.coalesce(f"x_{k}", F.lit(False)).alias(f"x_{k}") for k in AUDIT]
    per = held.join(found, "claim_id", "left").select("claim_id", "claim", "exact", *none)
    conflict = {k: ~F.col("exact") & F.col(f"x_{k}") for k in AUDIT}
    status = F.when(F.col("exact"), "supported").when(reduce(Column.__or__, conflict.values()), "contradicted").otherwise("unknown")
    kinds = [F.when(conflict[k], "conflict").when(F.size(audit_values(F.col("claim"), k)) == 0, "absent").when(F.col("exact"), "matched").otherwise("unresolved").alias(k) for k in AUDIT]
    return per.select("claim_id", status.alias("status"), *kinds)


def source_facts(paragraphs: DataFrame) -> DataFrame:
    """The extractive ledger: each paragraph as one fact q1..qn of its page."""
    version = F.sha2(canonical_struct({"id": F.col("paragraph_id"), "text": F.col("text")}), 256)
    return paragraphs.select("page_id", "ordinal", F.concat(F.lit("q"), F.col("ordinal")).alias("fact_id"), "paragraph_id", version.alias("version_id"), F.lit(0).alias("start"), utf16_length(F.col("text")).alias("end"), F.col("text").alias("quote"))


def extractive_claims(facts: DataFrame) -> DataFrame:
    """Claims of an extractive report: a key point for each fact, the summary from the first, the conclusion from the last.

    The order of a page's facts is its only key, and n + 2 claims stand in it."""
    by = Window.partitionBy("page_id")
    marked = facts.withColumn("n", F.max("ordinal").over(by)).withColumn("low", F.min("ordinal").over(by))
    target = F.explode(
        F.array_compact(
            F.array(
                F.concat(F.lit("sections."), F.col("ordinal"), F.lit(".keyPoints.1")),
                F.when(F.col("ordinal") == F.col("low"), "page.summary"),
                F.when(F.col("ordinal") == F.col("n"), "conclusion"),
            )
        )
    )
    return marked.select("page_id", target.alias("target"), "fact_id", "paragraph_id", "start", "end", F.col("quote").alias("text"), F.lit("supported").alias("status"))


def report_coverage(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """(page_id, quotes, characters, claims, summary_facts): what an extractive report retains."""
    kept = facts.groupBy("page_id").agg(F.count(F.lit(1)).alias("quotes"), F.sum(F.col("end") - F.col("start")).alias("characters"))
    cited = claims.groupBy("page_id").agg(F.count(F.lit(1)).alias("claims"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("target") == "page.summary", F.col("fact_id")))), ",").alias("summary_facts"))
    return kept.join(cited, "page_id")


def markdown_lines(facts: DataFrame, *more: str) -> DataFrame:
    """(page_id, ordinal, line) and further columns: the ledger section of the Markdown report."""
    line = F.concat(F.lit("- "), markdown_text(F.col("fact_id")), F.lit(" ("), markdown_text(F.col("paragraph_id")), F.lit(":"), F.col("start"), F.lit("–"), F.col("end"), F.lit(") — "), markdown_text(F.col("quote")))
    return facts.select("page_id", "ordinal", line.alias("line"), *more)


def render_markdown(pages: DataFrame, facts: DataFrame, claims: DataFrame) -> DataFrame:
    """(page_id, markdown): the whole extractive report of each page: summary, key points, conclusion, ledger, coverage, audits."""
    of = lambda t: F.max(F.when(F.col("target") == t, F.col("text")))
    section = F.regexp_extract("target", "^sections\\.([0-9]+)", 1).try_cast("int")
    claims = claims.withColumn("place", F.when(F.col("target") == "page.summary", -1).when(F.col("target") == "conclusion", F.lit(2**31 - 1)).otherwise(F.coalesce(section, F.lit(2**31 - 2))))
    ends = claims.groupBy("page_id").agg(of("page.summary").alias("summary"), of("conclusion").alias("conclusion"), F.sort_array(F.collect_list(F.struct("place", "target", "status"))).alias("audits"))
    lines = markdown_lines(facts, "quote", "paragraph_id")
    listed = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "line", "quote", "paragraph_id"))).alias("rows"))
    row = lambda f: F.array_join(F.transform("rows", f), "\n")
    points = row(lambda x: F.concat(F.lit("- "), markdown_text(x["quote"]), F.lit("\n\n_Source: "), markdown_text(x["paragraph_id"]), F.lit("_\n")))
    audits = F.array_join(F.transform("audits", lambda x: F.concat(F.lit("- "), markdown_text(x["target"]), F.lit(": "), x["status"])), "\n")
    n, chars = F.size("rows"), F.aggregate("rows", F.lit(0), lambda a, x: a + utf16_length(x["quote"]))
    parts = [
        F.lit("# "), markdown_text(F.coalesce("title", "url")), F.lit("\n\n## Summary\n\n"), markdown_text(F.col("summary")), F.lit("\n\n## Key points\n\n"), points, F.lit("\n## Conclusion\n\n"), markdown_text(F.col("conclusion")),
        F.lit("\n\n## Retained source quotes (verbatim, untrusted)\n\n"), row(lambda x: x["line"]), F.lit("\n\n## Source coverage\n\n"), chars, F.lit("/"), chars, F.lit(" UTF-16; "), n, F.lit(" quotes; model citations 0; summary citations 1.\n\n"), audits, F.lit("\n"),
    ]
    return pages.join(listed, "page_id").join(ends, "page_id").select("page_id", F.concat(*parts).alias("markdown"))


def attempt_breaks(attempts: DataFrame) -> DataFrame:
    """attempts (run_id, stage, attempt, ok): stages whose numbers aren't 1..n or that have not exactly one success, the last."""
    by = Window.partitionBy("run_id", "stage").orderBy("attempt")
    numbered = attempts.withColumn("turn", F.row_number().over(by))
    per = numbered.groupBy("run_id", "stage").agg(F.bool_and(F.col("turn") == F.col("attempt")).alias("in_order"), F.count_if("ok").alias("wins"), F.max_by("ok", "attempt").alias("last_ok"))
    return per.where(~F.col("in_order") | (F.col("wins") != 1) | ~F.col("last_ok"))
