"""Text functions as Column expressions: normalising, tokens, lexical extractors, escaping, gates, sniffing."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# White space of the page contract, stop words, scripts that are indexed by n-grams.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
STOP_WORDS = "a an and are as at be by for from how in is it of on or that the this to was what when where which who with".split()
CJK = "[\\u1100-\\u11FF\\u2E80-\\u303F\\u3040-\\u30FF\\u3130-\\u318F\\u31F0-\\u31FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uA960-\\uA97F\\uAC00-\\uD7FF\\uF900-\\uFAFF]"

# What the claim audit looks for. Word boundaries are ASCII ones, spelled out because Java's are not.
_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_W = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
UNITS = "kg|mg|g|km|cm|mm|m|ms|s|hours?|minutes?|seconds?|days?|USD|EUR|JPY|kilograms?|kilomet(?:er|re)s?|met(?:er|re)s?"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
NEGATIONS = "not|never|no|without|cannot|can't|doesn't|didn't|isn't|wasn't"
# Groups that repeat keep what they took: Java comes back to each round of others by recursion, and overflows on long runs. An
# entity's further words are looked at ahead, as one before an underscore has no boundary.
_NAME = "[A-Z][\\p{L}\\p{N}]*"
AUDIT = {
    "numbers": "[+-]?[0-9]++(?:[,.][0-9]++)*+(?:%|％)?",
    "units": f"(?i){_L}(?:{UNITS}){_R}|°[CF]|公斤|公里|公尺|毫秒|小時|分鐘|美元|元|%|％",
    "dates": f"(?i){_L}[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}{_R}|{_L}(?:{MONTHS})\\s+[0-9]{{1,2}}(?:,?\\s+[0-9]{{4}})?{_R}|[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日",
    "entities": f"{_L}(?:{_NAME}+\\s++(?={_NAME}{_W}))*+{_NAME}{_W}",
    "negation": f"(?i){_L}(?:{NEGATIONS}){_R}|並非|不是|沒有|未曾|不會|不",
    "ranges": "(?i)(?<![0-9])[0-9]+(?:\\.[0-9]+)?\\s*(?:[-–—]|to|至|到)\\s*[0-9]+(?:\\.[0-9]+)?",
}


def normalize(text: Column) -> Column:
    """White space, no-break spaces included, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, which offsets count in."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def slice_utf16(text: Column, start: Column, end: Column) -> Column:
    """Units [start, end) of a text."""
    return F.decode(F.substring(F.encode(text, "UTF-16BE"), 2 * start + 1, 2 * (end - start)), "UTF-16BE")


_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SCRIPT = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}]+")


def terms_of(text: str | None) -> list[str]:
    """Terms of any text: NFKC, lower case, runs of letters and digits without stop words; of a run the pieces in Han, kana or
    Hangul give each character and adjacent pair, and the pieces between them stand alone."""
    out = []
    for word in _WORD.findall(unicodedata.normalize("NFKC", text or "").lower()):
        at = 0
        for m in _SCRIPT.finditer(word):
            out += [word[at : m.start()], *(x for i, c in enumerate(m[0]) for x in (m[0][i - 1 : i + 1] if i else "", c))]
            at = m.end()
        out.append(word[at:])
    return [x for x in out if x and x not in STOP_WORDS]


#: For ASCII texts each character or a blank; for others, when first met, each code point or a blank, and which ones are scripts of n-grams.
_STOP, _ASCII = frozenset(STOP_WORDS), "".join(chr(i).lower() if chr(i).isalnum() else " " for i in range(128))
_POINTS: dict[str, np.ndarray] = {}


def _points() -> dict[str, np.ndarray]:
    if not _POINTS:
        every = "".join(" " if 0xD800 <= i < 0xE000 else chr(i) for i in range(0x110000))
        kept, script = np.full(len(every), 32, np.uint32), np.zeros(len(every), bool)
        for m in _WORD.finditer(every):
            kept[m.start() : m.end()] = np.arange(m.start(), m.end())
        for m in _SCRIPT.finditer(every):
            script[m.start() : m.end()] = True
        _POINTS.update(kept=kept, script=script)
    return _POINTS


def quick_terms(text: str | None) -> list[str]:
    """The terms of terms_of, by a table of code points instead of patterns where no run holds Han, kana or Hangul."""
    text = text or ""
    if text.isascii():
        return [x for x in text.translate(_ASCII).split() if x not in _STOP]
    low = (text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()
    at, points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), _points()
    if points["script"][at].any():
        return terms_of(text)
    return [x for x in points["kept"][at].tobytes().decode("utf-32-le").split() if x not in _STOP]


@F.pandas_udf(ArrayType(StringType()))
def general_terms(text: pd.Series) -> pd.Series:
    return text.map(quick_terms)


def with_terms(df: DataFrame, text: str = "text", out: str = "terms") -> DataFrame:
    """Adds the terms, in one scan."""
    return df.withColumn(out, general_terms(F.col(text)))


def audit_values(text: Column, kind: str) -> Column:
    """Distinct values of an audit kind, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({AUDIT[kind]})"), 1))


_BESIDE = f"[^{SPACE[1:-1]},;:()\".!?。！？]"  # next to anything else a pattern may begin or end
_UNTOUCHED = f"(?<!{_BESIDE})(?!(?i:{UNITS}|{MONTHS}|{NEGATIONS}|to)(?!{_BESIDE}))([a-z]+)(?!{_BESIDE})"


def untouched_words(text: Column) -> Column:
    """Words in lower-case ASCII that no audit pattern can match a part of: texts alike but for a kind's values have the same."""
    return F.regexp_extract_all(text, F.lit(_UNTOUCHED), 1)


def untouched_ends(text: Column) -> list[Column]:
    """The first and the last of a text's untouched words, or empty: found without a look at what stands between."""
    return [F.regexp_extract(text, _UNTOUCHED, 1), F.regexp_extract(text, f"(?s)^.*{_UNTOUCHED}", 1)]


#: Negations that may stand inside a word, so that words on both sides meet where they are taken out.
JOINING = "[並不沒未]"


def sentence_key(text: Column) -> Column:
    """A sentence for comparison: white space collapsed, end marks off."""
    return F.regexp_replace(normalize(text), "(?<![.!?。！？])[.!?。！？]++$", "")


def markdown_text(text: Column) -> Column:
    """Escapes a text for Markdown; line ends become hard breaks."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "\\\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, "([`*_{}\\[\\]()#+.!|>])", "\\\\$1")
    return F.replace(F.regexp_replace(text, "\\r\\n?", "\n"), F.lit("\n"), F.lit("  \n"))


def markdown_url(url: Column) -> Column:
    """The URL if it is http or https, its brackets percent-encoded; else null."""
    safe = F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return F.when(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), safe)


def script_counts(text: Column) -> dict[str, Column]:
    return {
        "han": F.regexp_count(text, F.lit("\\p{IsHan}")),
        "latin": F.regexp_count(text, F.lit("\\p{IsLatin}")),
        "latin_words": F.regexp_count(text, F.lit("\\p{IsLatin}+")),
    }


#: Fixed value: characters that traditional Chinese doesn't use.
SIMPLIFIED = "[这为与个从们来时会说对国学实应现过还进种无点开关颜红蓝]"


def language_ok(text: Column, language: str) -> Column:
    """Whether a text passes the script check of a language (zh-tw, en, en-*; others always do)."""
    n, language = script_counts(text), language.lower()
    if language == "zh-tw":
        return (n["han"] > 0) & (n["latin_words"] * 2 <= n["han"]) & ~text.rlike(SIMPLIFIED)
    if language == "en" or language.startswith("en-"):
        return (n["latin"] > 0) & (n["han"] <= n["latin"])
    return F.lit(True)


def negated_before(text: Column, index: Column) -> Column:
    """Whether a word of negation stands at most three words before a position (from 0), in the same clause."""
    clause = F.regexp_extract(F.substring(text, F.lit(1), index), "([^.!?;]*)$", 1)
    return clause.rlike(f"(?i){_L}(?:no|not|never|without|neither|zero){_R}(?:\\s+[\\p{{L}}-]+){{0,3}}\\s*$")


def image_kind(content: Column) -> Column:
    """Raster type by the leading bytes."""
    hexed = F.hex(F.substring(content, 1, 12))
    return (
        F.when(hexed.startswith("89504E470D0A1A0A"), "image/png").when(hexed.startswith("FFD8FF"), "image/jpeg")
        .when(hexed.startswith("52494646") & (F.substring(hexed, 17, 8) == "57454250"), "image/webp").when(hexed.startswith("474946383761") | hexed.startswith("474946383961"), "image/gif")
        .when(hexed.startswith("424D"), "image/bmp").when(hexed.startswith("49492A00") | hexed.startswith("4D4D002A"), "image/tiff")
        .when((F.substring(hexed, 9, 8) == "66747970") & F.substring(hexed, 17, 8).isin("61766966", "61766973"), "image/avif")
    )


def base64_ok(text: Column) -> Column:
    """Whether a text is canonical base64: it decodes and encodes to itself."""
    shape = text.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return shape & (F.replace(F.base64(F.try_to_binary(text, F.lit("base64"))), F.lit("\r\n"), F.lit("")) == text)


def data_url(url: Column) -> dict[str, Column]:
    """Type and bytes of a base64 data URL, null for anything else."""
    body = F.regexp_extract(url, "(?i)^data:[^,]*;base64,(.*)$", 1)
    ok = url.rlike("(?i)^data:[^,]*;base64,") & base64_ok(body)
    return {"type": F.when(ok, F.lower(F.regexp_extract(url, "(?i)^data:([^;,]*)", 1))), "content": F.when(ok, F.try_to_binary(body, F.lit("base64")))}


def before_stop(text: Column, stops: list[str]) -> Column:
    """The text up to the first of the stop strings."""
    at = F.least(*(F.when(F.instr(text, s) > 0, F.instr(text, s)).otherwise(F.length(text) + 1) for s in stops), F.length(text) + 1)
    return F.substring(text, F.lit(1), at - 1)
