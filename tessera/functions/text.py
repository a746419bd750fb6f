"""Text functions as Columns; only Unicode normalisation and folding need an Arrow function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code point ranges that count as CJK, kana and hangul.
CJK = r"\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af"
KANA = r"\u3040-\u30ff\u31f0-\u31ff"
HANGUL = r"\uac00-\ud7af\u1100-\u11ff"
SPLIT = r"(?U)[\s,\uff0c\u3001]+"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def fold_words(values: pd.Series) -> pd.Series:
    """Lower case without diacritics."""
    def fold(v: str) -> str:
        return v.lower() if v.isascii() else "".join(c for c in unicodedata.normalize("NFD", v.lower()) if not unicodedata.combining(c))

    return values.map(fold, na_action="ignore")


_ESCAPE = re.compile(r"\\(r\\n|n|['\"\\])")


def _unescape(v: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] in ("n", "r\\n") else m[1], v) if "\\" in v else v


@F.pandas_udf(StringType())
def decode_escapes(values: pd.Series) -> pd.Series:
    """Stored escapes for line breaks, quotes and backslashes, in a single pass."""
    return values.map(_unescape, na_action="ignore")


def clean_text(c: Column, normalised: bool = False) -> Column:
    """NFKC, zero-width marks out, white space to single blanks; null becomes empty."""
    text = F.coalesce(c, F.lit("")) if normalised else F.coalesce(nfkc(c), F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.translate(text, "\u200b\ufeff", ""), r"(?U)\s+", " "), "^ | $", "")


def clean_multiline(c: Column) -> Column:
    """Like ``clean_text``, but line breaks stay (at most one blank line) and stored escapes are decoded."""
    text = F.regexp_replace(F.translate(decode_escapes(nfkc(F.coalesce(c, F.lit("")))), "\u200b", ""), r"\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]", "\n")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def split_query_tokens(c: Column) -> Column:
    return F.filter(F.split(clean_text(c), SPLIT), lambda x: x != "")


def is_cjk(c: Column) -> Column:
    return c.rlike(f"^[{CJK}]+$")


def cjk_grams(c: Column) -> Column:
    """Distinct single characters and pairs of every CJK run, in order of occurrence."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"([{CJK}]+)"), F.lit(1))

    def of_run(r: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.when(
            i < F.length(r), F.array(F.substr(r, i, F.lit(1)), F.substr(r, i, F.lit(2)))).otherwise(F.array(F.substr(r, i, F.lit(1))))))

    grams = F.array_distinct(F.flatten(F.transform(runs, of_run)))
    return F.when(F.coalesce(c, F.lit("")).rlike(f"[{CJK}]"), grams).otherwise(F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """Distinct folded words outside CJK runs."""
    text = F.coalesce(c, F.lit(""))
    wide = text.rlike(r"[^\x00-\x7f]")  # only such texts have CJK runs, or letters that Python must fold
    folded = F.when(wide, fold_words(F.when(wide, F.regexp_replace(text, f"[{CJK}]+", " ")))).otherwise(F.lower(text))  # runs go before folding takes syllables apart
    return F.array_distinct(F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != ""))


def content_language(c: Column) -> Column:
    return F.when(c.rlike(f"[{KANA}]"), "ja").when(c.rlike(f"[{HANGUL}]"), "ko")


def highlight(c: Column, terms: list[str]) -> Column:
    """Escapes the text for HTML and marks the terms, longest first, whatever their case."""
    text = F.coalesce(c, F.lit(""))
    needles = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if needles:
        pattern = "|".join(re.escape(t).replace("\\ ", " ") for t in needles)
        text = F.regexp_replace(F.translate(text, "\ue000\ue001", ""), f"(?iu)({pattern})", "\ue000$1\ue001")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\ue000", "<mark>"), ("\ue001", "</mark>")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
