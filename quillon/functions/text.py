"""Column functions on strings: cleaning, validation, extraction and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
#: Street abbreviations, applied in this order to lower-case text.
ABBREVIATIONS = {
    "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "rd": "road",
    "ct": "court", "pl": "place", "apt": "apartment", "ste": "suite", "fl": "floor", "hwy": "highway",
}
#: UTF-8 read as Latin-1, and what it was, replaced in this order.
MOJIBAKE = {"â€™": "'", "â€œ": '"', "â€": '"', 'â€"': "-", "â€¢": "•", "Ã©": "é", "Ã¨": "è", "\x00": "", "\ufeff": ""}
#: Words that mean yes and no.
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1", "on"), ("false", "f", "no", "n", "0", "off")


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _capital(letter: Column) -> Column:
    return F.when(letter == "ß", "Ss").otherwise(F.upper(letter))


def title(c: Column) -> Column:
    """Capitals after every non-letter, as in O'Neil and Mary-Ann."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.concat(_capital(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))), "")


def normal_form(c: Column, form: str = "NFKD") -> Column:
    """The text in a Unicode normal form."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.str.normalize(form)

    return run(c)


def strip_accents(c: Column) -> Column:
    """Without combining marks, after compatibility decomposition."""
    return F.regexp_replace(normal_form(c), r"\p{M}", "")


def to_ascii(c: Column) -> Column:
    """Compatibility decomposition, then without all that isn't ASCII."""
    return F.regexp_replace(normal_form(c), r"[^\x00-\x7F]", "")


def unescape(c: Column) -> Column:
    """All character references of HTML decoded."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from html import unescape as decode

        for part in parts:
            yield part.map(decode, na_action="ignore")

    return run(c)


def strip_html(c: Column) -> Column:
    """Without tags; character references are decoded first."""
    return F.regexp_replace(unescape(c), "<[^>]+>", "")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+|www\.\S+", "")


def strip_emails(c: Column) -> Column:
    return F.regexp_replace(c, r"\S+@\S+\.\S+", "")


def strip_special(c: Column, keep: str = "") -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9\\s" + "".join("\\" + k for k in keep) + "]", "")


def fix_encoding(c: Column) -> Column:
    for wrong, right in MOJIBAKE.items():
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def expand_abbreviations(c: Column) -> Column:
    c = F.lower(c)
    for short, full in ABBREVIATIONS.items():
        c = F.regexp_replace(c, rf"\b{short}\.?\b", full)
    return c


def clean(c: Column, kind: str) -> Column:
    """A cleaning pipeline by kind of text: name, address, description or code."""
    if kind == "name":
        return strip_accents(title(strip_special(squeeze(c), "-'")))
    if kind == "address":
        return title(expand_abbreviations(squeeze(c)))
    if kind == "description":
        return squeeze(strip_urls(strip_html(fix_encoding(c))))
    if kind == "code":
        return F.regexp_replace(F.upper(F.trim(c)), r"\s+", "")
    raise ValueError(f"no cleaning pipeline {kind!r}")


def phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    ten = lambda d: F.concat(F.lit("("), F.substr(d, F.lit(1), F.lit(3)), F.lit(") "), F.substr(d, F.lit(4), F.lit(3)), F.lit("-"), F.substr(d, F.lit(7), F.lit(4)))
    return F.when(F.length(digits) == 10, ten(digits)).when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+1 "), ten(F.substr(digits, F.lit(2))))).otherwise(c)


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(URL), F.lit(False))


def is_phone(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"\D", "")).between(10, 15), F.lit(False))


def strong_password(c: Column) -> Column:
    return F.coalesce(c.rlike("[A-Z]") & c.rlike("[a-z]") & c.rlike("[0-9]") & (F.length(c) >= 8), F.lit(False))


def extract_first(c: Column, pattern: str, default: str, prefix: str = "") -> Column:
    """First group of the first match, else the default; with a prefix."""
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.lit(default)))


def match_key(c: Column) -> Column:
    """Text for comparison: lower case, no punctuation, single spaces; null is empty."""
    return F.coalesce(squeeze(F.regexp_replace(F.lower(c), r"[^\w\s]", "")), F.lit(""))


def as_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def as_number(c: Column) -> Column:
    """Numbers with currency signs, grouping commas and per cent signs; null where it is none."""
    bare = F.regexp_replace(c, r"[$€£¥,%\s]", "")
    return bare.try_cast("double") / F.when(F.trim(c).endswith("%"), 100).otherwise(1)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\w\s]", " ")), r"\s+"), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]"), lambda x: F.trim(x)), lambda x: x != "")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, 0 to 1."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def _jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    own = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                own.append(ch)
                break
    if not own:
        return 0.0
    other = [ch for ch, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(own, other, strict=True)) / 2
    m = len(own)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([_jaro_winkler(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return score(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - insertions and deletions over both lengths)."""

    @F.pandas_udf("double")
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            out = []
            for p, q in zip(x, y, strict=True):
                p, q = p or "", q or ""
                row = [0] * (len(q) + 1)
                for ch in p:
                    last = 0
                    for j, other in enumerate(q):
                        keep = row[j + 1]
                        row[j + 1] = last + 1 if ch == other else max(row[j + 1], row[j])
                        last = keep
                out.append(100.0 if not p and not q else 200.0 * row[-1] / (len(p) + len(q)))
            yield pd.Series(out)

    return ratio(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    order = lambda c: F.array_join(F.array_sort(tokens(c)), " ")
    return indel_ratio(order(a), order(b))
