"""Text functions as columns: normal forms, tokens, content hashes and identities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the questions' normal form sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: A token: an identifier, word or number with inner - or _, or a run of Han characters.
TOKEN = r"([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*|[㐀-鿿]+)"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Unicode normal form C, for which there is no built-in; null stays null."""
    return _nfc(c)


def squeezed(c: Column) -> Column:
    """``c`` with every run of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normal_question(c: Column) -> Column:
    """A question's normal form: NFC and single spaces; letter case counts."""
    return squeezed(nfc(c))


def tokens(c: Column) -> Column:
    """Tokens of a question's normal form in order, repeats included: identifiers whole, Han runs as characters, then adjacent pairs; null gives an empty array."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), 1)
    chars = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(w, i, F.lit(1)))
    pairs = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[㐀-鿿]"), F.concat(chars(w), pairs(w))).otherwise(F.array(w))))


def normal_content(c: Column) -> Column:
    """Content for hashing: NFC, line feeds only, no white space at line ends and outer ends."""
    lines = F.regexp_replace(F.regexp_replace(nfc(c), r"\r\n?", "\n"), r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")
    return F.regexp_replace(lines, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def content_sha(c: Column) -> Column:
    """SHA-256 of the normal content; null stays null."""
    return F.sha2(normal_content(c), 256)


def json_text(c: Column) -> Column:
    """``c`` as a JSON string, every control character escaped."""
    escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    for raw, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        escaped = F.replace(escaped, F.lit(raw), F.lit("\\" + name))
    others = escaped
    for code in range(32):
        if chr(code) not in "\n\r\t\b\f":
            others = F.replace(others, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(escaped.rlike(r"[\x00-\x1f]"), others).otherwise(escaped), F.lit('"'))


def identity(kind: str, *parts: Column, occurrence: Column) -> Column:
    """SHA-256 of the JSON array [kind, parts..., occurrence], so equal content in another place has another id."""
    items = [F.lit(f'"{kind}"'), *(json_text(p) for p in parts), occurrence.cast("string")]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")), 256)


def finite(c: Column) -> Column:
    """Whether a score is a number proper: not null, NaN or infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
