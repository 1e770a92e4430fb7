"""One consistent form for values that look the same but differ in characters.

Two rules and one table turn a value into its look-alike form: width, font and
ligature variants follow the Unicode decompositions; characters that show
nothing vanish; letters and signs drawn alike share the Latin or plain one.
Then values are grouped in SQL under the accent- and case-sensitive ``UNICODE``
collation, which also equates the encodings of one accent. Every class gets a
deterministic canonical member, which is joined back to the rows.

Only distinct values are mapped and grouped; the rows meet the classes in one
salted join, so a value that holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs and letters drawn like the one at the start of the line.
DRAWN_ALIKE = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ",
    "M": "МΜᎷϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᏔ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "սυ",
    "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "æ": "ӕ", "ə": "ә",
    "-": "‐‑‒–—―−⁃˗﹘﹣─", "/": "⁄∕╱", ".": "․", ":": "ː∶", "_": "ˍ", "'": "’‘ʼ′", '"': "”“″", "~": "∼",
    "Δ": "∆", "Ø": "∅⌀", "ß": "β", "µ": "μ", "°": "˚º", "Σ": "∑", "Π": "∏",
    "カ": "力", "ニ": "二", "ロ": "口", "エ": "工", "ト": "卜", "タ": "夕", "ハ": "八", "ヘ": "へ",
}

#: Characters that show as a space.
SPACES = r"[\p{Zs}\t\n\x0B\f\r\x85\u2028\u2029\u2800]"
#: Characters that show nothing.
UNSEEN = r"[\p{Cf}\p{Cc}\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180F\u3164\uFFA0\uFE00-\uFE0F]|[\x{E0100}-\x{E01EF}]"

#: Decompositions that change only the drawing's width or font, by the tag in the Unicode data.
SAME_DRAWING = {"<wide>", "<narrow>", "<font>"}


@cache
def char_map() -> tuple[dict[str, str], dict[str, str]]:
    """(one character to one, one to several): what each character is drawn like.

    Letter case, accents, raised, circled and fraction figures are kept, and so are letters against digits.
    """
    alike = {ord(c): to for to, chars in DRAWN_ALIKE.items() for c in chars}
    one: dict[str, str] = {}
    several: dict[str, str] = {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        to = c
        if tag in SAME_DRAWING or tag == "<compat>" and _is_sign(c, i):
            to = "".join(chr(int(x, 16)) for x in rest.split())
        elif tag and tag[0] != "<":
            parts = unicodedata.normalize("NFD", c)
            if ord(parts[0]) in alike:
                to = unicodedata.normalize("NFC", alike[ord(parts[0])] + parts[1:])
        to = to.translate(alike)
        if to != c:
            (one if len(to) == 1 else several)[c] = to
    return one, several


def _is_sign(c: str, i: int) -> bool:
    """Roman numerals, ligatures, digraphs and radicals: one sign drawn like the letters it stands for."""
    return 0x2160 <= i <= 0x217F or 0xFB00 <= i <= 0xFB06 or 0x132 <= i <= 0x133 or 0x1C7 <= i <= 0x1CC or 0x1F1 <= i <= 0x1F3 or 0x2F00 <= i <= 0x2FD5


def plain(value: Column) -> Column:
    """``value`` as a reader sees it; null stays null, a value of which nothing shows becomes ''."""
    one, several = char_map()
    c = F.trim(F.regexp_replace(F.regexp_replace(value, SPACES, " "), UNSEEN, ""))
    parts = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    c = F.when(c.rlike(f"[{''.join(several)}]"), F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(parts[x], x)), "")).otherwise(c)
    return F.trim(F.translate(c, "".join(one), "".join(one.values())))


def look_alike_classes(values: DataFrame, *, scope: str, value: str, rank: str) -> DataFrame:
    """Equivalence classes of ``value`` within ``scope``: ``scope, value, canonical``.

    ``values`` may hold repeated rows. The canonical member of a class is the one
    with the smallest ``rank`` (null counts as largest), then the smallest value in code point
    order. Null values and values of which nothing shows belong to no class.
    """
    distinct = values.select(F.col(scope).alias("scope"), F.col(value).alias("value"), F.col(rank).alias("rank")).groupBy("scope", "value").agg(F.min("rank").alias("rank"))
    seen = distinct.withColumn("form", plain(F.col("value"))).where("form <> ''").withColumn("form", F.expr("form COLLATE UNICODE"))
    members = seen.groupBy("scope", "form").agg(
        F.min_by("value", F.struct(F.col("rank").isNull(), "rank", "value")).alias("canonical"), F.collect_set("value").alias("members")
    )
    return members.select("scope", F.explode("members").alias("value"), "canonical")


def resolve_identifiers(records: DataFrame, catalog: DataFrame, *, key: str, fields: list[str], salts: int = 16) -> DataFrame:
    """The catalogue item each identifier stands for: ``key, field_name, value, item_id, canonical_value``.

    ``records`` holds one column per field, ``catalog`` (item_id, field_name, canonical_value).
    Only values drawn like a catalogue item of the same field come out, repeated
    rows once; null, '' and values of which nothing shows never do. Two catalogue
    items drawn alike would be one class; the smaller item id stands for it.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields)))
    rows = records.select(F.col(key).alias("row_key"), pairs.alias("p")).select("row_key", "p.field_name", "p.value").where("value is not null and value <> ''")
    items = catalog.select("field_name", F.col("canonical_value").alias("value"), F.col("item_id").alias("rank"))
    known = rows.select("field_name", "value").distinct().withColumn("rank", F.lit(None).cast("int"))
    classes = look_alike_classes(items.unionByName(known), scope="field_name", value="value", rank="rank")
    named = (
        classes.join(items.groupBy("field_name", "value").agg(F.min("rank").alias("item_id")).select(F.col("field_name").alias("scope"), F.col("value").alias("canonical"), "item_id"), ["scope", "canonical"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .select(F.col("scope").alias("field_name"), "value", "salt", "item_id", F.col("canonical").alias("canonical_value"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)).cast("int"))
    return salted.join(named, ["field_name", "value", "salt"]).select(F.col("row_key").alias(key), "field_name", "value", "item_id", "canonical_value").distinct()


def misspelt_identifiers(records: DataFrame, catalog: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """Of :func:`resolve_identifiers`, the values whose code points are not the catalogue's once ordinary spaces at both ends are gone."""
    return resolve_identifiers(records, catalog, key=key, fields=fields).where(F.trim(F.col("value")) != F.col("canonical_value"))
