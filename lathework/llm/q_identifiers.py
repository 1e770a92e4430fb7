"""Queries on look-alike identifiers (problem 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.llm import lookalikes as op
from lathework.session import table

FIELDS = ["equipment_model", "alarm_code", "part_number"]


def p4_found(spark, sf_dir):
    found = op.misspelt_identifiers(table(spark, sf_dir, "document_metadata"), table(spark, sf_dir, "identifier_catalog"), key="record_id", fields=FIELDS)
    return found.select("record_id", "field_name", F.col("item_id").cast("int").alias("item_id")).distinct()


def p4_resolved(spark, sf_dir):
    """Rows per catalogue item, rightly and otherwise spelt ones together."""
    found = op.resolve_identifiers(table(spark, sf_dir, "document_metadata"), table(spark, sf_dir, "identifier_catalog"), key="record_id", fields=FIELDS)
    return found.groupBy("field_name", "item_id", "canonical_value").agg(F.count("*").alias("n_records"), F.countDistinct("value").alias("n_spellings"))


QUERIES = {"p4_found": p4_found, "p4_resolved": p4_resolved}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain_sql(c: str) -> str:
    one, several = op.char_map()
    c = f"regexp_replace(regexp_replace({c}, '[\\p{{Zs}}\\t\\n\\x0B\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}\\x{{2800}}]', ' ', 'g'), '[\\p{{Cf}}\\p{{Cc}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{3164}}\\x{{FFA0}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
    for a, b in several.items():
        c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
    return f"nfc_normalize(trim(translate({c}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})))"


_MATCHED = f"""
WITH long AS (
  {" UNION ALL ".join(f"SELECT record_id, '{f}' AS field_name, {f} AS value FROM document_metadata WHERE {f} <> ''" for f in FIELDS)}),
seen AS (SELECT field_name, value, {_plain_sql("value")} AS form FROM (SELECT DISTINCT field_name, value FROM long)),
items AS (SELECT item_id, field_name, canonical_value, {_plain_sql("canonical_value")} AS form FROM identifier_catalog),
matched AS (SELECT DISTINCT l.record_id, l.field_name, l.value, i.item_id, i.canonical_value
  FROM long l JOIN seen s USING (field_name, value) JOIN items i ON i.field_name = s.field_name AND i.form = s.form)
"""

SQL = {
    "p4_found": _MATCHED + "SELECT DISTINCT record_id, field_name, item_id FROM matched WHERE trim(value, ' ') <> canonical_value",
    "p4_resolved": _MATCHED
    + "SELECT field_name, item_id, canonical_value, count(*) AS n_records, count(DISTINCT value) AS n_spellings FROM matched GROUP BY ALL",
}
