"""Typed use of the audit trail's JSON details (§2 H4, H5).

Details are parsed once into Spark's VARIANT, whose binary form keeps the type of every
value, so fields are read by path and type without parsing the text again.  All in the
JVM, one scan, and for the report one partial aggregate whose groups are actions times
field names times faults.

Defined results: a null, unreadable or non-object detail gives null fields and a row of
the report; a JSON null is a value of any type; a field of the wrong type reads as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields that each action writes, with their types; those of
# OPTIONAL are written by one of the action's two procedures.
SHAPES = {
    "update_order_status": {"note": "STRING"},
    "force_refund": {"amount": "BIGINT", "reason": "STRING"},
    "adjust_wallet": {"amount": "BIGINT", "reason": "STRING", "new_balance": "BIGINT"},
    "suspend_user": {"reason": "STRING", "was_suspended": "BOOLEAN"},
    "unsuspend_user": {"reason": "STRING", "was_suspended": "BOOLEAN"},
    "change_role": {"from": "STRING", "to": "STRING"},
    "activate_product": {"reason": "STRING"},
    "deactivate_product": {"reason": "STRING"},
}
OPTIONAL = {"update_order_status": {"new_status": "STRING", "from": "STRING", "to": "STRING"}}


def typed_details(logs: DataFrame, key: str = "id") -> DataFrame:
    """One row per audit row: ``key``, action, target_id, readable and the typed fields."""
    v = logs.select(key, "action", "target_id", "detail", F.try_parse_json("detail").alias("v"))
    field = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    return v.select(
        key, "action", "target_id", F.when(F.col("detail").isNotNull(), F.col("v").isNotNull()).alias("readable"),
        field("amount", "bigint").alias("amount"), field("new_balance", "bigint").alias("new_balance"),
        field("reason", "string").alias("reason"), field("note", "string").alias("note"),
        field("from", "string").alias("from_value"),
        F.coalesce(field("to", "string"), field("new_status", "string")).alias("to_value"),
        field("was_suspended", "boolean").alias("was_suspended"))


def _shape(actions: dict[str, dict[str, str]]):
    entries = [F.struct(F.lit(a), F.create_map(*[F.lit(x) for pair in fields.items() for x in pair]))
               for a, fields in actions.items()]
    return F.map_from_entries(F.array(*entries))


def detail_drift(logs: DataFrame) -> DataFrame:
    """(action, field, problem, n): how often a detail is missing, unreadable or no object
    (field null), lacks a field, holds a value of another type or an unexpected field.
    An action without a known shape has only unexpected fields."""
    none = F.create_map().cast("map<string,string>")
    known = F.coalesce(F.element_at(_shape(SHAPES), F.col("action")), none)
    extra = F.coalesce(F.element_at(_shape(OPTIONAL), F.col("action")), none)
    v = logs.select("action", "detail", F.try_parse_json("detail").alias("v"))
    v = v.withColumn("kind", F.schema_of_variant("v"))
    # Keys by a map of the object's values; other values have none.
    fields = F.when(F.col("kind").startswith("OBJECT"), F.expr("try_cast(v as map<string, variant>)"))
    v = v.withColumns({"f": fields, "known": known, "extra": extra})
    whole = F.when(F.col("detail").isNull(), "no detail").when(F.col("v").isNull(), "unreadable") \
        .when(F.col("f").isNull(), "no object")
    problem = lambda name, text: F.struct(name.alias("field"), text.alias("problem"))
    absent = F.transform(F.array_except(F.map_keys("known"), F.map_keys("f")),
                         lambda name: problem(name, F.lit("missing")))

    def fault(e):
        kind = F.schema_of_variant(e["value"])
        want = F.coalesce(F.element_at(F.col("known"), e["key"]), F.element_at(F.col("extra"), e["key"]))
        kind = F.regexp_extract(kind, "^[A-Z]+", 0)
        text = F.when(want.isNull(), F.concat(F.lit("unexpected "), kind)) \
            .when((kind != want) & (kind != "VOID"), F.concat(F.lit("type "), kind))
        return problem(e["key"], text)

    present = F.transform(F.map_entries("f"), fault)
    every = F.when(whole.isNotNull(), F.array(problem(F.lit(None).cast("string"), whole))) \
        .otherwise(F.concat(absent, present))
    return v.select("action", F.explode(every).alias("x")).filter("x.problem is not null") \
        .groupBy("action", F.col("x.field").alias("field"), F.col("x.problem").alias("problem")) \
        .agg(F.count(F.lit(1)).alias("n"))
