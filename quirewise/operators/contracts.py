"""Replies held against the shape that was asked for: one row for each violation.

Rows: a null reply is no JSON; an empty object lacks every required field;
repeated rows report each; an empty table gives an empty report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types as the engine names them in a parsed reply, by what is asked for.
KINDS = {"integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


@dataclass(frozen=True)
class Field:
    """A field of a reply's objects: its kind, and what it may hold."""

    name: str
    kind: str
    required: bool = True
    among: tuple[str, ...] = ()
    low: int | None = None
    high: int | str | None = None


def violations(rows: DataFrame, reply: str, fields: list[Field], many: bool = False) -> DataFrame:
    """``rows`` without the reply, with ``at, field, problem`` of each violation, and what broke, ``found``.

    A reply is an object or, with ``many``, an array of them, whose place from 0
    is ``at``.  Problems are: ``not json`` (the reply is kept in ``found``),
    ``not an object``, ``missing`` (null too), ``wrong type``, ``not among the
    values`` and ``out of range``.  ``high`` is a number or names a column of the
    row, such as the number of items that an index may name.
    """
    others = [c for c in rows.columns if c != reply]
    parsed = rows.withColumn("_v", F.try_parse_json(F.col(reply)))
    none = F.lit(None).cast("string")

    shape = F.coalesce(F.schema_of_variant("_v"), F.lit("VOID"))
    broken = parsed.where(F.col("_v").isNull()).select(
        *others, F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("field"), F.lit("not json").alias("problem"), F.col(reply).alias("found")
    )
    sound = parsed.where(F.col("_v").isNotNull())
    wanted = "ARRAY" if many else "OBJECT"
    shaped = sound.withColumn("_ok", F.startswith(shape, F.lit(wanted)))
    odd = shaped.where(~F.col("_ok")).select(
        *others, F.lit(None).cast("int").alias("at"), none.alias("field"), F.lit(f"not an {wanted.lower()}").alias("problem"), F.to_json("_v").alias("found")
    )
    items = shaped.where("_ok")
    if many:
        items = items.select(*others, F.posexplode(F.variant_get("_v", "$", "array<variant>")).alias("at", "_x"))
    else:
        items = items.select(*others, F.lit(0).alias("at"), F.col("_v").alias("_x"))
    checks = []
    for f in fields:
        value = F.try_variant_get("_x", f"$.{f.name}", "variant")
        text = F.try_variant_get("_x", f"$.{f.name}", "string")
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        absent = value.isNull() | (kind == "VOID")
        fits = F.lit(False)
        for k in KINDS[f.kind]:
            fits = fits | F.startswith(kind, F.lit(k))
        what = F.when(absent, F.lit("missing") if f.required else none).when(~fits, "wrong type")
        if f.among:
            what = what.when(~text.isin(*f.among), "not among the values")
        number = text.try_cast("double")
        if f.low is not None:
            what = what.when(number < f.low, "out of range")
        if f.high is not None:
            what = what.when(number > (F.col(f.high) if isinstance(f.high, str) else f.high), "out of range")
        checks.append(F.struct(F.lit(f.name).alias("field"), what.alias("problem"), F.when(~absent, text).alias("found")))
    listed = items.select(*others, "at", F.explode(F.filter(F.array(*checks), lambda x: x["problem"].isNotNull())).alias("_p"))
    return broken.unionByName(odd).unionByName(listed.select(*others, "at", "_p.*"))
