"""JSON values of unknown shape against a JSON Schema, as column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number", "FLOAT": "number", "BIGINT": "integer"}


def kind(v: Column) -> Column:
    """The JSON type of a VARIANT: object, array, string, boolean, null, integer or number; null where there is no value.
    A number without a fraction is an integer, however it is written."""
    t = F.schema_of_variant(v)
    named = F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").when(t.startswith("DECIMAL"), "number")
    for spark_name, name in _KINDS.items():
        named = named.when(t == spark_name, name)
    return named


def _errors(v: Column, schema: dict | bool, path: Column) -> list[Column]:
    """Arrays of (path, rule) structs, for each rule of the schema that a present value breaks."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [_one(v.isNotNull(), path, "not allowed")]
    out, k = [], kind(v)
    is_a = lambda *names: F.coalesce(k.isin(*names), F.lit(False))
    if "type" in schema:
        allowed = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = k.isin(*allowed, *(["integer"] if "number" in allowed else []))
        out.append(_one(v.isNotNull() & ~fits, path, f"type {'|'.join(allowed)}"))
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    array = F.try_variant_get(v, "$", "array<variant>")
    for rule, size, names in (("Length", F.length(text), ["string"]), ("Items", F.size(array), ["array"]), ("imum", number, ["integer", "number"])):
        if f"min{rule}" in schema:
            out.append(_one(is_a(*names) & (size < schema[f"min{rule}"]), path, f"min{rule} {schema[f'min{rule}']}"))
        if f"max{rule}" in schema:
            out.append(_one(is_a(*names) & (size > schema[f"max{rule}"]), path, f"max{rule} {schema[f'max{rule}']}"))
    if "pattern" in schema:
        out.append(_one(is_a("string") & ~text.rlike(schema["pattern"]), path, f"pattern {schema['pattern']}"))
    if "enum" in schema:
        values = schema["enum"]
        if not all(isinstance(x, str) for x in values):
            raise ValueError("enum is compiled for texts only")
        out.append(_one(v.isNotNull() & ~(is_a("string") & text.isin(*values)), path, "enum"))
    if "items" in schema:
        inner = lambda x, i: _all(_errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        out.append(F.when(is_a("array"), F.flatten(F.transform(array, inner))))
    properties = schema.get("properties", {})
    below = lambda name: F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit("." + name)))
    member = lambda name: F.try_variant_get(v, f"$['{name}']", "variant")
    for name in schema.get("required", []):
        out.append(_one(is_a("object") & member(name).isNull(), below(name), "required"))
    for name, inner in properties.items():
        out += [F.when(is_a("object"), e) for e in _errors(member(name), inner, below(name))]
    if schema.get("additionalProperties", True) is False:
        names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        others = F.filter(names, lambda n: ~n.isin(*properties)) if properties else names
        other = lambda n: F.struct(F.when(path == "", n).otherwise(F.concat(path, F.lit("."), n)).alias("path"), F.lit("not allowed").alias("rule"))
        out.append(F.when(is_a("object"), F.transform(others, other)))
    return out


_LIST = "array<struct<path:string,rule:string>>"


def _one(broken: Column, path: Column, rule: str) -> Column:
    return F.when(broken, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"))))


def _all(errors: list[Column]) -> Column:
    none = F.array().cast(_LIST)
    return F.flatten(F.array(*[F.coalesce(e.cast(_LIST), none) for e in errors])) if errors else none


def schema_errors(values: DataFrame, schema: dict, json: str = "json") -> DataFrame:
    """values with `path` and `rule`, a row for each rule of the schema that a JSON text breaks.

    The schema is compiled once into column expressions: type (one or several), required, properties, items, additionalProperties,
    minLength, maxLength, minItems, maxItems, minimum, maximum, pattern, and enum of texts. Values are read without a fixed shape, so a value
    of another type is told from a missing one. A text that is no JSON breaks the rule `json`; so does a null.
    Keywords that are not named here are not checked.
    """
    read = values.withColumn("_v", F.try_parse_json(json))
    broken = F.when(F.col("_v").isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule"))).cast(_LIST)).otherwise(_all(_errors(F.col("_v"), schema, F.lit(""))))
    return read.select(*[c for c in values.columns if c != json], F.explode(broken).alias("_e")).select("*", "_e.path", "_e.rule").drop("_e")


def pack_items(packs: DataFrame, json: str = "json") -> DataFrame:
    """packs with `place` and `item`, a row for each item of a pack, an array or an object with `items`; a pack that is neither, or no
    JSON, has one row with a null item."""
    v = F.try_parse_json(json)
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.items", "array<variant>"))
    rows = packs.select(*[c for c in packs.columns if c != json], F.posexplode_outer(F.transform(listed, lambda x: F.to_json(x))).alias("place", "item"))
    return rows.filter("item IS NOT NULL OR place IS NULL")


def synonym_errors(files: DataFrame, json: str = "json") -> DataFrame:
    """files with `term` and `error`, a row for each fault of a synonyms file, which must be an object whose values are lists of texts.

    Told apart: no JSON, no object (both with a null term), a value that is no list, a list that holds something else than texts.
    """
    read = files.withColumn("_v", F.try_parse_json(json))
    entries = F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))
    texts = lambda v: F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(kind(x) == "string", F.lit(False)))
    fault = lambda e: F.when(kind(e["value"]) != "array", F.lit("not a list")).when(~texts(e["value"]), F.lit("not texts"))
    inner = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("term"), fault(e).alias("error"))), lambda x: x["error"].isNotNull())
    whole = lambda error: F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(error).alias("error")))
    found = F.when(F.col("_v").isNull(), whole("no JSON")).when(kind(F.col("_v")) != "object", whole("no object")).otherwise(inner)
    return read.select(*[c for c in files.columns if c != json], F.explode(found).alias("_e")).select("*", "_e.term", "_e.error").drop("_e")
