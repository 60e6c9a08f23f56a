"""Tool arguments, results and rerank items given as JSON text."""

from pyspark.sql import Column, functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strict_json(text: Column) -> Column:
    """Variant, or null for anything that is not exactly one JSON value.

    The parser stops after the first value; wrapped in two ways, trailing text cannot parse.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_object.isNotNull(), F.try_variant_get(in_array, "$[0]", "variant"))


def _kind_of(schema: Column) -> Column:
    return (
        F.when(schema.startswith("OBJECT"), "OBJECT")
        .when(schema.startswith("ARRAY"), "ARRAY")
        .when(schema.isin("STRING", "BOOLEAN", "VOID"), schema)
        .when(schema.isin("BIGINT", "DOUBLE", "FLOAT") | schema.startswith("DECIMAL"), "NUMBER")
        .otherwise("OTHER")
    )


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, NUMBER, VOID or OTHER; null for null."""
    return F.when(value.isNotNull(), let(F.schema_of_variant(value), _kind_of))


def is_scalar(value: Column) -> Column:
    return kind(value).isin("STRING", "BOOLEAN", "NUMBER")


def overlay(first: Column, second: Column) -> Column:
    """Both maps; the second wins."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)


def field(value: Column, name: str, type_name: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", type_name)


def truthy(value: Column) -> Column:
    """What a script language takes for true: not null, zero, false or empty."""
    def judge(v):
        return (
            F.when(v["kind"] == "NUMBER", v["text"].try_cast("double") != 0)
            .when(v["kind"] == "BOOLEAN", v["text"] == "true")
            .when(v["kind"] == "STRING", F.length(v["text"]) > 0)
            .otherwise(~v["text"].isin("{}", "[]"))
        )

    bound = F.struct(kind(value).alias("kind"), value.try_cast("string").alias("text"))
    return F.coalesce(let(bound, judge), F.lit(False))


def object_or_null(text: Column) -> Column:
    return let(strict_json(text), lambda value: F.when(kind(value) == "OBJECT", value))


def error_of(payload: Column) -> Column:
    """``error: detail``, ``error`` or null, of an object."""
    error, detail = field(payload, "error"), field(payload, "detail")
    label = error.try_cast("string")
    return F.when(
        truthy(error),
        F.when(truthy(detail), F.concat(label, F.lit(": "), detail.try_cast("string"))).otherwise(label),
    )


def arguments_of(payload: Column) -> Column:
    """Fields of an object as strings; without an object an empty map."""
    return F.coalesce(payload.try_cast("map<string,string>"), F.map_from_arrays(F.array(), F.array()).cast(
        "map<string,string>"))


def blocks_text(blocks: Column) -> Column:
    """Content blocks (JSON objects as strings) to text, one per line; blocks without text stay JSON."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(F.get_json_object(b, "$.text"), b)), "\n")


def rerank_index(given: Column) -> Column:
    """Candidate position of an item's index, null where it is not a number, -1 where it is too large for any list."""
    text = given.try_cast("string")
    whole = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)\s*$", 1)
    return let(kind(given), lambda k: (
        F.when(k == "NUMBER", F.coalesce(given.try_cast("double").try_cast("bigint"), F.lit(-1)))
        .when(k == "BOOLEAN", given.try_cast("boolean").cast("bigint"))
        .when((k == "STRING") & (whole != ""), F.coalesce(whole.try_cast("bigint"), F.lit(-1)))))


def rerank_score(item: Column) -> Column:
    """First truthy of the three known keys as a number, 0 where it is none."""
    keys = [field(item, k) for k in ("score", "relevance_score", "similarity")]
    first = F.coalesce(*[F.when(truthy(k), k.try_cast("string")) for k in keys])
    return F.coalesce(first.try_cast("double"), F.lit(0.0))
