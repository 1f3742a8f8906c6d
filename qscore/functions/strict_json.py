"""JSON text to structs without the leniency of ``from_json``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict(
    raw: Column, ddl: str, text_fields: dict[str, tuple[str, ...]], text_lists: tuple[str, ...] = ()
) -> Column:
    """Struct of ``ddl``, or null where ``raw`` is not one JSON value of that shape.

    ``from_json`` takes text after the value and turns numbers into strings. So ``raw``
    must also parse inside an array and inside an object (which text after it breaks),
    and ``text_fields`` (JSON path -> field names) must hold strings,
    ``text_lists`` (JSON paths) lists of strings. A JSON ``null``
    gives a struct of nulls. Absent fields are null; field names are case-sensitive.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    one = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    value = F.from_json(
        raw,
        ddl + ", _corrupt string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    is_null = F.regexp_like(raw, F.lit(r"\A\s*null\s*\z"))
    good = one & boxed.isNotNull() & (value["_corrupt"].isNull() | is_null)
    for path, names in text_fields.items():
        shape = F.schema_of_variant(F.try_variant_get(boxed, "$.v" + path, "variant"))
        wrong = rf"\b({'|'.join(names)}): (?!STRING|VOID)"
        good = good & ~F.coalesce(shape.rlike(wrong), F.lit(False))
    for path in text_lists:
        shape = F.schema_of_variant(F.try_variant_get(boxed, "$.v" + path, "variant"))
        good = good & F.coalesce(shape.isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"), F.lit(True))
    return F.when(good, value)
