"""Column helpers. All return JVM-side expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Variant (parsed JSON) ------------------------------------------------


def v_get(v: Column | str, path: str) -> Column:
    """Sub-value at ``path`` as VARIANT; SQL NULL when the path is absent,
    a variant null when the key is present with JSON null."""
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "variant")


def v_present(v: Column | str, path: str) -> Column:
    return v_get(v, path).isNotNull()


def v_type(v: Column) -> Column:
    return F.schema_of_variant(v)


def v_str(v: Column | str, path: str) -> Column:
    """Text of a scalar: strings as is, numbers/booleans as their JSON text."""
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "string")


def v_falsy(v: Column) -> Column:
    """Python truthiness of a JSON value, False for truthy values.

    Falsy: absent, null, "", 0 (any numeric zero), false, {}, [].
    The string "0" is truthy (it is a non-empty string).
    """
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), True)
        .when(t == "VOID", True)
        .when(t == "STRING", F.try_variant_get(v, "$", "string") == "")
        .when(t == "BOOLEAN", ~F.try_variant_get(v, "$", "boolean"))
        .when(t.startswith("OBJECT"), t == "OBJECT<>")
        .when(t.startswith("ARRAY"), F.array_size(F.try_variant_get(v, "$", "array<variant>")) == 0)
        .when(
            t.startswith("DECIMAL") | t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"),
            F.try_variant_get(v, "$", "double") == 0,
        )
        .otherwise(False)
    )


# --- Silver typing ----------------------------------------------------------


def json_bool(c: Column) -> Column:
    """'true' -> true; anything else, null or absent -> false (not a cast)."""
    return F.coalesce(c == F.lit("true"), F.lit(False))


def epoch_day(c: Column) -> Column:
    """Days since 1970-01-01 (text or int) -> DATE."""
    return F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int"))


def typed(c: Column, kind: str) -> Column:
    if kind == "str":
        return c
    if kind == "int":
        return c.cast("int")
    if kind == "double":
        return c.cast("double")
    if kind == "ts":
        return c.cast("timestamp")
    if kind == "bool":
        return json_bool(c)
    if kind == "days":
        return epoch_day(c)
    raise ValueError(f"unknown column kind {kind!r}")


def composite_key(*cols: Column | str, sep: str = ":") -> Column:
    """Concatenate key parts; null if any part is null (unlike concat_ws)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.col(c) if isinstance(c, str) else c)
    return F.concat(*parts)


# --- presentation -----------------------------------------------------------


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """round(part * 100.0 / whole, digits) as DOUBLE."""
    return F.round(part.cast("double") * 100.0 / whole, digits)


def template(text: str, **cols) -> Column:
    """Fill ``{name}`` placeholders of a fixed text with columns (or values).

    Braces that do not wrap a name (e.g. ``{}``) are kept as text. The result
    is null when a filled column is null, like SQL ``concat``.
    """
    import re

    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", text):
        if m.start() > pos:
            parts.append(F.lit(text[pos : m.start()]))
        c = cols[m.group(1)]
        parts.append(c if isinstance(c, Column) else F.lit(str(c)))
        pos = m.end()
    if pos < len(text):
        parts.append(F.lit(text[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
