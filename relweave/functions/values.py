"""Turning typed column values into text: plain strings, sort keys and typed JSON.

The expressions are written as SQL over a column reference, so a wide table costs one call per
column to define, however long the expression is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

MAX_SAFE_INTEGER = 2**53 - 1

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATING)


def type_family(dtype: T.DataType) -> str:
    """Types whose values can be equal to each other share a family."""
    if isinstance(dtype, _INTEGRAL + _FLOATING + (T.DecimalType,)):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return dtype.typeName()


def require_comparable(left: T.DataType, right: T.DataType, what: str) -> None:
    """Refuse joins that would only match through an implicit cast."""
    if type_family(left) != type_family(right):
        raise ValueError(f"{what}: {left.simpleString()} and {right.simpleString()} are never equal")


def column_ref(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _double_text(x: str) -> str:
    """Shortest decimal form; exponent notation below 1e-4 and from 1e16, as Python prints it.

    Java before version 19 sometimes prints a digit too many, so a form of 16 or more digits is replaced by the
    shortest one that reads back as the same number.  Only subnormals near 5e-324 can differ.
    """
    size = f"abs(CAST({x} AS DOUBLE))"
    raw = f"CAST({size} AS STRING)"
    # Forms of 15, 16 and 17 digits, the first of which that reads back as the same number is taken.
    forms = [f"format_string('%.{places}E', {size})" for places in (14, 15, 16)]
    choices = " ".join(f"WHEN CAST({form} AS DOUBLE) = {size} THEN {form}" for form in forms)
    few = f"char_length(replace(substring_index({raw}, 'E', 1), '.', '')) < 16"
    shown = f"CASE WHEN {few} THEN {raw} {choices} ELSE {raw} END"
    # The form is bound to a name, because every part below refers to it.
    exponent = "CAST(nullif(substring_index(form, 'E', -1), form) AS INT)"
    digits = "trim(TRAILING '0' FROM replace(substring_index(form, 'E', 1), '.', ''))"
    sign = f"if({x} < 0, '-', '')"
    wide = (
        f"concat({sign}, substring(rpad({digits}, 17, '0'), 1, {exponent} + 1), '.', "
        f"coalesce(nullif(substring({digits}, {exponent} + 2), ''), '0'))"
    )
    tiny = f"concat({sign}, '0.', repeat('0', -{exponent} - 1), {digits})"
    scientific = (
        f"concat({sign}, left({digits}, 1), if(char_length({digits}) > 1, concat('.', substring({digits}, 2)), ''), "
        f"if({exponent} < 0, 'e-', 'e+'), lpad(CAST(abs({exponent}) AS STRING), greatest(2, char_length(CAST(abs({exponent}) AS STRING))), '0'))"
    )
    placed = (
        f"CASE WHEN {exponent} IS NULL THEN CAST(CAST({x} AS DOUBLE) AS STRING) WHEN {exponent} BETWEEN 0 AND 15 THEN {wide} "
        f"WHEN {exponent} BETWEEN -4 AND -1 THEN {tiny} ELSE {scientific} END"
    )
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'nan' WHEN {x} = double('Infinity') THEN 'inf' "
        f"WHEN {x} = double('-Infinity') THEN '-inf' ELSE transform(array({shown}), form -> {placed})[0] END"
    )


def _timestamp_text(x: str, separator: str) -> str:
    pattern = f"yyyy-MM-dd''{separator}''HH:mm:ss".replace("''", "\\'")
    return (
        f"if(date_format({x}, 'SSSSSS') = '000000', date_format({x}, '{pattern}'), date_format({x}, '{pattern}.SSSSSS'))"
    )


def text_sql(x: str, dtype: T.DataType) -> str:
    """SQL for the text of a value, null for null."""
    if isinstance(dtype, T.StringType):
        return x
    if isinstance(dtype, T.BooleanType):
        return f"CASE WHEN {x} THEN 'True' WHEN NOT {x} THEN 'False' END"
    if isinstance(dtype, _FLOATING):
        return _double_text(x)
    if isinstance(dtype, _TIMESTAMPS):
        return _timestamp_text(x, " ")
    if isinstance(dtype, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        return f"if({x} IS NULL, NULL, {repr_sql(x, dtype)})"
    return f"CAST({x} AS STRING)"


def repr_sql(x: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL for a value as it stands inside a list or mapping in Python's notation; a struct is a mapping of its fields."""
    item = f"v{depth}"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        shown = _quoted_text(x, item)
    elif isinstance(dtype, T.BinaryType):
        shown = _quoted_bytes(x, item)
    elif isinstance(dtype, T.DecimalType):
        shown = f"concat('Decimal(\\'', CAST({x} AS STRING), '\\')')"
    elif isinstance(dtype, T.DateType):
        shown = f"concat('datetime.date(', concat_ws(', ', year({x}), month({x}), day({x})), ')')"
    elif isinstance(dtype, _TIMESTAMPS):
        micro = f"CAST(date_format({x}, 'SSSSSS') AS INT)"
        rest = f"if({micro} > 0, concat(', ', second({x}), ', ', {micro}), if(second({x}) > 0, concat(', ', second({x})), ''))"
        shown = f"concat('datetime.datetime(', concat_ws(', ', year({x}), month({x}), day({x}), hour({x}), minute({x})), {rest}, ')')"
    elif isinstance(dtype, T.ArrayType):
        shown = f"concat('[', array_join(transform({x}, {item} -> {repr_sql(item, dtype.elementType, depth + 1)}), ', '), ']')"
    elif isinstance(dtype, T.MapType):
        entry = f"concat({repr_sql(f'{item}.key', dtype.keyType, depth + 1)}, ': ', {repr_sql(f'{item}.value', dtype.valueType, depth + 1)})"
        shown = f"concat('{{', array_join(transform(map_entries({x}), {item} -> {entry}), ', '), '}}')"
    elif isinstance(dtype, T.StructType):
        parts = [f"concat({sql_text(repr(f.name) + ': ')}, {repr_sql(f'{x}.{column_ref(f.name)}', f.dataType, depth + 1)})" for f in dtype.fields]
        shown = "concat('{', concat_ws(', ', " + ", ".join(parts) + "), '}')" if parts else "'{}'"
    else:
        shown = text_sql(x, dtype)
    return f"if({x} IS NULL, 'None', {shown})"


def _quote_of(single: str, double: str) -> str:
    """Double quotes only around a text with single ones and no double one."""
    return f"""if({single} AND NOT {double}, '"', '\\'')"""


def _quoted_text(x: str, item: str) -> str:
    quote = _quote_of(f"contains({x}, '\\'')", f"contains({x}, '\"')")
    plain = f"replace({x}, '\\\\', '\\\\\\\\')"
    for raw, shown in (("\\n", "n"), ("\\r", "r"), ("\\t", "t")):
        plain = f"replace({plain}, '{raw}', '\\\\{shown}')"
    plain = f"if({quote} = '\\'', replace({plain}, '\\'', '\\\\\\''), {plain})"
    # Characters that are not printable, among them all spaces but the plain one, are shown by their number.
    odd = "[\\\\p{C}\\\\p{Z}&&[^ ]]"
    number = f"ascii({item}c)"
    code = f"CASE WHEN {number} < 256 THEN format_string('\\\\x%02x', {number}) WHEN {number} < 65536 THEN format_string('\\\\u%04x', {number}) ELSE format_string('\\\\U%08x', {number}) END"
    letters = f"transform(regexp_extract_all({item}p, '(?s).', 0), {item}c -> if(rlike({item}c, '{odd}'), {code}, {item}c))"
    body = f"transform(array({plain}), {item}p -> if(rlike({item}p, '{odd}'), array_join({letters}, ''), {item}p))[0]"
    return f"concat({quote}, {body}, {quote})"


def _quoted_bytes(x: str, item: str) -> str:
    each = f"transform(sequence(1, greatest(length({x}), 1)), {item}i -> CAST(conv(substring(hex({x}), 2 * {item}i - 1, 2), 16, 10) AS INT))"
    single, double = f"array_contains({each}, 39)", f"array_contains({each}, 34)"
    quote = _quote_of(single, double)
    shown = (
        f"CASE WHEN {item}b = 92 THEN '\\\\\\\\' WHEN {item}b = 10 THEN '\\\\n' WHEN {item}b = 13 THEN '\\\\r' WHEN {item}b = 9 THEN '\\\\t' "
        f"WHEN {item}b = 39 AND {quote} = '\\'' THEN '\\\\\\'' WHEN {item}b BETWEEN 32 AND 126 THEN chr({item}b) ELSE format_string('\\\\x%02x', {item}b) END"
    )
    body = f"if(length({x}) = 0, '', array_join(transform({each}, {item}b -> {shown}), ''))"
    return f"concat('b', {quote}, {body}, {quote})"


def as_text(name: str, dtype: T.DataType) -> Column:
    """The text of a column's value, null for null."""
    return F.expr(text_sql(column_ref(name), dtype))


def order_text(name: str, dtype: T.DataType) -> Column:
    """Text whose code-point order is the value order, for sort keys of mixed tables."""
    x = column_ref(name)
    if isinstance(dtype, _INTEGRAL):
        return F.expr(f"lpad(CAST(CAST({x} AS DECIMAL(20, 0)) + {2**63} AS STRING), 20, '0')")
    return as_text(name, dtype)


def _tagged(tag: str, text: str) -> str:
    return f"""to_json(named_struct('$type', '{tag}', 'value', {text}))"""


def quoted_sql(text: str) -> str:
    """One quoted JSON string, escaped by Spark's own JSON writer, which is called once: behind the quote stands only the brace of the wrapper."""
    return f"rtrim('}}', substring(to_json(named_struct('v', {text})), 6))"


def is_plain_json(dtype: T.DataType) -> bool:
    """Spark's JSON writer writes such values as ``json_sql`` does: texts and booleans, alone, in arrays and in structs."""
    if isinstance(dtype, T.StructType):
        return bool(dtype.fields) and all(re.fullmatch("[A-Za-z0-9_]+", f.name) and is_plain_json(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return is_plain_json(dtype.elementType)
    return isinstance(dtype, (T.StringType, T.BooleanType))


def json_fields(schema: T.StructType) -> Column:
    """The JSON text of a row, as an object of all columns in order.

    Columns that need no types of their own are written by one call for each run of them.
    """
    runs: list[tuple[bool, list[T.StructField]]] = []
    for field in schema.fields:
        # Behind a value that ends in a brace the brace of the wrapper could not be told.
        plain = is_plain_json(field.dataType) and not isinstance(field.dataType, T.StructType)
        if plain and runs and runs[-1][0]:
            runs[-1][1].append(field)
        else:
            runs.append((plain, [field]))
    parts = []
    for plain, fields in runs:
        if plain:
            named = ", ".join(f"{sql_text(f.name)}, {column_ref(f.name)}" for f in fields)
            parts.append(f"rtrim('}}', substring(to_json(named_struct({named}), map('ignoreNullFields', 'false')), 2))")
        else:
            parts.append(f"concat({quoted_sql(sql_text(fields[0].name))}, ':', {json_sql(column_ref(fields[0].name), fields[0].dataType)})")
    return F.expr(f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')" if parts else "'{}'")


def json_sql(x: str, dtype: T.DataType, depth: int = 0) -> str:
    """SQL for the JSON text of one value, with the types plain JSON would lose."""
    text = text_sql(x, dtype)
    item = f"x{depth}"
    if isinstance(dtype, T.BooleanType):
        encoded = f"CAST({x} AS STRING)"
    elif isinstance(dtype, T.StringType):
        encoded = quoted_sql(x)
    elif isinstance(dtype, _INTEGRAL):
        safe = f"abs(CAST({x} AS DECIMAL(20, 0))) <= {MAX_SAFE_INTEGER}"
        encoded = f"if({safe}, {text}, {_tagged('integer', text)})"
    elif isinstance(dtype, _FLOATING):
        finite = f"NOT isnan({x}) AND abs({x}) <> double('Infinity')"
        encoded = f"if({finite}, {text}, {_tagged('float', text)})"
    elif isinstance(dtype, T.DecimalType):
        encoded = _tagged("decimal", text)
    elif isinstance(dtype, _TIMESTAMPS):
        encoded = _tagged("datetime", _timestamp_text(x, "T"))
    elif isinstance(dtype, T.DateType):
        encoded = _tagged("date", text)
    elif isinstance(dtype, T.BinaryType):
        plain = f"regexp_replace(base64({x}), '[\\\\r\\\\n]', '')"
        encoded = f"to_json(named_struct('$type', 'bytes', 'encoding', 'base64', 'value', {plain}))"
    elif isinstance(dtype, T.ArrayType) and is_plain_json(dtype):
        encoded = f"rtrim('}}', substring(to_json(named_struct('v', {x}), map('ignoreNullFields', 'false')), 6))"
    elif isinstance(dtype, T.ArrayType):
        encoded = f"concat('[', array_join(transform({x}, {item} -> {json_sql(item, dtype.elementType, depth + 1)}), ','), ']')"
    elif isinstance(dtype, T.MapType):
        key = quoted_sql(text_sql(f"{item}.key", dtype.keyType))
        value = json_sql(f"{item}.value", dtype.valueType, depth + 1)
        encoded = f"concat('{{', array_join(transform(map_entries({x}), {item} -> concat({key}, ':', {value})), ','), '}}')"
    elif isinstance(dtype, T.StructType):
        parts = ", ".join(
            f"concat({sql_text(_json_name(f.name))}, {json_sql(f'{x}.{column_ref(f.name)}', f.dataType, depth + 1)})" for f in dtype.fields
        )
        encoded = f"concat('{{', concat_ws(',', {parts}), '}}')"
    else:
        encoded = _tagged("unsupported", f"'{dtype.typeName()}'")
    return f"if({x} IS NULL, 'null', {encoded})"


def _json_name(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":'


def typed_json(name: str, dtype: T.DataType) -> Column:
    """JSON text of one column's value that keeps its type."""
    return F.expr(json_sql(column_ref(name), dtype))


def encoded_object(encoded: Column, names: Column) -> Column:
    """A JSON object of the named entries of a map of encoded JSON values, in the given order."""
    present = F.filter(names, lambda n: F.map_contains_key(encoded, n))

    def entry(name: Column) -> Column:
        wrapped = F.to_json(F.struct(name.alias("v")))
        return F.concat(F.substring(wrapped, F.lit(6), F.char_length(wrapped) - 6), F.lit(":"), encoded[name])

    return F.concat(F.lit("{"), F.array_join(F.transform(present, entry), ","), F.lit("}"))
