"""Entity ids, edge ids and unordered pair keys."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote as quote_text

from pyspark.sql import Column, DataFrame, functions as F

from relweave.functions.values import as_text, is_integral, order_text


def quote(text: Column) -> Column:
    """Percent-encoding with no safe characters beyond letters, digits and ``_.-~``."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def entity_id(df: DataFrame, table_name: str, columns: Sequence[str]) -> Column:
    """``table:key|key`` with every part quoted, so different keys never collide."""
    schema = df.schema
    parts = []
    for name in columns:
        dtype = schema[name].dataType
        text = F.coalesce(as_text(name, dtype), F.lit("None"))
        parts.append(text if is_integral(dtype) else quote(text))
    return F.concat(F.lit(quote_text(table_name, safe="") + ":"), F.concat_ws("|", *parts))


def key_order(df: DataFrame, columns: Sequence[str]) -> Column:
    """Array that sorts like the primary key."""
    schema = df.schema
    return F.array(*[order_text(c, schema[c].dataType) for c in columns])


def edge_id(kind: str, source: Column, target: Column) -> Column:
    """Length-prefixed id, injective for any pair of endpoint ids."""
    return F.concat(
        F.lit(kind + ":"),
        F.char_length(source).cast("string"),
        F.lit(":"),
        source,
        F.char_length(target).cast("string"),
        F.lit(":"),
        target,
    )


def pair_columns(source: str = "source", target: str = "target") -> tuple[Column, Column]:
    """The unordered pair in code-point order."""
    return F.least(F.col(source), F.col(target)), F.greatest(F.col(source), F.col(target))
