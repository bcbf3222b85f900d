"""Attributes, bodies, events, links and exemplars as text: one policy for all decoders.

Objects have sorted keys, the last of equal keys, no absent values and no
non-finite numbers; ``service_*`` columns take the first key that has a value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import BOOL, BYTES, DOUBLE, INT, MAP, SLICE, STR
from .text import display_double, finite, json_double, lossy, none_if_empty, quote


def value_json(v: Column) -> Column:
    """JSON text of a value; a non-finite number is ``null``."""
    kind = v["kind"]
    return (
        F.when(kind == STR, quote(v["str"])).when(kind == INT, v["int"].cast("string")).when(kind == BOOL, v["bool"].cast("string"))
        .when((kind == DOUBLE) & finite(v["dbl"]), json_double(v["dbl"])).when(kind.isin(MAP, SLICE), v["json"]).when(kind == BYTES, quote(lossy(v["bytes"]))).otherwise(F.lit("null"))
    )


def object_json(attrs: Column) -> Column:
    """A JSON object of the attributes that have a value; never null."""
    had = F.filter(attrs, lambda a: a["value"].isNotNull())
    # the last of equal keys: those with no equal key after them
    last = F.filter(had, lambda a, i: ~F.exists(F.slice(had, i + 2, F.greatest(F.size(had), F.lit(1))), lambda b: b["key"] == a["key"]))
    shown = F.filter(last, lambda a: ~((a["value"]["kind"] == DOUBLE) & ~finite(a["value"]["dbl"])))
    members = F.transform(F.array_sort(F.transform(shown, lambda a: F.struct(a["key"].alias("k"), F.concat(quote(a["key"]), F.lit(":"), value_json(a["value"])).alias("t")))), lambda x: x["t"])
    return F.coalesce(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")), F.lit("{}"))


def attributes_json(attrs: Column) -> Column:
    """As ``object_json``, null where no attribute has a value."""
    return F.when(F.exists(attrs, lambda a: a["value"].isNotNull()), object_json(attrs))


def value_text(v: Column) -> Column:
    """Plain text of a value for ``service_*``; empty and non-finite values have none."""
    kind = v["kind"]
    return (
        F.when(kind == STR, v["str"]).when(kind == INT, v["int"].cast("string")).when(kind == BOOL, v["bool"].cast("string"))
        .when((kind == DOUBLE) & finite(v["dbl"]), display_double(v["dbl"])).when(kind.isin(MAP, SLICE), v["json"]).when(kind == BYTES, lossy(v["bytes"]))
    )


def attribute_text(attrs: Column, key: str) -> Column:
    first = F.try_element_at(F.filter(attrs, lambda a: (a["key"] == key) & a["value"].isNotNull()), F.lit(1))
    return none_if_empty(value_text(first["value"]))


def body_text(v: Column) -> Column:
    kind = v["kind"]
    return (
        F.when(kind == STR, none_if_empty(v["str"])).when(kind == INT, v["int"].cast("string")).when(kind == BOOL, v["bool"].cast("string"))
        .when((kind == DOUBLE) & finite(v["dbl"]), json_double(v["dbl"])).when(kind.isin(MAP, SLICE), v["json"]).when(kind == BYTES, none_if_empty(lossy(v["bytes"])))
    )


def id_or_null(c: Column, width: int) -> Column:
    """An id of the right width that is not all zero."""
    return F.when((F.octet_length(c) == width) & (c != F.lit(bytes(width))), c)


def _id_text(c: Column, width: int) -> Column:
    return F.concat(F.lit('"'), F.coalesce(F.lower(F.hex(id_or_null(c, width))), F.lit("")), F.lit('"'))


def _list(items: Column, one) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("["), F.array_join(F.transform(items, one), ","), F.lit("]")))


def events_json(events: Column) -> Column:
    return _list(events, lambda e: F.concat(F.lit('{"attributes":'), object_json(e["attrs"]), F.lit(',"name":'), quote(F.coalesce(e["name"], F.lit(""))), F.lit(',"time_unix_nano":'), F.coalesce(e["time"], F.lit(0)).cast("string"), F.lit("}")))


def links_json(links: Column) -> Column:
    return _list(links, lambda x: F.concat(F.lit('{"attributes":'), object_json(x["attrs"]), F.lit(',"span_id":'), _id_text(x["span_id"], 8), F.lit(',"trace_id":'), _id_text(x["trace_id"], 16), F.lit(',"trace_state":'), quote(F.coalesce(x["trace_state"], F.lit(""))), F.lit("}")))


def exemplars_json(exemplars: Column) -> Column:
    def one(e):
        v = F.coalesce(e["int_value"].cast("double"), e["double_value"])
        value = F.when(finite(v), F.concat(F.lit(',"value":'), json_double(v))).otherwise(F.lit(""))
        return F.concat(F.lit('{"filtered_attributes":'), object_json(e["attrs"]), F.lit(',"span_id":'), _id_text(e["span_id"], 8), F.lit(',"time_unix_nano":'), F.coalesce(e["time"], F.lit(0)).cast("string"), F.lit(',"trace_id":'), _id_text(e["trace_id"], 16), value, F.lit("}"))

    return _list(exemplars, one)


