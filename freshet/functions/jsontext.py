"""Fields whose JSON shape varies between documents, kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import parse_number


def _is_list(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("["))


def _is_object(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("{"))


def _strings(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def list_or_text(text: Column) -> Column:
    """A list joined by commas, a scalar as it is."""
    return F.when(_is_list(text), F.array_join(_strings(text), ",")).otherwise(text)


def list_of(text: Column) -> Column:
    """A list as it is, a scalar as a list of one."""
    return F.when(_is_list(text), _strings(text)).when(text.isNotNull(), F.array(text))


def link_ids(text: Column) -> Column:
    """The ``@id`` of one link or of a list of links, joined by commas; null if there is none."""
    as_list = F.when(_is_object(text), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    links = F.from_json(as_list, "array<struct<`@id`:string>>")
    ids = F.transform(links, lambda link: F.coalesce(link["@id"], F.lit("")))
    return F.when(F.size(links) > 0, F.array_join(ids, ","))


def first_value(text: Column) -> Column:
    """The first non-empty element of a list, or the scalar itself."""
    present = F.filter(_strings(text), lambda item: item.isNotNull() & (item != ""))
    return F.when(_is_list(text), F.get(present, F.lit(0))).otherwise(text)


def first_number(text: Column) -> Column:
    """:func:`first_value` as a double, null if it is no number."""
    return parse_number(first_value(text))


def first_text(text: Column) -> Column:
    """:func:`first_value` as text."""
    return first_value(text).cast("string")


def member(text: Column, name: str) -> Column:
    """A member of a JSON object; null if the text is no object."""
    return F.when(_is_object(text), F.get_json_object(text, f"$['{name}']"))


def id_or_text(text: Column) -> Column:
    """The ``@id`` of an object, or the plain text; null for a JSON list."""
    is_list = _is_list(text) & F.try_parse_json(text).isNotNull()
    return F.when(_is_object(text), F.get_json_object(text, "$['@id']")).when(~is_list, text)


def accepted_geojson(text: Column) -> Column:
    """The text if it parses as a JSON document, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)
