"""Responses of a model service (JSON texts) to values, as column expressions; what is wrong with a response is a column, not an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import once

#: On the way a text is marked by a plus and an error by a minus, null is neither, so that the first outcome is a coalesce and nothing is worked out twice.
TEXT, ERROR = "+", "-"


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column) -> Column:
    """A variant's string if it is one that is not blank."""
    string = lambda v: once(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), lambda text: F.when(F.rlike(text, F.lit(r"(?U)\S")), text))
    return once(value, string)


def _json(value: Column) -> Column:
    return once(value, lambda v: F.when(F.schema_of_variant(v) != "VOID", F.to_json(v)))


def _list(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _said(text: Column) -> Column:
    return F.concat(F.lit(TEXT), text)


def _failed(kind: str, what: Column) -> Column:
    return F.concat(F.lit(f"{ERROR}{kind}: "), what)


def _first(outcomes: Column) -> Column:
    return F.get(F.array_compact(outcomes), 0)


def _is(item: Column, kind: str) -> Column:
    return F.try_variant_get(item, "$.type", "string") == kind


def _refusal(item: Column) -> Column:
    return F.when(_is(item, "refusal"), _failed("refused", F.coalesce(_text(_at(item, "$.refusal")), _text(_at(item, "$.text")), F.lit("refusal"))))


def _content(item: Column) -> Column:
    """What one entry of a content list says: its text, or itself if it is one, or its JSON value; a refusal is an error."""
    return F.coalesce(_refusal(item), _said(F.coalesce(_text(item), _text(_at(item, "$.text")), _json(_at(item, "$.json")))))


def _item(item: Column) -> Column:
    """What one entry of an output list says; its content goes before its own text."""
    own = _said(_text(_at(item, "$.text")))
    return F.coalesce(F.when(_is(item, "output_text"), own), _refusal(item), _first(F.transform(_list(item, "$.content"), _content)), own)


def _choice(choice: Column) -> Column:
    message = _said(_text(_at(choice, "$.message.content")))
    return F.coalesce(message, _first(F.transform(_list(choice, "$.message.content"), _item)), _said(_text(_at(choice, "$.text"))))


def response_text(json: Column) -> Column:
    """struct(text, error) of a response: a non-blank output_text, before all else; then an error or an incomplete status is an error; then the first text in the
    order of all outputs and their contents, then of all choices; a refusal on that way is an error, and so is a response without any text."""

    def walk(value: Column) -> Column:
        error = F.transform(F.array(_json(_at(value, "$.error"))), lambda e: F.when(~e.isin("", '""', "{}", "[]", "0", "false", "null"), _failed("error", e)))
        incomplete = F.when(F.try_variant_get(value, "$.status", "string") == "incomplete", _failed("incomplete", F.coalesce(_json(_at(value, "$.incomplete_details")), F.lit("{}"))))
        outputs, choices = _first(F.transform(_list(value, "$.output"), _item)), _first(F.transform(_list(value, "$.choices"), _choice))
        return F.coalesce(_said(_text(_at(value, "$.output_text"))), F.get(error, 0), incomplete, outputs, choices, F.when(value.isNull(), f"{ERROR}not JSON"), F.lit(f"{ERROR}no text"))

    def told(outcome: Column) -> Column:
        rest = F.substring(outcome, 2, 2**31 - 1)
        return F.struct(F.when(F.startswith(outcome, F.lit(TEXT)), rest).alias("text"), F.when(F.startswith(outcome, F.lit(ERROR)), rest).alias("error"))

    return once(F.try_parse_json(json), lambda value: once(walk(value), told))


def is_keywords(kind: Column) -> Column:
    return F.lower(kind) == "keywords"


def payload(text: Column, kind: Column) -> Column:
    """struct(items, value, error) of a response's text for a kind: keywords take the list k (none: an empty one; nulls in it are left out), a summary v or else s, any
    other kind v. A text that is no JSON object is an error."""

    def read(value: Column, object_: Column) -> Column:
        given = F.try_variant_get(value, "$.k", "array<variant>")
        items = F.transform(F.filter(given, lambda v: F.schema_of_variant(v) != "VOID"), lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
        plain, other = F.try_variant_get(value, "$.v", "string"), F.when(kind == "summary", F.try_variant_get(value, "$.s", "string"))
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(object_ & is_keywords(kind), F.coalesce(items, none)).alias("items"),
            F.when(object_ & ~is_keywords(kind), F.coalesce(plain, other, F.lit(""))).alias("value"),
            F.when(text.isNotNull() & ~object_, "not a JSON object").alias("error"),
        )

    is_object = lambda value: F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
    return once(F.try_parse_json(text), lambda value: once(is_object(value), lambda object_: read(value, object_)))
