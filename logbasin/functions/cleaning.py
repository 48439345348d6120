"""Numeric conversion and the rules that turn placeholders into null."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logbasin.schema import NUMERIC_TYPES

BLANKS = " \t\r\n\x0b\x0c"


def strip(column: Column) -> Column:
    """Trim blanks of every kind, not only spaces.

    Trimming by a set of characters walks the whole text, so it is left to texts with a blank at an end.
    """
    ends = [at(column, F.lit(b)) for b in BLANKS for at in (F.startswith, F.endswith)]
    return F.when(reduce(Column.__or__, ends), F.btrim(column, F.lit(BLANKS))).otherwise(column)


def _unquoted(column: Column) -> Column:
    quoted = F.startswith(column, F.lit('"')) & F.endswith(column, F.lit('"'))
    inner = F.substring(column, F.lit(2), F.greatest(F.length(column) - 2, F.lit(0)))
    return F.when(quoted, inner).otherwise(column)


@dataclass(frozen=True)
class CleaningRules:
    """Which fields lose quotes and placeholders, and what a bad number becomes."""

    unquote: tuple[str, ...]
    dash_only: tuple[str, ...] = ()
    empty_is_null: bool = False
    bad_number: tuple[tuple[str, int | None], ...] = ()


# The three rule sets in use.
RULES = {
    "main": CleaningRules(
        unquote=(
            "identidad", "referer", "user_agent", "edad_cache",
            "content_type", "campo_reservado_1", "ambiente_origen", "ambiente_pool",
        ),
        dash_only=("usuario_autenticado", "campo_reservado_2"),
    ),
    "legacy": CleaningRules(
        unquote=(
            "usuario_autenticado", "identidad", "referer", "user_agent",
            "edad_cache", "content_type", "campo_reservado_1", "campo_reservado_2",
        ),
        empty_is_null=True,
        bad_number=(("tamano_respuesta", 0),),
    ),
    "checker": CleaningRules(
        unquote=(
            "usuario_autenticado", "identidad", "referer",
            "edad_cache", "content_type", "campo_reservado_1", "campo_reservado_2",
        ),
        empty_is_null=True,
        bad_number=(("codigo_respuesta", 0), ("tamano_respuesta", 0), ("tiempo_respuesta_ms", 0)),
    ),
    # Positional capture: every field is cleaned, an empty string stays.
    "positional": CleaningRules(unquote=()),
    "none": CleaningRules(unquote=()),
}


def clean_text(name: str, column: Column, rules: CleaningRules) -> Column:
    if name in rules.dash_only:
        return F.nullif(column, F.lit("-"))
    if name not in rules.unquote:
        return column
    gone = ["-", '""'] + ([""] if rules.empty_is_null else [])
    return F.when(~column.isin(gone), _unquoted(column))


def clean_positional(column: Column) -> Column:
    return F.when(~column.isin("-", '""'), _unquoted(column))


def clean_number(name: str, column: Column, rules: CleaningRules) -> Column:
    number = column.try_cast(NUMERIC_TYPES[name])
    fallback = dict(rules.bad_number).get(name)
    return number if fallback is None else F.coalesce(number, F.lit(fallback))


def clean(name: str, column: Column, rules: str = "main") -> Column:
    """The typed, cleaned form of one raw field."""
    chosen = RULES[rules]
    if name in NUMERIC_TYPES and rules not in ("none", "positional"):
        return clean_number(name, column, chosen)
    if rules == "positional":
        return clean_positional(column)
    return clean_text(name, column, chosen)
