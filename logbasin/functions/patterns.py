"""Line layouts: one regular expression with one group per field.

Groups are numbered, because Java group names cannot hold an underscore.
A pattern is anchored at the start of the line only; text after the last
field is allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logbasin.schema import FIELDS

# Separates captured fields after the one-pass rewrite; a line holding it is no match.
MARK = "\x01"

# What follows the syslog time in the quoted layout. A run that the
# next character must end is possessive (``++``): it can never need to give back.
_QUOTED_REST = (
    r' ([^\s]++) ([^\s]++) \[([^\]]++)\] (-|"[^"]*+") ("[^"]*+") \[([^\]]++)\]'
    r' "(\w+) ([^"]+) (HTTP/\d\.\d)" (\d+) (\d+) "([^"]*+)" "([^"]*+)"'
    r' Time (\d+) Age "([^"]*+)" "([^"]*+)" "([^"]*+)" (-|"[^"]*+")'
    r' "([^"]*+)" "([^"]*+)" (\w+)'
)

# The layout without quotes around most fields.
_UNQUOTED = (
    r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+"
    r'\[([^\]]+)\]\s+"(\S+)\s+([^"]+)\s+([^"]+)"\s+(\d+)\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"\s+'
    r'(\d+)\s+(\d+)\s+"([^"]*)"\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)'
)

# Public grok tokens used by GROK_EXPRESSION.
GROK_TOKENS = {
    "WORD": r"\b\w+\b",
    "INT": r"(?:[+-]?(?:[0-9]+))",
    "DATA": r".*?",
    "HOSTNAME": r"\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*+(?:\.?|\b)",
    "IP": r"(?<![0-9])(?:(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})(?![0-9])",
    "QUOTEDSTRING": r'"(?:[^\\"]++|\\.)*+"',  # possessive: a long field takes no stack
    "SYSLOG_TIME": r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    "AUTH": r'-|"[^"]*"',
}

# The line layout as a grok expression.
GROK_EXPRESSION = (
    r"%{SYSLOG_TIME:timestamp_syslog} %{HOSTNAME:hostname} %{IP:ip_cliente_externo}"
    r" \[%{DATA:ip_red_interna}\] %{AUTH:usuario_autenticado} %{QUOTEDSTRING:identidad}"
    r' \[%{DATA:timestamp_apache}\] "%{WORD:metodo} %{DATA:recurso} %{DATA:protocolo}"'
    r" %{INT:codigo_respuesta} %{INT:tamano_respuesta} %{QUOTEDSTRING:referer}"
    r" %{QUOTEDSTRING:user_agent} Time %{INT:tiempo_respuesta_ms} Age %{QUOTEDSTRING:edad_cache}"
    r" %{QUOTEDSTRING:content_type} %{QUOTEDSTRING:campo_reservado_1} %{AUTH:campo_reservado_2}"
    r" %{QUOTEDSTRING:ambiente_origen} %{QUOTEDSTRING:ambiente_pool} %{WORD:entorno_nodo}"
)


@dataclass(frozen=True)
class Layout:
    """A pattern and the field names of its groups, in order."""

    pattern: str
    fields: tuple[str, ...]

    @property
    def groups(self) -> int:
        return re.compile(self.pattern).groups


def grok_layout(expression: str, tokens: dict[str, str] = GROK_TOKENS) -> Layout:
    """Write a grok expression out as a pattern; each named token becomes a group."""
    fields: list[str] = []

    def expand(found: re.Match) -> str:
        token, name = found.group(1), found.group(2)
        if name is None:
            return f"(?:{tokens[token]})"
        fields.append(name)
        return f"({tokens[token]})"

    return Layout(re.sub(r"%\{(\w+)(?::(\w+))?\}", expand, expression), tuple(fields))


LAYOUTS = {
    # Any run of blanks inside the syslog time.
    "tolerant": Layout(r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})" + _QUOTED_REST, tuple(FIELDS)),
    # At least two blanks before the day, so two-digit days do not match.
    "strict": Layout(r"(\w{3} \s+\d{1,2} \d{2}:\d{2}:\d{2})" + _QUOTED_REST, tuple(FIELDS)),
    "unquoted": Layout(_UNQUOTED, tuple(FIELDS)),
    "grok": grok_layout(GROK_EXPRESSION),
}

SYSLOG_PREFIX = r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"


def anchored(pattern: str, unicode_classes: bool = False) -> str:
    """Anchor at the start; ``unicode_classes`` lets \\w, \\d and \\s match beyond ASCII."""
    return ("(?U)" if unicode_classes else "") + "^" + pattern


def marked(line: Column, layout: Layout, unicode_classes: bool = False) -> Column:
    """The line rewritten to its groups, parted by a mark, and split there.

    The pattern runs once per line, not once per field. A line that does not
    match stays as it is, so it must pass ``checked``.
    """
    groups = MARK.join(f"${i}" for i in range(1, layout.groups + 1))
    whole = anchored(layout.pattern, unicode_classes) + r"(?s:.*)$"
    return F.split(F.regexp_replace(line, whole, groups), MARK)


def checked(parts: Column, line: Column, layout: Layout) -> Column:
    """The parts of a line that matched, else null."""
    return F.when((F.size(parts) == layout.groups) & ~F.contains(line, F.lit(MARK)), parts)


def captured(line: Column, layout: Layout, unicode_classes: bool = False) -> Column:
    """All groups of a line as ``array<string>``; null without a match."""
    return checked(marked(line, layout, unicode_classes), line, layout)


def captured_by_field(line: Column, layout: Layout) -> Column:
    """The same array with one extraction per group: slower, kept as a cross-check."""
    pattern = anchored(layout.pattern)
    groups = [F.regexp_extract(line, pattern, i) for i in range(1, layout.groups + 1)]
    return F.when(line.rlike(pattern), F.array(*groups))
