"""JSON text as the event format spells it: keys in order, shortest numbers, markup characters escaped."""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that stand escaped inside strings.
_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def number(value: float) -> str:
    """Shortest decimal form; an exponent only under 1e-6 or from 1e21 on."""
    if value == 0:
        return "-0" if str(value).startswith("-") else "0"
    mantissa, _, exponent = f"{value!r}".lower().partition("e")
    if not 1e-6 <= abs(value) < 1e21:
        sign, digits = ("-", mantissa[1:]) if mantissa.startswith("-") else ("", mantissa)
        whole, _, fraction = digits.partition(".")
        fraction = "" if fraction == "0" else fraction
        return f"{sign}{whole}{'.' + fraction if fraction else ''}e{int(exponent or 0):+03d}"
    if exponent:
        from decimal import Decimal

        return format(Decimal(repr(value)), "f").removesuffix(".0")
    return mantissa.removesuffix(".0")


def text(value: Any, sort: bool = True) -> str:
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, float):
        return number(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        out = json.dumps(value, ensure_ascii=False)
        for a, b in _ESCAPES.items():
            out = out.replace(a, b)
        return out
    if isinstance(value, dict):
        return "{" + ",".join(f"{text(k)}:{text(value[k], sort)}" for k in (sorted(value) if sort else value)) + "}"
    return "[" + ",".join(text(v, sort) for v in value) + "]"


#: A string with one of these is spelt member by member; so is JSON text with an escape.
_SPECIAL = re.compile('[\x00-\x1f"\\\\<>&\u2028\u2029]')
_SPECIAL_JSON = re.compile('[\\\\<>&\u2028\u2029]|null|NaN|Infinity')
#: A number as the value of a member: without escapes no string holds a quotation mark.
_MEMBER = re.compile(r'":(-?[0-9][0-9.eE+-]*)')


def quoted(value: str) -> str:
    return text(value) if _SPECIAL.search(value) else f'"{value}"'


def _spelt(m: re.Match) -> str:
    value = m[1]
    return f'":{value}' if value.lstrip("-").isdigit() else f'":{number(float(value))}'


def respell(value: str) -> str:
    """JSON of Spark's `to_json`, whose keys are in order and whose nulls are left out, in the format's spelling."""

    def clean(v: Any) -> Any:
        return {k: clean(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v

    return text(clean(json.loads(value))) if _SPECIAL_JSON.search(value) else _MEMBER.sub(_spelt, value)


@F.arrow_udf(StringType())
def spell(column: pa.Array) -> pa.Array:
    """JSON of Spark's `to_json` with keys in order, spelt so."""
    return pa.array([None if c is None else respell(c) for c in column.to_pylist()], pa.string())
