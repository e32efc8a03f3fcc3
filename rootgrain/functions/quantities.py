"""Quantities with units: the algebra of compound units, and arithmetic texts as programs for a stack.

A unit is a tuple of (symbol, exponent) in order of symbols, without exponent 0; the empty one is the
unit 1. A table has few different units, so that these functions are called once for each, or each
pair, that a batch of rows holds, not row by row.
"""

import re
from collections.abc import Iterable

from .vocab import UNITS

#: The points of a series that an expression may read, and how deep its brackets may nest (fixed values).
POINTS = ("baseline", "post")
MAX_DEPTH = 32

Unit = tuple[tuple[str, int], ...]
_SYMBOL = r"[A-Za-z%µ][A-Za-z0-9%_]*"
_FACTOR = rf"(?:1|{_SYMBOL}(?:\^0*[1-9][0-9]*)?)"
_WHOLE = re.compile(rf"\s*{_FACTOR}(?:\s*[*·/]\s*{_FACTOR})*\s*", re.ASCII)
_PART = re.compile(rf"([*·/]?)\s*(?:1|({_SYMBOL})(?:\^0*([1-9][0-9]{{0,8}})[0-9]*)?)", re.ASCII)


def _merged(factors: Iterable[tuple[str, int]]) -> Unit:
    """Factors of any order and number as a unit."""
    powers: dict[str, int] = {}
    for symbol, power in factors:
        powers[symbol] = powers.get(symbol, 0) + power
    return tuple(sorted((s, e) for s, e in powers.items() if e))


def parse_unit(text: str) -> Unit | None:
    """The unit that a text like ms, 1/s or m^2*s/min writes; None where it cannot be read."""
    if _WHOLE.fullmatch(text):
        return _merged((symbol, int(power or 1) * (-1 if sign == "/" else 1)) for sign, symbol, power in _PART.findall(text) if symbol)


def product(a: Unit, b: Unit) -> Unit:
    return _merged(a + b)


def quotient(a: Unit, b: Unit) -> Unit:
    return _merged(a + tuple((s, -e) for s, e in b))


def render(unit: Unit) -> str:
    """The unit's one spelling: symbols in order, · between them, those with a negative power after /."""
    over, under = ("·".join(s if e * sign == 1 else f"{s}^{e * sign}" for s, e in unit if e * sign > 0) for sign in (1, -1))
    return (over or "1") + (under and f"/{under}")


def known(unit: Unit) -> tuple[str, float, float] | None:
    """(dimension, n, d) of a unit of one symbol of the unit table to the power 1, or of the unit 1: its factor is n / d."""
    symbol = "1" if not unit else unit[0][0] if len(unit) == 1 and unit[0][1] == 1 else None
    if symbol in UNITS:
        dimension, n, d, _ = UNITS[symbol]
        return dimension, float(n), float(d)


def factor_to(source: Unit, target: Unit) -> float | None:
    """What a number in one unit is multiplied with to be in another; None where they do not convert."""
    if source == target:
        return 1.0
    a, b = known(source), known(target)
    return a[1] * b[2] / (a[2] * b[1]) if a and b and a[0] == b[0] else None


_TOKEN = re.compile(r"\s*(?:([0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|([A-Za-z_][A-Za-z0-9_]*)|(\S)|$)")
_ENTITY, _POINT = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z][A-Za-z0-9_]*")
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3}


class Unreadable(ValueError):
    """A text that is no expression: kind is syntax, tooDeep or unknownPoint, at the character where it shows."""

    def __init__(self, kind: str, at: int, told: str = ""):
        super().__init__(kind, at, told)
        self.kind, self.at, self.told = kind, at, told


def _reading(text: str, metric: str, at: int) -> tuple[tuple[str, str | None, str], int]:
    """What follows a metric's name: perhaps @entity, then a point."""
    entity = None
    if text[at : at + 1] == "@":
        m = _ENTITY.match(text, at + 1)
        if not m:
            raise Unreadable("syntax", at + 1, "an entity is missing")
        entity, at = m[0], m.end()
    m = _POINT.match(text, at + 1) if text[at : at + 1] == "." else None
    if not m:
        raise Unreadable("syntax", at + (text[at : at + 1] == "."), "a point is missing")
    if m[0] not in POINTS:
        raise Unreadable("unknownPoint", at + 1, m[0])
    return (metric, entity, m[0]), m.end()


def compiled(text: str) -> tuple[list[tuple], list[tuple]]:
    """(steps, readings) of a text with numbers, readings `metric.point` or `metric@entity.point`, + - * /,
    signs and brackets. Operators wait on a stack until one that binds no closer comes, so that a text of
    any length takes one pass."""
    steps: list[tuple] = []
    readings: list[tuple] = []
    waiting: list[tuple[str, int]] = []
    at, depth, operand = 0, 0, True

    def release(least: int) -> None:
        while waiting and waiting[-1][0] != "(" and _BINDS[waiting[-1][0]] >= least:
            kind, where = waiting.pop()
            steps.append((kind, where, None, None))

    while True:
        m = _TOKEN.match(text, at)
        number, name, sign = m.groups()
        start = m.start(m.lastindex) if m.lastindex else m.end()
        at = m.end()
        if operand:
            if number:
                steps.append(("number", start, float(number), None))
            elif name:
                told, at = _reading(text, name, at)
                if told not in readings:
                    readings.append(told)
                steps.append(("reading", start, None, readings.index(told)))
            elif sign == "-":
                waiting.append(("~", start))
                continue
            elif sign == "(":
                depth += 1
                if depth > MAX_DEPTH:
                    raise Unreadable("tooDeep", start)
                waiting.append(("(", start))
                continue
            else:
                raise Unreadable("syntax", start, "an operand is missing")
            operand = False
        elif sign and sign in "+-*/":
            release(_BINDS[sign])
            waiting.append((sign, start))
            operand = True
        elif sign == ")" and depth:
            release(0)
            waiting.pop()
            depth -= 1
        elif depth:
            raise Unreadable("syntax", start, "a bracket is not closed")
        elif number or name or sign:
            raise Unreadable("syntax", start, "an operator is missing")
        else:
            release(0)
            return steps, readings


