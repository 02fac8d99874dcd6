"""Sums and means of doubles that are the same whatever the order of the rows.

A double is cut into three whole numbers, its digits of 60 bits: the whole
part, and two times 60 bits after the point. Whole numbers add up without
rounding, so only putting the digits of the sum together rounds, once and in a
fixed way. The digit sums of parts of a table add up to those of the table.

Bits below 2**-120 of a value are dropped. Values of 2**62 and more, infinities
and NaN are added as usual, apart from the others.

Values and states are given as SQL text, a column name for instance: as one
piece of text an expression of this size is planned much faster than call by call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.schema import quoted

__all__ = ["empty_state", "mean", "merged", "quoted", "sum_state", "total"]

_BITS = 60
_UNIT = f"pow(2D, -{_BITS})"
# Wide enough for the sum of 10**10 digits in each of as many parts.
_DIGIT_TYPE, _SUM_TYPE = "decimal(28,0)", "decimal(38,0)"
_BASE = f"cast({1 << _BITS} as {_SUM_TYPE})"
_DIGITS = ("whole", "high", "low")


def sum_state(value: str) -> str:
    """An aggregate: the sum of a column as a struct that ``merged`` can add to others. NULLs have no part."""
    value = f"cast({value} as double)"
    fits = f"(abs({value}) < pow(2D, 62))"
    rest, parts = f"if({fits}, {value}, null)", []
    for name in _DIGITS:
        digit = f"cast({rest} as bigint)"
        parts.append(f"'{name}', cast(coalesce(sum(cast({digit} as {_DIGIT_TYPE})), 0) as {_SUM_TYPE})")
        rest = f"(({rest} - cast({digit} as double)) * pow(2D, {_BITS}))"
    return f"named_struct({', '.join(parts)}, 'outside', sum(if({fits}, null, {value})), 'n', count({value}))"


def merged(state: str, over: str = "") -> str:
    """An aggregate: the state of several parts together. With a window as SQL text (`` over (...)``), the state of its rows."""
    digits = (f"'{n}', cast(coalesce(sum({state}.{n}){over}, 0) as {_SUM_TYPE})" for n in _DIGITS)
    return f"named_struct({', '.join(digits)}, 'outside', sum({state}.outside){over}, 'n', coalesce(sum({state}.n){over}, 0L))"


def empty_state() -> str:
    """The state of no rows."""
    digits = (f"'{n}', cast(0 as {_SUM_TYPE})" for n in _DIGITS)
    return f"named_struct({', '.join(digits)}, 'outside', cast(null as double), 'n', 0L)"


def _let(name: str, value: str, use: str) -> str:
    """``use`` of a value that is computed once, however often its name occurs there."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _over(digit: str) -> str:
    return f"cast(cast({digit} - pmod({digit}, {_BASE}) as {_SUM_TYPE}) div {_BASE} as {_SUM_TYPE})"


def _carry(d: str) -> str:
    """The same number with all digits but the first from 0 to 2**60 - 1."""
    carried = (
        f"named_struct('whole', cast({d}.whole + {_over('high')} as {_SUM_TYPE}), "
        f"'high', pmod(high, {_BASE}), 'low', pmod({d}.low, {_BASE}))"
    )
    return _let("high", f"cast({d}.high + {_over(f'{d}.low')} as {_SUM_TYPE})", carried)


def _size(d: str) -> str:
    # No digit is negative, so putting them together loses nothing to cancellation.
    return f"(cast({d}.whole as double) + (cast({d}.high as double) * {_UNIT} + cast({d}.low as double) * {_UNIT} * {_UNIT}))"


def _joined(s: str) -> str:
    negated = ", ".join(f"'{n}', cast(-{s}.{n} as {_SUM_TYPE})" for n in _DIGITS)
    below = _let("m", f"named_struct({negated})", _let("p", _carry("m"), f"-{_size('p')}"))
    exact = _let("d", _carry(s), f"if(d.whole < 0, {below}, {_size('d')})")
    return f"if({s}.n > 0, {exact} + coalesce({s}.outside, 0D), null)"


def total(state: str) -> Column:
    """The sum of a state as a double; NULL if there were no values."""
    return F.expr(_let("s", state, _joined("s")))


def mean(state: str) -> Column:
    """The mean of a state as a double; NULL if there were no values."""
    return F.expr(_let("s", state, f"{_joined('s')} / nullif(s.n, 0L)"))
