"""The boolean substring rule on INFO texts, as a native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule(text: str, info: Column) -> Column:
    """A rule such as '( A && ! B ) || C' on info: operands are substrings.

    Tokens are parted by white space; && and || have equal rank and go from left to right,
    ! binds to the next operand. ValueError for a rule of another form; null infos don't match.
    """
    tokens = text.split()

    def operand() -> Column:
        if not tokens:
            raise ValueError("the rule ends too early")
        t = tokens.pop(0)
        if t == "!":
            return ~operand()
        if t == "(":
            inside = chain()
            if not tokens or tokens.pop(0) != ")":
                raise ValueError("a bracket isn't closed")
            return inside
        if t in ("&&", "||", ")"):
            raise ValueError(f"{t} where an operand is due")
        return F.contains(F.coalesce(info, F.lit("")), F.lit(t))

    def chain() -> Column:
        left = operand()
        while tokens and tokens[0] in ("&&", "||"):
            left = left & operand() if tokens.pop(0) == "&&" else left | operand()
        return left

    out = chain()
    if tokens:
        raise ValueError(f"{tokens[0]} is one too many")
    return out
