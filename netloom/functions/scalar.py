"""Column functions: fuzzy comparison, globs, formats, ranges, units, hashes, buses, predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, RELATIVE = 1e-15, 1e-6

#: prefixes of physical units: fixed values
PREFIX = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9}


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Equal, or one is 0 and the other under TINY, or the difference is under RELATIVE of the larger one."""
    zero = F.when(a == 0, F.abs(b) < TINY).when(b == 0, F.abs(a) < TINY)
    return (a == b) | F.coalesce(zero, F.abs(a - b) < RELATIVE * F.greatest(F.abs(a), F.abs(b)))


def fuzzy_less(a: Column, b: Column) -> Column:
    return (a < b) & ~fuzzy_equal(a, b)


def fuzzy_less_equal(a: Column, b: Column) -> Column:
    return (a < b) | fuzzy_equal(a, b)


def worse(a: Column, b: Column, late: bool) -> Column:
    """Whether a is worse than b: larger for late, smaller for early."""
    return fuzzy_less(b, a) if late else fuzzy_less(a, b)


def glob_regex(pattern: str, ignore_case: bool = False) -> str:
    """The regular expression of a glob: * any run, ? any character, a backslash takes the next one literally."""
    out, chars = [], iter(pattern)
    for c in chars:
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        else:
            out.append(re.escape(next(chars, "\\") if c == "\\" else c))
    return ("(?i)" if ignore_case else "") + "^" + "".join(out) + "$"


def glob(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(glob_regex(pattern, ignore_case))


def has_wildcard(pattern: str) -> bool:
    return any(c in "*?" for c in pattern)


def trim_zeros(text: Column) -> Column:
    """Without trailing zeros behind a decimal point, and without the point if nothing is left behind it."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def to_user(value: Column, prefix: str) -> Column:
    return value / PREFIX[prefix]


def from_user(value: Column, prefix: str) -> Column:
    return value * PREFIX[prefix]


def int_ranges(text: Column) -> Column:
    """'1,2,5-10' as an array of integers; blanks around the parts are ignored, empty parts dropped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("bigint"), F.element_at(F.split(p, "-"), -1).cast("bigint")))
    return F.flatten(ends)


def key_values(text: Column) -> Column:
    return F.str_to_map(text, F.lit(","), F.lit("="))


def lenient_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "y", "on", "t")


def djb2_xor(text: Column) -> Column:
    """hash = (hash * 33) xor byte from 5381, in 32 bits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: ((h * 33) % (1 << 32)).bitwiseXOR(c.cast("bigint")))


def linear_delay(intrinsic: Column, resistance: Column, load: Column) -> Column:
    return intrinsic + resistance * load


def bus_parts(name: Column, left: str = "[", right: str = "]") -> tuple[Column, Column]:
    """(bus, index) of name[index]; null for a plain name and where the bracket is escaped."""
    p = rf"^(.*[^\\])\{left}(\d+)\{right}$"
    bus = F.regexp_extract(name, p, 1)
    return F.when(bus != "", bus), F.when(bus != "", F.regexp_extract(name, p, 2).try_cast("bigint"))


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def any_input(direction: Column) -> Column:
    return direction.isin("input", "bidirect")


def any_output(direction: Column) -> Column:
    return direction.isin("output", "tristate", "bidirect")


def any_tristate(direction: Column) -> Column:
    return direction == "tristate"


def power_or_ground(direction: Column) -> Column:
    return direction.isin("power", "ground")


def trim_right(text: Column) -> Column:
    return F.rtrim(text)


def special_float(value: Column) -> Column:
    """Doubles as JSON text, special ones as quoted names."""
    return F.when(F.isnan(value), '"NaN"').when(value == float("inf"), '"Infinity"').when(value == float("-inf"), '"-Infinity"').otherwise(value.cast("string"))


def boolean_function(expr: str, ports: dict[str, Column]) -> Column:
    """A Boolean function of ports as a Column: ! ' not, & * and, | + or, ^ xor, 0 1, brackets; ' follows its operand."""
    tokens = re.findall(r"[A-Za-z_]\w*(?:\[\d+\])?|[()!&*|+^']|[01]", expr)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def primary() -> Column:
        t = take()
        if t == "(":
            x = either()
            if peek() != ")":
                raise ValueError(f"a bracket is open in {expr!r}")
            take()
        elif t == "!":
            x = ~primary()
        elif t in ("0", "1"):
            x = F.lit(t == "1")
        elif t in ports:
            x = ports[t]
        else:
            raise ValueError(f"unknown {t!r} in {expr!r}")
        while peek() == "'":
            take()
            x = ~x
        return x

    def differ() -> Column:
        x = primary()
        while peek() == "^":
            take()
            x = x != primary()
        return x

    def both() -> Column:
        x = differ()
        while peek() in ("&", "*"):
            take()
            x = x & differ()
        return x

    def either() -> Column:
        x = both()
        while peek() in ("|", "+"):
            take()
            x = x | both()
        return x

    result = either()
    if at < len(tokens):
        raise ValueError(f"{peek()!r} is left over in {expr!r}")
    return result


def is_via(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 == x2) & (y1 == y2)


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def to_units(value: Column, of: int, to: int) -> Column:
    """Distance conversion by ratio, cut off towards zero."""
    return (value * of / to).cast("bigint")


def domain_key(clock: Column, edge: Column, mix: bool = False) -> Column:
    """Group key of a scan chain's clock domain: a constant if domains may mix."""
    return F.lit(0).cast("bigint") if mix else F.xxhash64(clock, edge)


def effective_pitch(*pitches: Column) -> Column:
    return F.greatest(*pitches)


def shuffled(key: Column, seed: int) -> Column:
    """A sort key that orders rows by a seeded hash: a repeatable shuffle."""
    return F.xxhash64(key, F.lit(seed))
