"""Luhn and Verhoeff check digits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Verhoeff multiplication table is that of the dihedral group of order
# ten and is made from its rule; the permutation is one cycle taken to the powers 0 to 7.
CYCLE = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
INVERSE = (0, 4, 3, 2, 1, 5, 6, 7, 8, 9)


def product(a: int, b: int) -> int:
    """The dihedral group: rotations 0 to 4, reflections 5 to 9."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn + 5 * ((a >= 5) != (b >= 5))


PRODUCTS = [product(a, b) for a in range(10) for b in range(10)]


def powers() -> list[int]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([CYCLE[x] for x in rows[-1]])
    return [x for row in rows for x in row]


PERMUTED = powers()


def _ints(values) -> Column:
    return F.array(*map(F.lit, values))


def _backwards(digits: Column) -> Column:
    """The digits as integers, the last first."""
    return F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn_digit(payload: Column) -> Column:
    """The digit that makes payload with it valid."""

    def add(total: Column, x: Column) -> Column:
        doubled = x.getField("d") * 2
        worth = F.when(x.getField("i") % 2 == 0, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(x.getField("d"))
        return total + worth

    placed = F.transform(_backwards(payload), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return ((10 - F.aggregate(placed, F.lit(0), add) % 10) % 10).cast("string")


def _verhoeff(digits: Column, first: int) -> Column:
    placed = F.transform(_backwards(digits), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    step = lambda c, x: F.get(_ints(PRODUCTS), c * 10 + F.get(_ints(PERMUTED), (x.getField("i") + first) % 8 * 10 + x.getField("d")))
    return F.aggregate(placed, F.lit(0), step)


def verhoeff_digit(payload: Column) -> Column:
    return F.get(_ints(INVERSE), _verhoeff(payload, 1)).cast("string")


def _all_digits(number: Column) -> Column:
    return number.rlike("^[0-9]{2,}$")


def luhn_valid(number: Column) -> Column:
    return F.when(_all_digits(number), F.call_function("luhn_check", number)).otherwise(False)


def verhoeff_valid(number: Column) -> Column:
    return F.when(_all_digits(number), _verhoeff(number, 0) == 0).otherwise(False)


def _without_last(number: Column) -> Column:
    return F.substring(number, F.lit(1), F.length(number) - 1)


def luhn_fix(number: Column) -> Column:
    payload = _without_last(number)
    return F.concat(payload, luhn_digit(payload))


def verhoeff_fix(number: Column) -> Column:
    payload = _without_last(number)
    return F.concat(payload, verhoeff_digit(payload))


def recompute(entity_type: Column, digits: Column) -> Column:
    """The check digit of the type, if it has one, put right."""
    kind = F.upper(entity_type)
    return F.when((kind == "CREDIT_CARD") & (F.length(digits) >= 2), luhn_fix(digits)).when((kind == "AADHAAR") & (F.length(digits) == 12), verhoeff_fix(digits)).otherwise(digits)


def luhn_ok(number: str) -> bool:
    """For Arrow functions: is a string of two digits or more valid?"""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(number) >= 2 and total % 10 == 0


def verhoeff_ok(number: str) -> bool:
    c = 0
    for i, d in enumerate(reversed(number)):
        c = PRODUCTS[10 * c + PERMUTED[i % 8 * 10 + int(d)]]
    return len(number) >= 2 and c == 0
