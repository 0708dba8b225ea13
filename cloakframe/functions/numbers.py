"""Checks on numbers, once in Python for the detectors' UDF and once as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calling codes outside zone 1 (E.164), ascending within their zones.
CALLING_CODES = frozenset(
    """20 27 211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245
    246 247 248 249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 30 31 32 33 34 36 39 350 351 352 353 354
    355 356 357 358 359 370 371 372 373 374 375 376 377 378 379 380 381 382 383 385 386 387 389 40 41 43 44 45 46 47 48 49 420 421 423 51
    52 53 54 55 56 57 58 590 591 592 593 594 595 596 597 598 599 60 61 62 63 64 65 66 670 672 673 674 675 676 677 678 679 680 681 682 683
    685 686 687 688 689 690 691 692 7 81 82 84 86 850 852 853 855 856 880 886 90 91 92 93 94 95 98 960 961 962 963 964 965 966 967 968 970
    971 972 973 974 975 976 977 992 993 994 995 996 998""".split()
)
SUBSCRIBER = (4, 12)


def dihedral() -> list[list[int]]:
    """The multiplication table of the dihedral group D5: rotations 0-4, reflections 5-9."""

    def times(a: int, b: int) -> int:
        turn = (a % 5 - b % 5) if a >= 5 else (a % 5 + b % 5)
        return turn % 5 + 5 * ((a >= 5) != (b >= 5))

    return [[times(a, b) for b in range(10)] for a in range(10)]


def permutations() -> list[list[int]]:
    """The powers 0 to 7 of the digit permutation of the checksum."""
    step, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    while len(rows) < 8:
        rows.append([step[x] for x in rows[-1]])
    return rows


TIMES, POWERS = dihedral(), permutations()


def verhoeff(digits: str) -> bool:
    """Whether the last digit is the Verhoeff check digit of those before it."""
    c = 0
    for i, d in enumerate(reversed(digits)):
        c = TIMES[c][POWERS[i % 8][int(d)]]
    return c == 0


def verhoeff_column(digits: Column) -> Column:
    table = F.array(*[F.array(*map(F.lit, row)) for row in TIMES])
    power = F.array(*[F.array(*map(F.lit, row)) for row in POWERS])
    places = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.struct(x.cast("int").alias("d"), i.alias("i")))
    places = F.filter(places, lambda x: x["d"].isNotNull())
    return F.aggregate(places, F.lit(0), lambda c, x: F.element_at(F.element_at(table, c + 1), F.element_at(F.element_at(power, (x["i"] % 8 + 1).cast("int")), x["d"] + 1) + 1)) == 0


def run_of_digits(digits: str) -> bool:
    """Whether digits are all the same, or rise or fall by one throughout."""
    steps = {ord(b) - ord(a) for a, b in zip(digits, digits[1:], strict=False)}
    return bool(digits) and (not steps or steps in ({0}, {1}, {-1}))


def run_of_digits_column(digits: Column) -> Column:
    codes = F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), lambda x: x.cast("int"))
    n = F.size(codes)
    steps = F.array_distinct(F.zip_with(F.slice(codes, 2, F.greatest(n - 1, F.lit(0))), F.slice(codes, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a))
    return (n > 0) & ((F.size(steps) == 0) | ((F.size(steps) == 1) & F.element_at(steps, F.when(F.size(steps) > 0, 1).otherwise(F.lit(None).cast("int"))).between(-1, 1)))


def calling_code(digits: str) -> tuple[str, str] | None:
    """(calling code, rest) by the longest code that fits."""
    return next(((digits[:n], digits[n:]) for n in (3, 2, 1) if len(digits) > n and digits[:n] in CALLING_CODES), None)


def calling_code_column(digits: Column) -> Column:
    """The calling code alone; null if none fits."""
    codes = sorted(CALLING_CODES)
    fits = [F.when((F.length(digits) > n) & F.substring(digits, 1, n).isin(*[c for c in codes if len(c) == n]), F.substring(digits, 1, n)) for n in (3, 2, 1)]
    return F.coalesce(*fits)


def intl_phone(text: str) -> tuple[str, str] | None:
    """(calling code, subscriber number) of an international number."""
    found = calling_code("".join(c for c in text if "0" <= c <= "9"))
    if not found or not SUBSCRIBER[0] <= len(found[1]) <= SUBSCRIBER[1] or run_of_digits(found[1]):
        return None
    return found
