"""Number checks: plain Python for the text scanners, and column forms where Spark has the parts."""

from __future__ import annotations

import ipaddress
import math
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Issuer prefixes (least, most) and the lengths that they issue.
ISSUERS = [
    (4, 4, (13, 16, 19)),
    (51, 55, (16,)),
    (2221, 2720, (16,)),
    (34, 34, (15,)),
    (37, 37, (15,)),
    (300, 305, (14, 16, 19)),
    (36, 36, (14, 16, 19)),
    (38, 39, (14, 16, 19)),
    (6011, 6011, (16, 19)),
    (644, 649, (16, 19)),
    (65, 65, (16, 19)),
    (3528, 3589, (16, 19)),
    (62, 62, (16, 17, 18, 19)),
    (50, 50, (12, 13, 14, 15, 16, 17, 18, 19)),
    (56, 58, (12, 13, 14, 15, 16, 17, 18, 19)),
    (9792, 9792, (16,)),
]
KEY_LEAST, KEY_CLASSES, KEY_BITS = 12, 2, 3.0


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """At least two digits, spaces and hyphens aside, whose doubled sum ends in 0."""
    bare = number.replace(" ", "").replace("-", "")
    if len(bare) < 2 or digits(bare) != bare:
        return False
    total = sum(int(c) for c in bare[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in bare[-2::-2])
    return total % 10 == 0


def card(number: str) -> bool:
    """A number of a known issuer and length whose check digit holds."""
    if digits(number) != number:
        return False
    fits = any(lo <= int(number[: len(str(lo))] or 0) <= hi and len(number) in sizes for lo, hi, sizes in ISSUERS)
    return fits and luhn(number)


def compact_iban(text: str) -> str:
    return "".join(c for c in text.upper() if c not in " -.")


def _as_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def iban(text: str) -> bool:
    bare = compact_iban(text)
    shaped = 15 <= len(bare) <= 34 and bare.isascii() and bare.isalnum() and bare[:2].isalpha() and bare[2:4].isdigit()
    return shaped and _as_number(bare[4:] + bare[:4]) % 97 == 1


def iban_check_digits(country: str, body: str) -> int:
    return 98 - _as_number(body + country + "00") % 97


def tckn_tail(nine: str) -> str:
    """The two digits that complete a national number's first nine."""
    d = [int(c) for c in nine]
    tenth = (7 * sum(d[0::2]) - sum(d[1::2])) % 10
    return f"{tenth}{(sum(d) + tenth) % 10}"


def tckn(number: str) -> bool:
    return len(number) == 11 and digits(number) == number and number[0] != "0" and number[9:] == tckn_tail(number[:9])


def vkn_tail(nine: str) -> str:
    """The digit that completes a tax number's first nine."""
    total = 0
    for away, c in zip(range(9, 0, -1), nine, strict=True):
        moved = (int(c) + away) % 10
        total += 9 if moved == 9 else moved * 2**away % 9
    return str(-total % 10)


def vkn(number: str) -> bool:
    return len(number) == 10 and digits(number) == number and number[9] == vkn_tail(number[:9])


def names_a_host(text: str, version: int) -> bool:
    """Whether an address is well formed and neither loopback, unspecified nor documentation."""
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return False
    documents = ["192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32"]
    inside = any(address in ipaddress.ip_network(n) for n in documents if ipaddress.ip_network(n).version == address.version)
    return address.version == version and not (address.is_loopback or address.is_unspecified or inside)


def real_date(year: int, month: int, day: int) -> bool:
    if not (1000 <= year <= 9999 and 1 <= month <= 12):
        return False
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return 1 <= day <= (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def entropy(text: str) -> float:
    """Shannon entropy in bits per character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def key_like(body: str) -> bool:
    classes = any("a" <= c <= "z" for c in body) + any("A" <= c <= "Z" for c in body) + any("0" <= c <= "9" for c in body)
    return len(body) >= KEY_LEAST and classes >= KEY_CLASSES and entropy(body) >= KEY_BITS


def luhn_column(number: Column) -> Column:
    bare = F.regexp_replace(number, "[ -]", "")
    return F.coalesce(F.call_function("luhn_check", F.when(bare.rlike("^[0-9]{2,}$"), bare)), F.lit(False))


def iban_column(text: Column) -> Column:
    """The mod-97 rule as a rolling remainder over characters."""
    bare = F.regexp_replace(F.upper(text), r"[ .\-]", "")
    turned = F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: F.when(value(c) > 9, (rest * 100 + value(c)) % 97).otherwise((rest * 10 + value(c)) % 97)
    shaped = bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    return F.coalesce(F.when(shaped, F.aggregate(F.split(turned, ""), F.lit(0), step) == 1), F.lit(False))


def entropy_column(text: Column) -> Column:
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(letters, lambda d: d == c)) / F.size(letters)
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def _digit(number: Column, at: int) -> Column:
    return F.substring(number, at, 1).try_cast("int")


def tckn_tail_column(nine: Column) -> Column:
    """The two digits that complete a national number's first nine, in the JVM."""
    d = [_digit(nine, k) for k in range(1, 10)]
    tenth = F.pmod(7 * (d[0] + d[2] + d[4] + d[6] + d[8]) - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
    return F.concat(tenth.cast("string"), ((sum(d[1:], d[0]) + tenth) % 10).cast("string"))


def tckn_column(number: Column) -> Column:
    return F.coalesce(number.rlike("^[1-9][0-9]{10}$") & (F.substring(number, 10, 2) == tckn_tail_column(number)), F.lit(False))


def vkn_column(number: Column) -> Column:
    """A tax number whose last digit holds, in the JVM."""
    moved = [(_digit(number, k) + 10 - k) % 10 for k in range(1, 10)]
    parts = [F.when(m == 9, 9).otherwise(m * 2 ** (10 - k) % 9) for k, m in enumerate(moved, 1)]
    return F.coalesce(number.rlike("^[0-9]{10}$") & (_digit(number, 10) == F.pmod(-sum(parts[1:], parts[0]), F.lit(10))), F.lit(False))


def card_column(number: Column) -> Column:
    """A number of a known issuer and length whose check digit holds, in the JVM."""
    fits = F.lit(False)
    for lo, hi, sizes in ISSUERS:
        fits = fits | (F.substring(number, 1, len(str(lo))).try_cast("int").between(lo, hi) & F.length(number).isin(*sizes))
    return F.coalesce(fits & luhn_column(number), F.lit(False))


def names_a_host_column(address: Column) -> Column:
    """Whether four numbers between dots are an IPv4 address and neither loopback, unspecified nor documentation, in the JVM."""
    parts = F.transform(F.split(address, r"\."), lambda x: x.cast("int"))
    of_block = F.substring_index(address, ".", 3).isin("192.0.2", "198.51.100", "203.0.113")
    return (F.array_max(parts) <= 255) & ~address.rlike(r"(^|\.)0[0-9]") & (parts[0] != 127) & (address != "0.0.0.0") & ~of_block


def real_date_column(year: Column, month: Column, day: Column) -> Column:
    return F.coalesce(year.between(1000, 9999) & F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0)).isNotNull(), F.lit(False))


def alias_verdict_column(entity: Column, alias: Column) -> Column:
    """Whether an alias passes its type's own check: valid or invalid; unknown where the check needs a list of countries that isn't loaded, no_check for types without one."""
    told = lambda holds: F.when(holds, "valid").otherwise("invalid")
    return (
        F.when(entity == "IBAN", told(iban_column(alias)))
        .when(entity == "TCKN", told(tckn_column(alias)))
        .when(entity == "VKN", told(vkn_column(alias)))
        .when(entity == "CREDIT_CARD", told(luhn_column(alias)))
        .when(entity == "PHONE", "unknown")
        .when(entity.isNotNull(), "no_check")
    )
