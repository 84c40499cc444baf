"""Checks of matched values, as predicates on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def ssn(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 9) & ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def chinese_id(value: Column) -> Column:
    """18 characters: plausible birth date and the ISO 7064 MOD 11-2 check character."""
    v = F.upper(F.trim(value))
    year, month, day = (F.substring(v, a, n).cast("int") for a, n in ((7, 4), (11, 2), (13, 2)))
    # The weight of place i is 2 to the power 18 - i, modulo 11.
    total = F.aggregate(F.sequence(F.lit(1), F.lit(17)), F.lit(0), lambda acc, i: acc + F.substr(v, i, F.lit(1)).cast("int") * (F.pow(F.lit(2), 18 - i).cast("int") % 11))
    check = F.substr(F.lit("10X98765432"), total % 11 + 1, F.lit(1))
    shape = v.rlike("^[0-9]{17}[0-9X]$")
    return shape & F.when(shape, year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31) & (F.substring(v, 18, 1) == check)).otherwise(False)


def us_phone(value: Column) -> Column:
    d = digits(value)
    at = F.when(F.length(d) == 11, 2).otherwise(1)
    area, exchange = F.substr(d, at, F.lit(3)), F.substr(d, at + 3, F.lit(3))
    fictional = (area == "555") & exchange.startswith("1")
    return F.length(d).isin(10, 11) & ~F.substr(area, F.lit(1), F.lit(1)).isin("0", "1") & ~fictional


def international_phone(value: Column) -> Column:
    return F.length(digits(value)).between(8, 15)


def china_mobile(value: Column) -> Column:
    return digits(value).rlike("^1(3[0-9]|4[5-9]|5[0-35-9]|6[2567]|7[0-8]|8[0-9]|9[0-35-9])[0-9]{8}$")


VALIDATORS = {"luhn": luhn, "ssn": ssn, "chinese_id": chinese_id, "us_phone": us_phone, "international_phone": international_phone, "china_mobile": china_mobile}
