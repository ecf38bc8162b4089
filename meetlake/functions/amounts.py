"""Chinese amounts in digits."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SMALL = {"十": 10, "百": 100, "千": 1000}
LARGE = {"萬": 10_000, "万": 10_000, "億": 100_000_000, "亿": 100_000_000}
RUN = re.compile(r"[0-9]+(?:\.[0-9]+)?[千萬万億亿]+|[一二兩两三四五六七八九十][零〇一二兩两三四五六七八九十百千萬万億亿]*")
PART = re.compile(r"([零〇]*)([一二兩两三四五六七八九]?)([十百千]?)")


def below(text: str, spoken: int) -> int | None:
    """The value of digits with units below ten thousand; a bare digit at the end is the next unit down (``spoken`` after none, if not 0)."""
    value, last, at = 0, spoken, 0
    while at < len(text):
        zeros, digit, unit = PART.match(text, at).groups()
        at += len(zeros) + len(digit) + len(unit)
        if unit:
            if not digit and unit != "十":
                return None
            value, last = value + DIGITS.get(digit, 1) * SMALL[unit], SMALL[unit]
        elif digit:
            if at < len(text):
                return None  # digits in a row are no number
            value += DIGITS[digit] * (1 if zeros or not last else max(last // 10, 1))
        elif not zeros:
            return None
    return value


def amount(text: str) -> int | None:
    """A run's value: 八萬二 is 82,000, 四千五 4,500, 一萬零五 10,005; null if it is no number."""
    if text[0].isascii():
        number = re.match(r"[0-9.]+", text)[0]
        value = float(number)
        for unit in text[len(number) :]:
            value *= (SMALL | LARGE)[unit]
        return round(value)
    total, spoken = 0, 0
    for part, unit in re.findall(r"([^萬万億亿]*)([萬万億亿]|$)", text):
        if not unit:
            rest = below(part, spoken) if part else 0
            return None if rest is None else total + rest
        value = below(part, 0)
        if value is None or not (value or unit in "億亿" and total):
            return None
        total = (total + value) * LARGE[unit] if unit in "億亿" else total + value * LARGE[unit]
        spoken = LARGE[unit]
    return total


def in_digits(text: str | None) -> str | None:
    """Amounts of a thousand and more in digits with commas."""
    def shown(match: re.Match) -> str:
        value = amount(match[0])
        return f"{value:,}" if value is not None and value >= 1000 else match[0]

    return None if text is None else RUN.sub(shown, text)


@F.pandas_udf(T.StringType())
def amounts_in_digits(texts: pd.Series) -> pd.Series:
    """in_digits() of a column of excerpts."""
    return texts.map(in_digits)
