"""Answers as exact numbers.

R1 stays inside the JVM. R2 and R8 read the same lexemes by two small grammars; they need exact rationals, so they run in Python, in
Arrow batches. Their input is capped, so a row's cost is bounded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of texts and numbers, words that make an answer ambiguous, patterns of answers, units that may follow a number.
MAX_TEXT, MAX_NUMBER, MAX_DIGITS, MAX_SIZE = 4096, 64, 20, 10**15
AMBIGUOUS = frozenset("or and between either maybe approximately around about to".split())
PHRASE = r"(?i)(?:the\s+)?(?:final\s+)?answer\s+(?:is|:|=)\s*([-$]?\d[\d,\.]*)"
NUMBER = r"[-+]?\$?\d{1,3}(?:,\d{3})*(?:\.\d+)?|[-+]?\$?\d+(?:\.\d+)?"
UNITS = frozenset("kg m cm meters dollars usd".split())
#: Numbers, with plain ones of more than three digits taken whole.
STRICT_NUMBER = r"[-+]?\$?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\$?\d+(?:\.\d+)?"
#: Lexemes and depth of brackets an expression may have, and its largest power.
MAX_LEXEMES, MAX_DEPTH, MAX_POWER, MAX_EXPONENT = 200, 50, 64, 400


def answer_text(c: Column, strict_numbers: bool = False) -> Column:
    """The part of a completion that gives its answer, inside the JVM.

    One pair of answer tags in order gives its content; other uses of the tags give null. Without tags: the word after the last ####, else the number
    after "answer is", else the last number after the end of thinking. Null, empty and very long texts give null."""
    from millrace.functions.text import SPACE, py_strip

    opened, closed = F.regexp_count(c, F.lit("<answer>")), F.regexp_count(c, F.lit("</answer>"))
    inside = py_strip(F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1))
    proper = (opened == 1) & (closed == 1) & (F.instr(c, "<answer>") < F.instr(c, "</answer>"))
    marked = F.regexp_extract(F.element_at(F.split(c, "####"), -1), rf"^{SPACE}*([^\s\p{{Z}}]+)", 1)
    phrase = F.regexp_extract(c, PHRASE, 1)
    numbers = F.regexp_extract_all(F.element_at(F.split(c, "</think>"), -1), F.lit(STRICT_NUMBER if strict_numbers else NUMBER), F.lit(0))
    fallback = F.when(F.contains(c, F.lit("####")) & (marked != ""), marked).when(phrase != "", phrase).when(F.size(numbers) > 0, F.element_at(numbers, -1))
    return F.when(F.length(c).between(1, MAX_TEXT), F.when((opened > 0) | (closed > 0), F.when(proper, F.nullif(inside, F.lit("")))).otherwise(fallback))


class Lexeme(NamedTuple):
    kind: str  # number, word or sign
    text: str
    glued: bool  # no space before it


_EXPONENT = re.compile(r"[eE]([-+]?\d+)$")
_LEXEME = re.compile(r"(?P<number>(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?)|(?P<word>[^\W\d_]+)|(?P<sign>\S)")
_GROUPED = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?")


def lexemes(text: str) -> list[Lexeme]:
    """Numbers (with their commas, point and exponent), words and single signs of a text."""
    out, end = [], 0
    for m in _LEXEME.finditer(text):
        out.append(Lexeme(m.lastgroup, m.group(), bool(out) and m.start() == end))
        end = m.end()
    return out


def number(text: str) -> Fraction | None:
    """A number lexeme's exact value, commas left out; None for exponents that no answer has."""
    exponent = _EXPONENT.search(text)
    if exponent and abs(int(exponent[1])) > MAX_EXPONENT:
        return None
    return Fraction(text.replace(",", ""))


def _is(lexeme: Lexeme, *texts: str) -> bool:
    return lexeme.text.lower() in texts


def _braced(at: int, items: list[Lexeme]) -> int | None:
    r"""The place after the braces that open at a place, which may not hold others."""
    if at >= len(items) or not _is(items[at], "{"):
        return None
    for k in range(at + 1, len(items)):
        if _is(items[k], "}"):
            return k + 1 if k > at + 1 else None
        if _is(items[k], "{"):
            return None
    return None


def _as_quotient(items: list[Lexeme], at: int = 0) -> tuple[list[Lexeme], list[Lexeme], int] | None:
    r"""Numerator, denominator and the place after a \frac{}{} at a place."""
    if len(items) > at + 1 and _is(items[at], "\\") and items[at + 1].text == "frac":
        middle = _braced(at + 2, items)
        end = middle and _braced(middle, items)
        if end:
            return items[at + 3 : middle - 1], items[middle + 1 : end - 1], end
    return None


class Answer:
    """Grammar of a short answer (R2).

    answer   = { lead } amount
    lead     = "####" | [ "the" ] [ "final" ] "answer" [ "is" | ":" ] | letter "="
    amount   = amount "%" | part "/" part | \\frac "{" amount "}" "{" amount "}" | part
    part     = [ "-" ] [ "$" ] [ sign ] number [ "$" ]  |  words with one plain number among them
    A number with commas groups by three, has no words around it, and no number has a word right behind it."""

    def read(self, text: str) -> Fraction | None:
        items = lexemes(text)
        if sum(c.isdigit() for c in text) > MAX_DIGITS or any(i.kind == "word" and _is(i, *AMBIGUOUS) for i in items):
            return None
        for lead in (self._announced, self._hashes, self._variable):
            items = items[lead(items) :]
        value = self.amount(items)
        return value if value is not None and abs(value) <= MAX_SIZE else None

    @staticmethod
    def _announced(items: list[Lexeme]) -> int:
        at = 0
        for word in ("the", "final"):
            at += at < len(items) and _is(items[at], word)
        if at >= len(items) or not _is(items[at], "answer"):
            return 0
        return at + 1 + (at + 1 < len(items) and _is(items[at + 1], "is", ":"))

    @staticmethod
    def _hashes(items: list[Lexeme]) -> int:
        return 4 if "".join(i.text for i in items[:4]) == "####" else 0

    @staticmethod
    def _variable(items: list[Lexeme]) -> int:
        return 2 if len(items) > 1 and items[0].kind == "word" and len(items[0].text) == 1 and _is(items[1], "=") else 0

    def amount(self, items: list[Lexeme]) -> Fraction | None:
        if not items:
            return None
        if _is(items[-1], "%"):
            whole = self.amount(items[:-1])
            return None if whole is None else whole / 100
        quotient = _as_quotient(items)
        if quotient and quotient[2] == len(items):
            return self._ratio(quotient[0], quotient[1])
        bars = [k for k, i in enumerate(items) if _is(i, "/")]
        if bars:
            return self._ratio(items[: bars[0]], items[bars[0] + 1 :]) if len(bars) == 1 else None
        return self._part(items)

    def _ratio(self, top: list[Lexeme], bottom: list[Lexeme]) -> Fraction | None:
        a, b = self.amount(top), self.amount(bottom)
        return a / b if a is not None and b else None

    def _part(self, items: list[Lexeme]) -> Fraction | None:
        places = [k for k, i in enumerate(items) if i.kind == "number"]
        if len(places) != 1:
            return None
        at = places[0]
        text, before, after = items[at].text, [i.text for i in items[:at]], [i.text for i in items[at + 1 :]]
        alone = "".join(before) in ("", "-", "+", "$", "-$", "$-", "$+") and after in ([], ["$"])
        if "," in before + after or "," in text and not _GROUPED.fullmatch(text) or not alone and ("," in text or not self._free(items, at)):
            return None
        value = number(text)
        return -value if value is not None and "-" in (before if alone else before[-1:]) else value

    @staticmethod
    def _free(items: list[Lexeme], at: int) -> bool:
        """Whether the number at a place stands apart from its neighbours; a sign may touch it before, stops behind it."""
        if at and items[at].glued and (not _is(items[at - 1], "-", "+") or items[at - 1].glued):
            return False
        if at and not items[at].glued and _is(items[at - 1], "-", "+"):
            return at == 1 and _is(items[0], "-")
        behind = at + 1
        while behind < len(items) and items[behind].glued and _is(items[behind], ".", ";", ":", "!", "?"):
            behind += 1
        return behind == len(items) or not items[behind].glued


def exact_number(text: str | None) -> Fraction | None:
    """R2: the number that a short text says without ambiguity, exactly; else None. Null, empty and longer texts give None."""
    return Answer().read(text) if text and len(text) <= MAX_NUMBER else None


def target_number(target: str | None) -> Fraction | None:
    return None if target is None else exact_number(target.rpartition("####")[2])


@F.pandas_udf(T.StructType([T.StructField("num", T.StringType()), T.StructField("den", T.StringType())]))
def exact_number_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        found = [exact_number(x) for x in s]
        yield pd.DataFrame({"num": [None if f is None else str(f.numerator) for f in found], "den": [None if f is None else str(f.denominator) for f in found]})


@F.pandas_udf(T.BooleanType())
def same_number_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """R3 for the text of R1 and a target."""
    for answers, targets in batches:
        yield pd.Series([(a := exact_number(x)) is not None and a == target_number(t) for x, t in zip(answers, targets)])


def accuracy(completion: Column, target: Column, strict_numbers: bool = False) -> Column:
    """Whether a completion's answer equals the target's number, exactly. Null on either side is false."""
    return F.coalesce(same_number_udf(answer_text(completion, strict_numbers), target), F.lit(False))


class Expression:
    """Grammar of an expression (R8), whose names are unknowns.

    expression = [ letter "=" ] sum [ unit ] [ "%" ]
    sum        = product { ("+" | "-") product }
    product    = power { ("*" | "/") power }
    power      = atom [ "^" power ]
    atom       = number | name | "(" sum ")" | \\frac "{" sum "}" "{" sum "}" | ("-" | "+") atom
    Currency signs, commas and spaces say nothing."""

    def __init__(self, text: str) -> None:
        items = [i for i in lexemes(text.lower()) if not _is(i, "$", ",")]
        items = items[2:] if len(items) > 2 and items[0].kind == "word" and len(items[0].text) == 1 and _is(items[1], "=") else items
        self.percent = bool(items) and _is(items[-1], "%")
        items = items[:-1] if self.percent else items
        if len(items) > 1 and items[-1].kind == "word" and items[-1].text in UNITS:
            items = items[:-1]
        self.items = items
        #: What is compared as text.
        self.plain = " ".join(i.text for i in items) + "%" * self.percent

    def names(self) -> set[str]:
        return {i.text for k, i in enumerate(self.items) if i.kind == "word" and not (k and _is(self.items[k - 1], "\\"))}

    def value(self, unknowns: dict[str, Fraction]) -> Fraction | None:
        """The exact value where the unknowns have these; None if this is no such expression or has no value there."""
        if not self.items or len(self.items) > MAX_LEXEMES:
            return None
        try:
            x, at = self._sum(0, 0, unknowns)
        except (ValueError, ZeroDivisionError):
            return None
        return (x / 100 if self.percent else x) if at == len(self.items) else None

    def _at(self, at: int, *texts: str) -> bool:
        return at < len(self.items) and _is(self.items[at], *texts)

    def _chain(self, part, signs: tuple[str, str], at: int, depth: int, unknowns: dict[str, Fraction]) -> tuple[Fraction, int]:
        x, at = part(at, depth, unknowns)
        while self._at(at, *signs):
            first = self._at(at, signs[0])
            y, at = part(at + 1, depth, unknowns)
            x = (x + y if first else x - y) if signs[0] == "+" else (x * y if first else x / y)
        return x, at

    def _sum(self, at: int, depth: int, unknowns: dict[str, Fraction]) -> tuple[Fraction, int]:
        return self._chain(self._product, ("+", "-"), at, depth, unknowns)

    def _product(self, at: int, depth: int, unknowns: dict[str, Fraction]) -> tuple[Fraction, int]:
        return self._chain(self._power, ("*", "/"), at, depth, unknowns)

    def _power(self, at: int, depth: int, unknowns: dict[str, Fraction]) -> tuple[Fraction, int]:
        x, at = self._atom(at, depth, unknowns)
        if not self._at(at, "^"):
            return x, at
        n, at = self._power(at + 1, depth + 1, unknowns)
        if n.denominator != 1 or abs(n) > MAX_POWER:
            raise ValueError("power")
        return x ** int(n), at

    def _atom(self, at: int, depth: int, unknowns: dict[str, Fraction]) -> tuple[Fraction, int]:
        if at >= len(self.items) or depth > MAX_DEPTH:
            raise ValueError("end")
        own = self.items[at]
        if own.kind == "number":
            x = number(own.text)
            if x is None:
                raise ValueError("number")
            return x, at + 1
        if own.kind == "word":
            return unknowns[own.text], at + 1
        if _is(own, "-", "+"):
            x, after = self._atom(at + 1, depth + 1, unknowns)
            return -x if _is(own, "-") else x, after
        if _is(own, "("):
            return self._within("(", ")", at, depth, unknowns)
        if _is(own, "\\") and self._at(at + 1, "frac"):
            top, middle = self._within("{", "}", at + 2, depth, unknowns)
            bottom, after = self._within("{", "}", middle, depth, unknowns)
            return top / bottom, after
        raise ValueError(own.text)

    def _within(self, opened: str, closed: str, at: int, depth: int, unknowns: dict[str, Fraction]) -> tuple[Fraction, int]:
        if not self._at(at, opened):
            raise ValueError(opened)
        x, at = self._sum(at + 1, depth + 1, unknowns)
        if not self._at(at, closed):
            raise ValueError(closed)
        return x, at + 1


def _samples(names: set[str]) -> list[dict[str, Fraction]]:
    """Values for unknowns at which two different quotients of polynomials practically never agree; the same for the same names."""
    return [{n: Fraction(zlib.crc32(f"{n} {k}".encode()) + 2, 65537) for n in names} for k in range(3)] if names else [{}]


def equivalent(a: str | None, b: str | None) -> bool:
    """Equal as text, as exact arithmetic, as floats, or for all values of their unknowns. Null equals nothing."""
    if a is None or b is None:
        return False
    x, y = Expression(a), Expression(b)
    if x.plain == y.plain:
        return True
    for unknowns in _samples(x.names() | y.names()):
        p, q = x.value(unknowns), y.value(unknowns)
        if p is None or q is None or p != q and (unknowns or not _same_float(p, q)):
            return False
    return True


def _same_float(p: Fraction, q: Fraction) -> bool:
    try:
        return float(p) == float(q)
    except OverflowError:
        return False


@F.pandas_udf(T.BooleanType())
def equivalent_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([equivalent(x, y) for x, y in zip(a, b)])


# Pairs that every verifier must find equal.
GOLDEN = [("3/4", "0.75"), ("1,000", "1000"), (r"\frac{1}{2}", "0.5"), ("3.0e5", "300000"), ("42%", "0.42"), ("x = 5", "5"), ("0.500", "0.5"), ("$100", "100"), ("2/3", "4/6"), ("0.25", "1/4"), ("1.5e-2", "0.015"), ("-15", "-15"), ("10 / 2", "5"), (r"\frac{3}{4}", "0.75"), ("100.0", "100")]
#: Pairs that no verifier may find equal.
DIFFERENT = [("1/3", "0.33"), ("50%", "50"), ("x + 1", "x + 2"), ("-15", "15"), ("1/0", "2/0"), ("x^2", "2 * x"), ("3/4", "4/3"), ("", "0")]
