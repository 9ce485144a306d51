"""Unit expressions: a small grammar for numbers and units in text, dimensions as exponent vectors, scale and offset.

    expression := term (('*' | '/' | '.' | blank) term)*
    term       := number | unit ['^'] [integer] | '(' expression ')'

A unit is a name or symbol of ``UNITS``, perhaps with a decimal prefix. The result has a factor and an offset to the
coherent unit of its dimension (metre, second, kelvin ...): canonical = value * factor + offset.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

#: Exponents of length, mass, time, current, temperature, amount, luminous intensity.
DIMENSIONS = ("m", "kg", "s", "A", "K", "mol", "cd")
NONE = (0,) * 7
LENGTH = (1, 0, 0, 0, 0, 0, 0)
ENERGY = (2, 1, -2, 0, 0, 0, 0)
BOHR_M = 0.529177e-10


@dataclass(frozen=True)
class Unit:
    factor: float
    dims: tuple[int, ...] = NONE
    offset: float = 0.0

    def times(self, other: Unit, sign: int = 1) -> Unit:
        return Unit(self.factor * other.factor**sign, tuple(a + sign * b for a, b in zip(self.dims, other.dims, strict=True)))

    def power(self, n: int) -> Unit:
        return Unit(self.factor**n, tuple(a * n for a in self.dims))


def _dims(**exponents: int) -> tuple[int, ...]:
    return tuple(exponents.get(d, 0) for d in DIMENSIONS)


# Names and symbols of units, with factor to the coherent unit, dimension and offset.
UNITS = {
    ("m", "metre", "meter", "metres", "meters"): Unit(1.0, LENGTH),
    ("angstrom", "angstroms", "ang", "å", "a", "angstroem"): Unit(1e-10, LENGTH),
    ("bohr", "bohrs", "a0", "a.u", "au", "bohr radius", "bohr radii", "atomic unit", "atomic units", "atomic length unit", "atomic length units"): Unit(BOHR_M, LENGTH),
    ("inch", "inches", "in"): Unit(0.0254, LENGTH),
    ("s", "sec", "second", "seconds"): Unit(1.0, _dims(s=1)),
    ("min", "minute", "minutes"): Unit(60.0, _dims(s=1)),
    ("h", "hour", "hours", "hrs"): Unit(3600.0, _dims(s=1)),
    ("g", "gram", "grams"): Unit(1e-3, _dims(kg=1)),
    ("k", "kelvin"): Unit(1.0, _dims(K=1)),
    ("°c", "degc", "celsius"): Unit(1.0, _dims(K=1), 273.15),
    ("°f", "degf", "fahrenheit"): Unit(5 / 9, _dims(K=1), 459.67 * 5 / 9),
    ("mol", "mole", "moles"): Unit(1.0, _dims(mol=1)),
    ("j", "joule", "joules"): Unit(1.0, ENERGY),
    ("cal", "calorie", "calories"): Unit(4.184, ENERGY),
    ("ev", "electronvolt"): Unit(1.602176634e-19, ENERGY),
    ("hartree", "hartrees"): Unit(4.3597447222071e-18, ENERGY),
    ("n", "newton"): Unit(1.0, _dims(m=1, kg=1, s=-2)),
    ("pa", "pascal"): Unit(1.0, _dims(m=-1, kg=1, s=-2)),
    ("bar",): Unit(1e5, _dims(m=-1, kg=1, s=-2)),
    ("v", "volt"): Unit(1.0, _dims(m=2, kg=1, s=-3, A=-1)),
    ("e", "elementary charge"): Unit(1.602176634e-19, _dims(s=1, A=1)),
}
PREFIXES = {"femto": 1e-15, "pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "kilo": 1e3, "mega": 1e6, "f": 1e-15, "p": 1e-12, "n": 1e-9, "µ": 1e-6, "u": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3}
NUMBER_WORDS = {"one": 1.0, "two": 2.0, "ten": 10.0, "hundred": 100.0, "thousand": 1000.0}
#: Names that take a decimal prefix.
PREFIXABLE = {"m", "metre", "meter", "metres", "meters", "s", "sec", "second", "seconds", "g", "gram", "grams", "mol", "j", "joule", "joules", "cal", "ev", "n", "pa", "v", "bar"}

BY_NAME = {name: unit for names, unit in UNITS.items() for name in names}
NUMBER = r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
TOKEN = re.compile(rf"\s*({NUMBER}|[^\W\d_]+\.?[^\W\d_]*\d?|°[cCfF]|\^|[*/().·×-])")


@lru_cache(maxsize=4096)
def unit_named(name: str) -> Unit | None:
    """A unit by its name or symbol, whatever the case, with or without a decimal prefix."""
    n = unicodedata.normalize("NFC", name).casefold().strip(" .")
    n = n.replace("ö", "o") if "ngstr" in n else n
    n = "angstrom" if n in ("ångstrom", "ångström") else n
    if n in BY_NAME:
        return BY_NAME[n]
    for prefix, factor in PREFIXES.items():
        rest = n[len(prefix) :].lstrip("-")
        if n.startswith(prefix) and rest in PREFIXABLE:
            u = BY_NAME[rest]
            return Unit(factor * u.factor, u.dims)
    return None


class _Parser:
    def __init__(self, text: str):
        text = unicodedata.normalize("NFKC", text)
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"no unit expression: {text!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def expression(self) -> Unit:
        left = self.term()
        while (t := self.peek()) not in (None, ")"):
            if t in "*·×./":
                self.take()
                left = left.times(self.term(), -1 if t == "/" else 1)
            else:
                left = left.times(self.term())
        return left

    def term(self) -> Unit:
        t = self.take() if self.peek() is not None else ""
        if t == "(":
            inner = self.expression()
            if self.peek() != ")":
                raise ValueError("a bracket is not closed")
            self.take()
            return inner
        if re.fullmatch(NUMBER, t):
            return Unit(float(t.replace(",", ".")))
        if t.casefold() in NUMBER_WORDS:
            return Unit(NUMBER_WORDS[t.casefold()])
        # the longest name of several words counts: "bohr radii", "nano-m"
        for n in (3, 2, 1, 0):
            words = self.tokens[self.at : self.at + n]
            for joined in {" ".join([t, *words]), "".join([t, *words])}:
                if len(words) == n and (u := unit_named(joined)):
                    self.at += n
                    return self.powered(u)
        raise ValueError(f"no unit: {t!r}")

    def powered(self, u: Unit) -> Unit:
        hat = self.peek() == "^"
        if hat:
            self.take()
        if hat and self.peek() and re.fullmatch(r"[-+]?\d+", self.peek()):
            return u.power(int(self.take()))
        return u


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> Unit | None:
    """The unit that ``text`` spells, or None if it is no unit expression (null, blank, "unknown" ...)."""
    if not text or not text.strip():
        return None
    text = re.sub(r"\(\s*length\s*\)", "", text.strip().rstrip("."))
    try:
        p = _Parser(text)
        u = p.expression()
        return u if p.peek() is None and u.dims != NONE else None
    except (ValueError, IndexError):
        return None


_UNIT_WORD = r"[^\W\d_][\w.\-]*(?:\s+radii)?"
_PHRASES = [
    (re.compile(rf"1\s+unit\s*=\s*({NUMBER})\s*({_UNIT_WORD})", re.I), 1),
    (re.compile(rf"({NUMBER}|ten|hundred|thousand)\s+units?\s+makes?\s+(?:one|1)\s+({_UNIT_WORD})", re.I), -1),
    (re.compile(rf"x\s*({NUMBER})\s+(?:against|over|relative to)\s+({_UNIT_WORD})", re.I), -1),
]
#: What says how a program took the values, not how they were written.
_HEARSAY = re.compile(r"\btaken as\b|\bassumed\b|\(not\s[^)]*\)|\bnot\s+\w+", re.I)


@lru_cache(maxsize=65536)
def unit_in_text(text: str | None, dims: tuple[int, ...] = LENGTH) -> Unit | None:
    """The unit of dimension ``dims`` that a free text states for its values, or None.

    "1 unit = 10 angstrom", "ten units make one nm" and "x1000 against nm" are read with their number. Otherwise the one
    unit that the text names counts; what it only denies or assumes ("not nm", "taken as nm") and texts that name several
    different units state nothing.
    """
    if not text or not text.strip():
        return None
    text = unicodedata.normalize("NFKC", text)
    for pattern, sign in _PHRASES:
        if m := pattern.search(text):
            u, k = unit_named(m[2]), parse_number(m[1])
            if u and u.dims == dims and k:
                return Unit(u.factor * k**sign, dims)
    clause = _HEARSAY.split(text)
    if len(clause) > 1 and re.search(r"taken as|assumed", text, re.I):
        return None
    words = re.findall(r"[^\W\d_]+[\d.]?(?:-[^\W\d_]+)?", " ".join(clause))
    found = set()
    for i, w in enumerate(words):
        pair = f"{w} {words[i + 1]}" if i + 1 < len(words) else ""
        if len(w) == 1 and w not in ("Å", "Å") and not re.search(rf"(?:coords|coordinates|units?|lengths?)\s*(?::|in|are)\s*{re.escape(w)}\b", text):
            continue  # an article or initial rather than a symbol
        if len(w) == 2 and w.casefold() in ("in", "au", "pa", "min"):
            continue
        u = unit_named(pair) if pair else None
        u = u or unit_named(w)
        if u and u.dims == dims and u.factor < 1e-3:
            found.add(u)
    return found.pop() if len(found) == 1 else None


def parse_number(text: str) -> float | None:
    """A number written with digits or as a word."""
    t = text.strip().casefold()
    if t in NUMBER_WORDS:
        return NUMBER_WORDS[t]
    return float(t.replace(",", ".")) if re.fullmatch(NUMBER, t) else None
