"""Where a text's pre-tokens begin, found for a whole block of texts at once and without a regular expression.

Every code point is looked up in an array of classes; with what follows it, the class becomes one of a few symbols.
A symbol is a transition function of an eight-state automaton, and functions compose associatively: the set of all
compositions is closed and small, so a composition is one look-up in a table. A scan by doubling composes each
code point's function with those before it, until every composition is constant, that is, until the state before each
code point is known whatever came earlier. A boundary then follows from the state and the symbol.

The language is that of the vocabulary's public pattern: contractions, then letters, numbers or other signs with at
most one space before them, then white space, whose last sign before a word stands alone.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SHORT, LONG, PREFIX, ALONE, SPACE = range(8)  # symbols
IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_PREFIX, IN_SPACE, ONE_LEFT, TWO_LEFT, CLOSED = range(8)  # states
STATES = 8
#: White space by the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a contraction (fixed values of the pattern).
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: LETTER, NUMBER, OTHER or SPACE."""
    found = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    major = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    found[major == ord("L")] = LETTER
    found[major == ord("N")] = NUMBER
    found[WHITE_SPACE] = SPACE
    return found


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a pre-token begins here)."""
    if symbol == LETTER:
        if state in (IN_LETTERS, AFTER_PREFIX):
            return IN_LETTERS, False
        if state in (ONE_LEFT, TWO_LEFT):
            return (CLOSED if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, True
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_PREFIX)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, AFTER_PREFIX):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE_LEFT, LONG: TWO_LEFT}[symbol], True
    if symbol == PREFIX:
        return AFTER_PREFIX, True
    if symbol == ALONE:
        return CLOSED, True
    return IN_SPACE, state != IN_SPACE


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, at a text's first sign second; composition table; value of each function at CLOSED; constant; begins)."""
    table = np.array([[_step(s, a)[0] for s in range(STATES)] for a in range(8)])
    begins = np.array([[_step(s, a)[1] for a in range(8)] for s in range(STATES)])
    first = np.repeat(table[:, CLOSED : CLOSED + 1], STATES, axis=1)  # a text's first sign: as if nothing came before
    functions = {tuple(f): i for i, f in enumerate(dict.fromkeys(map(tuple, [*table, *first])))}
    generators = np.array([[functions[tuple(f)] for f in rows] for rows in (table, first)], np.uint8)
    known = list(functions)
    done = 0
    while done < len(known):  # close under composition
        done = len(known)
        for f in list(known):
            for g in list(known):
                h = tuple(g[s] for s in f)
                if h not in functions:
                    functions[h] = len(known)
                    known.append(h)
    compose = np.array([[functions[tuple(g[s] for s in f)] for g in known] for f in known], np.uint8)
    constant = np.array([len(set(f)) == 1 for f in known])
    return generators, compose, np.array([f[CLOSED] for f in known], np.uint8), constant, begins


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; first marks the first one of each text."""
    n = len(points)
    s = classes()[points]
    follows = np.zeros(n, bool)  # another sign of the same text comes next
    follows[:-1] = ~first[1:]
    last = (s == SPACE) & follows
    last[:-1] &= s[1:] != SPACE
    at = np.flatnonzero(last)
    mark = np.flatnonzero((points == ord("'")) & follows)
    s[at] = np.where(points[at] == ord(" "), PREFIX, ALONE)
    if len(mark):
        one = points[mark + 1]
        more = np.zeros(len(mark), bool)
        inside = mark + 2 < n
        more[inside] = ~first[mark[inside] + 2]
        two = points[np.minimum(mark + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in ONE_LETTER])
        long = np.zeros(len(mark), bool)
        for a, b in TWO_LETTERS:
            long |= more & (one == ord(a)) & (two == ord(b))
        s[mark[short]] = SHORT
        s[mark[long]] = LONG
    return s


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indexes of the code points at which a pre-token begins; first marks the first code point of each text."""
    if not len(points):
        return np.zeros(0, np.int64)
    of_symbol, compose, value, constant, begins = automaton()
    s = symbols(points, first)
    f = of_symbol[first.view(np.uint8), s]
    step = 1
    while step < len(f) and not constant[f].all():
        f = np.concatenate([f[:step], compose[f[:-step], f[step:]]])
        step *= 2
    before = np.empty(len(f), np.uint8)
    before[0] = CLOSED
    before[1:] = value[f[:-1]]
    before[first] = CLOSED
    return np.flatnonzero(begins[before, s])
