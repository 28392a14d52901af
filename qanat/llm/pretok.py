"""Pre-tokenisation without regex: code-point classes and a transition-function scan.

The split pattern (contractions, optional-space letter / number / other runs,
white space that leaves its last character to what follows) is a finite
automaton once every character is given a class that already knows its right
neighbours. Each class is a function state -> state; functions compose
associatively, so the state before every character is a prefix "sum" of
functions. The scan runs over many blocks of text side by side: all blocks
advance one character per step, then block totals are composed, and the
incoming state of each block selects the states inside it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# character classes
LETTER, NUMBER, OTHER, APO2, APO3, SPACE_LAST, WHITE_LAST, WHITE_MORE, RESET = range(9)
# states: what the character before belongs to
FRESH, IN_L, IN_N, IN_O, AFTER_SPACE, AFTER_WHITE, IN_WHITE, C_ONE, C_TWO = range(9)

# fixed values: characters with the White_Space property
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
               0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next state and "a token starts at this character", by state and class."""
    step = np.zeros((9, 9), np.uint8)
    start = np.zeros((9, 9), bool)
    run = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, APO2: IN_O, APO3: IN_O}
    for s in range(9):
        for c in range(9):
            if c == RESET:
                step[s, c], start[s, c] = FRESH, True
            elif s in (C_ONE, C_TWO):  # inside a contraction: only its letters can follow
                step[s, c] = C_ONE if s == C_TWO else FRESH
            elif c in run:
                joins = s == AFTER_SPACE or s == run[c]
                if c in (APO2, APO3) and not joins:
                    step[s, c], start[s, c] = (C_ONE if c == APO2 else C_TWO), True
                else:
                    step[s, c], start[s, c] = run[c], not joins
            elif c == SPACE_LAST:
                step[s, c], start[s, c] = AFTER_SPACE, True
            elif c == WHITE_LAST:
                step[s, c], start[s, c] = AFTER_WHITE, True
            else:
                step[s, c], start[s, c] = IN_WHITE, s != IN_WHITE
    return step, start


STEP, START = _automaton()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that compositions of the classes reach: class -> function,
    (function, class) -> function, and function -> its images of the states."""
    known = {bytes(range(9)): 0}
    images, table, at = [bytes(range(9))], [], 0
    while at < len(images):
        row = []
        for c in range(9):
            f = bytes(int(STEP[s, c]) for s in images[at])
            if f not in known:
                known[f] = len(images)
                images.append(f)
            row.append(known[f])
        table.append(row)
        at += 1
    compose = np.array(table, np.uint16)
    return compose[0], compose, np.frombuffer(b"".join(images), np.uint8).reshape(-1, 9)


_, COMPOSE, IMAGE = _monoid()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, before its neighbours are looked at."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE_MORE
    return out


def _after(a: np.ndarray, k: int) -> np.ndarray:
    """The value k places on; 0 past the end."""
    out = np.zeros_like(a)
    out[:len(a) - k] = a[k:]
    return out


def refine(points: np.ndarray) -> np.ndarray:
    """Classes that know what follows. Texts are separated by one code point 0x110000."""
    end = points == 0x110000
    c = classes()[np.where(end, 0, points)]
    c[end] = RESET
    white = c == WHITE_MORE
    follows = np.zeros(len(c), bool)  # by something that is not white space, in the same text
    follows[:-1] = ~white[1:] & ~end[1:]
    c[white & follows] = WHITE_LAST
    c[white & follows & (points == 0x20)] = SPACE_LAST
    apo = np.flatnonzero(points == 0x27)
    if len(apo):
        a, b = _after(points, 1)[apo], _after(points, 2)[apo]
        is_ = lambda x, s: np.isin(x, [ord(y) for y in s])
        c[apo[is_(a, "stmd")]] = APO2
        c[apo[is_(a, "rv") & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = APO3
    return c


def boundaries(points: np.ndarray, block: int = 512) -> np.ndarray:
    """True where a token (or a separator) starts."""
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    c = refine(points)
    rows = -(-n // block)
    padded = np.full(rows * block, RESET, np.uint8)
    padded[:n] = c
    grid = np.ascontiguousarray(padded.reshape(rows, block).T)
    # before[j]: the function of a block's characters ahead of its j-th
    before = np.zeros((block + 1, rows), np.uint16)
    for j in range(block):
        before[j + 1] = COMPOSE[before[j], grid[j]]
    into = np.zeros(rows, np.uint8)
    state = FRESH
    for k, image in enumerate(IMAGE[before[block]]):
        into[k], state = state, int(image[state])
    states = IMAGE[before[:block], into[None, :]]
    return START[states, grid].T.reshape(-1)[:n]
