"""Splitting of texts by the pattern of byte-level BPE tokenizers, over whole slices at once.

The pattern takes contractions, runs of letters, digits or other signs with one space before them,
and white space. Texts whose characters all lie below U+0250 are split with numpy by the classes of
their bytes; any other text is split with the pattern itself.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from orderloom.llm.common import Slice, byte_strings

SPACE, LETTER, DIGIT, OTHER, FAR = 0, 1, 2, 3, 4


def _kind(character: str) -> int:
    if character in "\t\n\x0b\x0c\r \x85\xa0":
        return SPACE
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(character)[0], OTHER)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    one = np.full(256, FAR, np.uint8)
    one[:128] = [_kind(chr(c)) for c in range(128)]
    two = np.full((256, 256), FAR, np.uint8)
    for code in range(0x80, 0x250):
        lead, tail = chr(code).encode()
        two[lead, tail] = _kind(chr(code))
    return one, two


ONE, TWO = _tables()


def _classes(data: np.ndarray) -> np.ndarray:
    kinds = ONE[data]
    leads = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    leads = leads[leads + 1 < len(data)]
    pair = TWO[data[leads], data[leads + 1]]
    kinds[leads] = pair
    kinds[leads + 1] = pair
    return kinds


def _near(data: np.ndarray, begins: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where a pre-token starts, for texts below U+0250; begins: the first byte of each text."""
    n = len(data)
    tail = (data & 0xC0) == 0x80
    run = np.ones(n, bool)
    run[1:] = kinds[1:] != kinds[:-1]
    run |= begins
    opens = run.copy()
    last = np.ones(n, bool)  # the next text begins after this byte
    last[:-1] = begins[1:]
    white = kinds == SPACE
    # White space before something else gives its last character away: alone, or joined if a blank.
    ends = np.flatnonzero(white & ~last & np.concatenate([run[1:], [True]]))
    final = ends - tail[ends]
    opens[final] = True
    blank = data[ends] == 0x20
    opens[ends[blank] + 1] = False
    # A contraction stands where a run of signs starts with an apostrophe and no blank joined it.
    for suffix in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        at = np.flatnonzero((data == 0x27) & opens)
        at = at[at + len(suffix) < n]
        hit = np.ones(len(at), bool)
        for k, byte in enumerate(suffix):
            hit &= (data[at + 1 + k] == byte) & ~begins[at + 1 + k]
        at = at[hit]
        opens[at + 1] = False
        after = at + 1 + len(suffix)
        opens[after[after < n]] = True
    return opens


def split(part: Slice, pattern=None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a slice, the index of each pre-token, where each text starts, odd texts.

    Odd texts have characters from U+0250 on. Without a pattern their pre-tokens make no sense.
    """
    kinds = _classes(part.data)
    # Searches instead of running sums, which would take eight bytes for each byte of text.
    far = np.searchsorted(np.flatnonzero(kinds == FAR), part.offsets)
    odd = np.flatnonzero(far[1:] > far[:-1])
    begins = np.zeros(len(part.data) + 1, bool)
    begins[part.offsets] = True
    opens = _near(part.data, begins[:-1], kinds) if len(part.data) else np.zeros(0, bool)
    for row in odd if pattern else ():
        low = int(part.offsets[row])
        text = part.text(row).decode()
        opens[low : int(part.offsets[row + 1])] = False
        for found in pattern.finditer(text):
            opens[low] = True
            low += len(found[0].encode())
    first = np.flatnonzero(opens)
    starts = np.searchsorted(first, part.offsets).astype(np.int64)
    if not len(first):
        return pa.array([], pa.binary()), np.zeros(0, np.int32), starts, odd
    encoded = byte_strings(part.data, np.concatenate([first, [len(part.data)]])).dictionary_encode()
    return encoded.dictionary, np.array(encoded.indices), starts, odd
