"""portable_hash() of many messages at once, in arrays of 32-bit words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
# arrays without a dimension: ufuncs take them faster than numbers
_LEFT, _RIGHT, _PLAIN = ([np.array(x, np.uint32) for x in xs] for xs in (_TURNS, [32 - t for t in _TURNS], _ADDED))

Word = int | np.ndarray


def _spread(x: Word, lanes: int, added: Word = 0) -> np.ndarray:
    """x + added for each lane."""
    return np.add(*[np.uint32(w) if isinstance(w, int) else w for w in (x, added)], out=np.empty(lanes, np.uint32))


def _mix(i: int, b: int, c: int, d: int) -> int:
    return (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | (d ^ 0xFFFFFFFF)))[i // 16]


def _mix_arrays(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if i < 16:
        np.bitwise_xor(c, d, out)
        np.bitwise_and(out, b, out)
        np.bitwise_xor(out, d, out)
    elif i < 32:
        np.bitwise_xor(b, c, out)
        np.bitwise_and(out, d, out)
        np.bitwise_xor(out, c, out)
    elif i < 48:
        np.bitwise_xor(b, c, out)
        np.bitwise_xor(out, d, out)
    else:
        np.invert(d, out)
        np.bitwise_or(out, b, out)
        np.bitwise_xor(out, c, out)


def _block(state: list[Word], words: list[Word], lanes: int, last: bool) -> list[Word]:
    """The state after a block. What is one number for all messages is reckoned once. After the last block only the first word
    counts, which the last three steps leave as it is."""
    a, b, c, d = state
    i, steps = 0, 61 if last else 64
    while i < steps and all(isinstance(x, int) for x in (a, b, c, d, words[_WORD[i]])):
        x = (a + _mix(i, b, c, d) + _ADDED[i] + words[_WORD[i]]) & 0xFFFFFFFF
        a, b, c, d = d, (b + (x << _TURNS[i] | x >> 32 - _TURNS[i])) & 0xFFFFFFFF, b, c
        i += 1
    if i < steps:
        a, b, c, d = (_spread(x, lanes) for x in (a, b, c, d))
        out = np.empty(lanes, np.uint32)
    while i < steps:
        _mix_arrays(i, b, c, d, out)
        np.add(out, a, out)
        word = words[_WORD[i]]
        if isinstance(word, int):
            np.add(out, np.array(_ADDED[i] + word & 0xFFFFFFFF, np.uint32) if word else _PLAIN[i], out)
        else:
            np.add(out, _PLAIN[i], out)
            np.add(out, word, out)
        np.left_shift(out, _LEFT[i], a)
        np.right_shift(out, _RIGHT[i], out)
        np.bitwise_or(a, out, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
        i += 1
    if last:
        a, b, c, d = b, c, d, a  # as the three steps would turn them
    return [x + y & 0xFFFFFFFF if isinstance(x, int) and isinstance(y, int) else _spread(x, lanes, y) for x, y in zip((a, b, c, d)[: 1 if last else 4], state, strict=False)]


def same_length(first: int, last: int) -> Iterator[tuple[int, int]]:
    """Parts [from, to) of the whole numbers [first, last) with equally many digits."""
    while first < last:
        end = min(last, 10 ** len(str(first)))
        yield first, end
        first = end


def digit_words(numbers: np.ndarray, at: int) -> dict[int, Word]:
    """What the digits of numbers with equally many digits add to the words of a message, from its byte `at` on."""
    found: dict[int, np.ndarray] = {}
    count = len(str(int(numbers[0])))
    for j in range(count):
        digit = (numbers // 10 ** (count - 1 - j) % 10 + 48).astype(np.uint32) << np.uint32(8 * ((at + j) % 4))
        word = (at + j) // 4
        found[word] = found[word] + digit if word in found else digit
    return {w: int(x[0]) if (x == x[0]).all() else x for w, x in found.items()}


def hashes(starts: list[bytes], digits: dict[int, Word], count: int, numbers: int) -> np.ndarray:
    """The first 32 bits of the MD5 of each start (of one length) followed by each of `numbers` numbers of `count` digits, whose
    digit_words() from the end of the starts on are `digits`: a row for each start."""
    rows, length = len(starts), len(starts[0]) + count
    size = (length + 8) // 64 * 64 + 64
    ends = b"\0" * count + b"\x80" + b"\0" * (size - length - 9) + (8 * length).to_bytes(8, "little")
    fixed = np.frombuffer(b"".join(s + ends for s in starts), "<u4").reshape(rows, -1)
    words: list[Word] = []
    for w, column in enumerate(fixed.T):
        own, added = int(column[0]), digits.get(w, 0)
        if (column != own).any():
            own = np.repeat(column, numbers)
        if not isinstance(added, int) and rows > 1:
            added = np.tile(added, rows)
        words.append(own + added if isinstance(own, int) and isinstance(added, int) else _spread(own, rows * numbers, added))
    state: list[Word] = list(_START)
    for at in range(0, len(words), 16):
        state = _block(state, words[at : at + 16], rows * numbers, at + 16 == len(words))
    head = _spread(state[0], rows * numbers)
    return head.byteswap(inplace=True).reshape(rows, numbers)
