r"""Scanners of nested text that flat patterns can't read: delimited math in running text, formulas as operator trees, and the
JSON of listwise answers. Each is linear in the text, keeps its open brackets on a stack of its own (no recursion), and is called on
Arrow batches.

Math in a text is delimited by one of six forms. A form that never closes is text. A formula is read by operator
precedence: relations, sums, products (also without a sign), functions, fractions and roots, scripts; what is out of place is left
out rather than refused, and brackets left open close at the end.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six forms of delimited math, by opening mark, with the marks that close them.
FORMS = {
    "$$": ("$$",),
    "$": ("$",),
    r"\[": (r"\]",),
    r"\(": (r"\)",),
    **dict.fromkeys((r"\begin{equation}", r"\begin{equation*}"), (r"\end{equation}", r"\end{equation*}")),
    **dict.fromkeys((r"\begin{align}", r"\begin{align*}"), (r"\end{align}", r"\end{align*}")),
}
_OPENING = re.compile("|".join(re.escape(x) for x in sorted(FORMS, key=len, reverse=True)))


def tex_pieces(text: str | None, delimiters: bool = False) -> list[tuple[str, str]]:
    """(kind, value) of the pieces in order: "tex" for what a form encloses (with its marks on wish), "term" for the rest;
    trimmed, empty ones left out. A form holds one character at least."""
    text = (text or "").replace("\0", " ")
    pieces, taken, at = [], 0, 0
    last: dict[str, int] = {}  # where each closing mark was found last; nothing is searched twice

    def closing(mark: str, least: int) -> int:
        if last.get(mark, 0) < least and last.get(mark) != -1:
            last[mark] = text.find(mark, least)
        return last.get(mark, -1)

    while opened := _OPENING.search(text, at):
        begin, found = opened.start(), None
        for mark in ("$$", "$") if opened[0] == "$$" else (opened[0],):
            inner = begin + len(mark)
            ends = [(e, end) for end in FORMS[mark] if (e := closing(end, inner + 1)) > 0]
            if ends:
                found = (inner, *min(ends))
                break
        if found is None:
            at = begin + 1
            continue
        inner, e, end = found
        pieces.append(("term", text[taken:begin]))
        taken = at = e + len(end)
        pieces.append(("tex", text[begin:taken] if delimiters else text[inner:e]))
    pieces.append(("term", text[taken:]))
    return [(kind, value.strip()) for kind, value in pieces if value.strip()]


_LEXEME = re.compile(r"\\[a-zA-Z]+|\\.|\d+(?:\.\d+)?|[^\W\d_]|\S")
#: Lexemes without a meaning of their own.
_SPACING = frozenset((r"\left", r"\right", r"\,", r"\;", r"\:", r"\!", r"\ ", r"\quad", r"\qquad", r"\displaystyle", r"\limits", "&", "~", "$", r"\(", r"\)", r"\[", r"\]"))
#: Infix signs by operator and rank; those in ORDERED tell their operands apart.
_INFIX = {
    ",": ("list", 0), ";": ("list", 0), r"\\": ("list", 0),
    "=": ("eq", 1), "<": ("less", 1), ">": ("more", 1), r"\le": ("less", 1), r"\leq": ("less", 1), r"\ge": ("more", 1), r"\geq": ("more", 1), r"\ne": ("unequal", 1), r"\neq": ("unequal", 1),
    r"\equiv": ("equiv", 1), r"\mid": ("divides", 1), "|": ("divides", 1), r"\in": ("in", 1), r"\subset": ("in", 1), r"\subseteq": ("in", 1), r"\to": ("to", 1), ":": ("to", 1),
    "+": ("add", 2), "-": ("add", 2), r"\pm": ("add", 2), r"\cup": ("add", 2),
    "*": ("times", 3), r"\cdot": ("times", 3), r"\times": ("times", 3), r"\cap": ("times", 3), "/": ("frac", 3), r"\div": ("frac", 3), r"\bmod": ("mod", 3), r"\pmod": ("mod", 3),
}
ORDERED = frozenset(("frac", "power", "index", "less", "more", "divides", "in", "to", "mod", "choose"))
#: Commands that take the next one or two atoms.
_PREFIX = {r"\frac": ("frac", 2), r"\dfrac": ("frac", 2), r"\tfrac": ("frac", 2), r"\binom": ("choose", 2), r"\sqrt": ("root", 1), r"\neg": ("negative", 1)}
_PREFIX |= {"\\" + name: (name, 1) for name in "sin cos tan cot sec csc log ln exp gcd max min lim sum prod int overline vec".split()}
_CLOSE = {"(": ")", "[": "]", "{": "}", r"\{": r"\}"}


class _Level:
    """What one bracket holds so far: finished operands, infix operators between them, and prefixes that wait for atoms."""

    __slots__ = ("close", "infix", "values", "waiting")

    def __init__(self, close: str | None):
        self.close, self.values, self.infix, self.waiting = close, [], [], []

    def atom(self, value: tuple) -> None:
        while self.waiting:
            name, need, got = self.waiting[-1]
            got.append(value)
            if len(got) < need:
                return
            self.waiting.pop()
            value = (name, got)
        if len(self.values) > len(self.infix):  # two operands side by side
            self.operator("times", 3)
        self.values.append(value)

    def operator(self, name: str, rank: int) -> None:
        self.fold(rank)
        self.infix.append((name, rank))

    def fold(self, rank: int) -> None:
        while self.infix and self.infix[-1][1] >= rank and len(self.values) > 1:
            name, _ = self.infix.pop()
            right, left = self.values.pop(), self.values.pop()
            if name not in ORDERED and left[0] == name:
                left[1].append(right)
                self.values.append(left)
            else:
                self.values.append((name, [left, right]))

    def whole(self) -> tuple | None:
        while self.waiting:  # a prefix without its atoms keeps those it has
            name, _, got = self.waiting.pop()
            if got:
                self.atom((name, got))
        if len(self.infix) >= len(self.values):
            del self.infix[max(len(self.values) - 1, 0) :]
        self.fold(0)
        return self.values[0] if self.values else None


def formula_tree(tex: str) -> tuple | None:
    """(operator, operands) or, for a leaf, ("VAR" or "NUM", text); null for a formula without a leaf."""
    levels, opened = [_Level(None)], Counter()
    for lexeme in _LEXEME.findall(tex):
        level = levels[-1]
        if lexeme in _SPACING:
            continue
        if lexeme in _CLOSE:
            levels.append(_Level(_CLOSE[lexeme]))
            opened[_CLOSE[lexeme]] += 1
        elif lexeme in opened and opened[lexeme]:
            while True:  # brackets left open inside close with it
                done = levels.pop()
                opened[done.close] -= 1
                if (value := done.whole()) is not None:
                    levels[-1].atom(value)
                if done.close == lexeme:
                    break
        elif lexeme in (")", "]", "}", r"\}"):
            continue
        elif lexeme in "^_":
            name = "power" if lexeme == "^" else "index"
            if level.waiting and not level.waiting[-1][2]:  # a function's own script
                base = ("VAR", level.waiting.pop()[0])
            elif len(level.values) > len(level.infix):
                base = level.values.pop()
            else:
                continue
            level.waiting.append((name, 2, [base]))
        elif lexeme in _INFIX:
            if len(level.values) > len(level.infix) and not level.waiting:
                level.operator(*_INFIX[lexeme])
                if lexeme == "-":
                    level.waiting.append(("negative", 1, []))
            elif lexeme == "-":
                level.waiting.append(("negative", 1, []))
        elif lexeme in _PREFIX:
            level.waiting.append((*_PREFIX[lexeme], []))
        elif lexeme[0].isdigit():
            level.atom(("NUM", lexeme))
        elif lexeme[0] == "\\" or lexeme[0].isalpha():
            level.atom(("VAR", lexeme))
    while len(levels) > 1:
        if (value := levels.pop().whole()) is not None:
            levels[-1].atom(value)
    return levels[0].whole()


def leaf_paths(tree: tuple | None, height: int) -> list[tuple[str, str, list[str]]]:
    """(kind, name, the nearest `height` operators above) of each leaf; ordered operators say which operand it is in."""
    out, todo = [], [(tree, ())] if tree else []
    while todo:
        (name, held), above = todo.pop()
        if name in ("VAR", "NUM"):
            out.append((name, held, list(above)))
            continue
        for i, part in enumerate(held):
            step = f"{name}.{min(i, 1)}" if name in ORDERED else name
            todo.append((part, (step, *above)[:height]))
    return out


_WORD = re.compile(r"[^\W\d_]+")
#: Operators above a leaf that a path holds: a shared stretch of so many levels is a full match.
HEIGHT = 4


def structure_terms(text: str | None, height: int = HEIGHT) -> list[str]:
    """The terms of a text, repeats and all: "s:" paths from leaves of its formulas upwards, one of each length, names left out;
    "n:" names with the operator above; "w:" words outside formulas."""
    out = []
    for kind, value in tex_pieces(text):
        if kind == "term":
            out += ["w:" + w for w in _WORD.findall(value.lower())]
            continue
        for leaf, name, above in leaf_paths(formula_tree(value), height):
            out.append(f"n:{name}|{above[0] if above else ''}")
            out += ["s:" + "|".join((leaf, *above[:k])) for k in range(1 if above else 0, len(above) + 1)]
    return out


def _counted(text: str | None) -> list[tuple[str, int]]:
    return sorted(Counter(t for t in structure_terms(text) if t[0] == "s").items())


def answer_scores(text: str | None) -> list[tuple[int, float]] | None:
    """(place, score) of a listwise answer: of its answer section (or else all of it) the last fenced JSON block, or else the last
    braces, mended where a key has a second bracket or the last brace is missing. None if there is no JSON object; entries
    whose key is no place or whose value is no number are left out."""
    if text is None:
        return None
    begin = text.find("<answer>")
    if begin >= 0 and (end := text.find("</answer>", begin)) >= 0:
        text = text[begin + 8 : end]
    block, at = None, 0
    for opening, closing in (("```json", "```"), ("{", "}")):
        while (a := text.find(opening, at)) >= 0 and (b := text.find(closing, a + len(opening))) >= 0:
            block, at = (text[a + 7 : b] if opening != "{" else text[a : b + 1]), b + len(closing)
        if block is not None:
            break
    if block is None:
        return None
    block = re.sub(r"(?<=\[)(\d+\])\]", r"\1", block)
    block += "}" * (block.count("{") > block.count("}"))
    try:
        found = json.loads(" ".join(block.split()))
    except ValueError:
        return None
    out = []
    for key, value in found.items() if isinstance(found, dict) else ():
        try:
            place, score = int(key.strip().strip("[]")), float(value)
        except (TypeError, ValueError, OverflowError):
            continue
        if 0 < place < 1 << 31:
            out.append((place, score))
    return out if isinstance(found, dict) else None


#: Bytes of text whose pieces a task holds as Python values at once; a longer text is taken alone.
SLICE = 1 << 18


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The array in slices of about SLICE bytes of text and at most a thousand texts."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (held + size > SLICE or i - begin == 1000):
            yield texts.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if len(sizes) > begin:
        yield texts.slice(begin)


def _scanned(scan: Callable, text: Column, kind: str, arrow: pa.DataType) -> Column:
    """scan() of each text, as a column. What slices give is handed on before the next is read, so a batch is never held whole."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _slices(batch):
                yield pa.array([scan(t) for t in texts.to_pylist()], arrow)

    return F.arrow_udf(run, kind)(text)


def _list(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


def tex_pieces_of(text: Column, delimiters: bool = False) -> Column:
    return _scanned(lambda t: tex_pieces(t, delimiters), text, "array<struct<kind: string, value: string>>", _list(kind=pa.string(), value=pa.string()))


def structure_terms_of(text: Column) -> Column:
    return _scanned(structure_terms, text, "array<string>", pa.list_(pa.string()))


def structure_counts_of(text: Column) -> Column:
    """The structure terms ("s:") of a text with their counts, in order."""
    return _scanned(_counted, text, "array<struct<term: string, tf: long>>", _list(term=pa.string(), tf=pa.int64()))


def answer_scores_of(text: Column) -> Column:
    return _scanned(answer_scores, text, "array<struct<place: int, score: double>>", _list(place=pa.int32(), score=pa.float64()))
