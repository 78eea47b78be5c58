"""What a text must hold for a pattern to match it at all, so that most patterns need not be run over most texts.

A regular expression tries every place of a text; looking for a fixed word is far cheaper. Words are taken from the
pattern itself, so a text without any of them has no match: nothing is lost by leaving the pattern out there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser as parser
except ImportError:  # without it every pattern is run over every text
    parser = None



def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


#: Alternatives that are still worth looking for beside others.
FEW = 6


@cache
def needs(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of words: of each set, one is in the lower-cased text wherever the pattern matches without regard to ASCII
    case. No sets where no such words are known."""
    if parser is None:
        return ()
    try:
        tree = parser.parse(pattern.replace(r"\z", r"\Z"))
    except (re.error, OverflowError):  # Java's syntax has more than Python's
        return ()
    asked = [words for words in dict.fromkeys(_asked(tree)) if min(map(_size, words)) > 1]
    return tuple(words for words in asked if len(words) <= FEW) or tuple(asked[:1])


def _size(word: str) -> int:
    return len(word.encode())


def _asked(tree) -> list[tuple[str, ...]]:
    """What a sequence asks for, the most telling first: of which the shortest word is longest, then the fewest words."""
    asked, run = [], ""
    for op, value in tree:
        name = str(op)
        if name == "LITERAL" and (value < 128 or chr(value).lower() == chr(value).upper()):
            run += chr(value).lower()
            continue
        asked, run = [*asked, (run,)], ""
        if name == "SUBPATTERN":
            asked += _asked(value[3])
        elif name == "BRANCH":
            each = [_asked(branch)[:1] for branch in value[1]]
            asked.append(tuple(sorted({w for best in each for words in best for w in words})) if all(each) else ())
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            asked += _asked(value[2])
    asked = [words for words in [*asked, (run,)] if words and all(words)]
    return sorted(asked, key=lambda words: (-min(map(_size, words)), len(words)))


def holds(low: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in a text."""
    return reduce(or_, [F.contains(low, F.lit(w)) for w in words])


def may_match(text: Column, *patterns: str) -> Column:
    """Whether one of the patterns may match; true if nothing is known of one."""
    sets = [needs(p) for p in patterns]
    if not all(sets):
        return F.lit(True)
    low = F.lower(text)  # which plans compute once for all patterns of a row
    return reduce(or_, [reduce(and_, [holds(low, words) for words in of]) for of in sets])


def where_possible(text: Column, pattern: str, use: Column) -> Column:
    """`use` where the pattern may match the text, null elsewhere."""
    return F.when(may_match(text, pattern), use) if needs(pattern) else use
