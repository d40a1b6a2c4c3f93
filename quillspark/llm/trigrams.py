"""Boolean trigram queries that every match of a regular expression satisfies, derived from its syntax tree.

A query is a list of clauses, all of which must hold; a clause is a set of alternatives, one of which must hold; an alternative
is a set of trigrams, all of which must occur. Trigrams are in lower case and are looked up in the lower-cased text, so that
either case of a letter is found. A pattern without mandatory trigrams gives an empty query: such a rule scans every text.
"""

from __future__ import annotations

from re import _constants as k
from re import _parser

Clause = frozenset[frozenset[str]]

#: An expression is followed as an exact set of strings while the set is no larger than this.
MOST_STRINGS = 64


def _letters(item: list) -> set[str] | None:
    found: set[str] = set()
    for op, arg in item:
        if op is k.LITERAL:
            found.add(chr(arg).lower())
        elif op is k.RANGE and arg[1] - arg[0] < 16:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found


class _Info:
    """exact: all strings that it can match, or None; clauses: what is mandatory inside."""

    def __init__(self, exact: set[str] | None, clauses: list[Clause] | None = None):
        self.exact, self.clauses = exact, clauses or []


def _clause(strings: set[str]) -> list[Clause]:
    """A clause for a set of strings of which one occurs; none if one of them is too short to say anything."""
    shortest = {s for s in strings if not any(t != s and t in s for t in strings)}
    if not shortest or any(len(s) < 3 for s in shortest):
        return []
    return [frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in shortest)]


def _concat(parts: list[_Info]) -> _Info:
    run: set[str] | None = {""}
    exact, clauses = True, []
    for p in parts:
        clauses += p.clauses
        if p.exact is not None and run is not None and len(run) * len(p.exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in p.exact}
            continue
        exact = False
        clauses += _clause(run or set())
        run = set(p.exact) if p.exact is not None else {""}
    if exact:
        return _Info(run, clauses)
    return _Info(None, clauses + _clause(run or set()))


def _walk(tree) -> _Info:
    parts: list[_Info] = []
    for op, arg in tree:
        if op is k.LITERAL:
            parts.append(_Info({chr(arg).lower()}))
        elif op is k.IN:
            parts.append(_Info(_letters(arg)))
        elif op is k.SUBPATTERN:
            parts.append(_walk(arg[3]))
        elif op is k.BRANCH:
            parts.append(_either([_walk(x) for x in arg[1]]))
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
            least, most, body = arg
            inner = _walk(body)
            if (least, most) == (0, 1) and inner.exact is not None:
                parts.append(_Info(inner.exact | {""}))
            elif least == most and least <= 4:
                parts += [inner] * least
            else:
                parts += [inner] * min(least, 3)
                parts.append(_Info(None))
        elif op is k.AT:
            parts.append(_Info({""}))
        else:
            parts.append(_Info(None))
    return _concat(parts)


def _either(branches: list[_Info]) -> _Info:
    if all(b.exact is not None for b in branches):
        strings = set().union(*(b.exact for b in branches))
        if len(strings) <= MOST_STRINGS:
            return _Info(strings)
    best = []
    for b in branches:
        own = b.clauses + (_clause(b.exact) if b.exact is not None else [])
        if not own:
            return _Info(None)
        best.append(min(own, key=len))
    return _Info(None, [frozenset().union(*best)])


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses of a pattern, without those that another clause implies."""
    info = _walk(_parser.parse(pattern))
    clauses = set(info.clauses) | set(_clause(info.exact) if info.exact is not None else [])
    return sorted((c for c in clauses if not any(d != c and _implies(d, c) for d in clauses)), key=lambda c: sorted(map(sorted, c)))


def _implies(one: Clause, other: Clause) -> bool:
    return all(any(b <= a for b in other) for a in one)
