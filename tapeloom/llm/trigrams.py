"""Boolean trigram queries from regular expressions.

A query is a disjunction of branches; a branch is a set of lower-case trigrams that
every match of that branch contains.  A branch without trigrams means that nothing
is mandatory: the expression must be run on every text.
"""

from __future__ import annotations

from re import _parser as sre  # the standard library's own reading of an expression

Branches = frozenset[frozenset[str]]

ANYTHING: Branches = frozenset([frozenset()])
#: Strings (or branches) that one expression may fan out to before it counts as "anything".
FAN_OUT = 64
#: Characters of a class that are spelled out.
CLASS_SIZE = 8


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _simplest(branches: Branches) -> Branches:
    """Without branches that another branch implies."""
    if len(branches) > FAN_OUT:
        return ANYTHING
    return frozenset(b for b in branches if not any(other < b for other in branches))


def _both(left: Branches, right: Branches) -> Branches:
    return _simplest(frozenset(a | b for a in left for b in right))


def _class(items: list) -> set[str] | None:
    chars: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            chars.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < CLASS_SIZE:
            chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return chars if len(chars) <= CLASS_SIZE else None


def _element(op, value) -> tuple[set[str] | None, Branches]:
    """The strings an element can be, or None and the trigrams it must contain."""
    if op is sre.LITERAL:
        return {chr(value).lower()}, ANYTHING
    if op is sre.IN:
        return _class(value), ANYTHING
    if op is sre.AT:
        return {""}, ANYTHING
    if op is sre.SUBPATTERN:
        return _sequence(value[-1])
    if op is sre.BRANCH:
        parts = [_sequence(part) for part in value[1]]
        if all(exact is not None for exact, _ in parts):
            return set().union(*[exact for exact, _ in parts]), ANYTHING
        found = [needs if exact is None else _of_strings(exact) for exact, needs in parts]
        return None, _simplest(frozenset().union(*found))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, item = value
        exact, needs = _sequence(item)
        if exact is not None and high == 1:
            return (exact | {""} if low == 0 else exact), ANYTHING
        if exact is not None and low == high and len(exact) == 1:
            return {next(iter(exact)) * low}, ANYTHING
        return None, (ANYTHING if low == 0 else needs if exact is None else _of_strings(exact))
    return None, ANYTHING


def _of_strings(strings: set[str]) -> Branches:
    return _simplest(frozenset(_grams(s) for s in strings))


def _sequence(items) -> tuple[set[str] | None, Branches]:
    run: set[str] = {""}
    needs, whole = ANYTHING, True
    for op, value in items:
        exact, inner = _element(op, value)
        if exact is not None and len(run) * len(exact) <= FAN_OUT:
            run = {a + b for a in run for b in exact}
            continue
        needs, whole = _both(needs, _of_strings(run)), False
        run = {""} if exact is None else exact
        needs = _both(needs, inner)
    if whole:
        return run, ANYTHING
    return None, _both(needs, _of_strings(run))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Branches of mandatory trigrams, in a fixed order; empty if the expression must scan everything."""
    exact, needs = _sequence(sre.parse(pattern))
    branches = _of_strings(exact) if exact is not None else needs
    if frozenset() in branches:
        return []
    return sorted(branches, key=sorted)
