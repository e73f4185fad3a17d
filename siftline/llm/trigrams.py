"""Boolean trigram queries derived from regular expressions.

The analysis walks the parsed expression and keeps, for the part read so far,
the set of strings that part can be; when that set can't be kept exactly any
longer, it turns into the condition that one of the strings occurs, that is,
that all trigrams of one of them do. Strings under three characters put no
condition. The result is a disjunction of trigram sets (any one of them must
be wholly present), or None where no trigram is mandatory.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: Sets of strings, or of clauses, are given up beyond this size; the query only gets weaker.
MOST = 64

Clauses = frozenset[frozenset[str]]
ANYTHING: Clauses = frozenset([frozenset()])


def simple(clauses: Clauses) -> Clauses:
    """Without the clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def both(a: Clauses, b: Clauses) -> Clauses:
    out = simple(frozenset(x | y for x in a for y in b))
    return out if len(out) <= MOST else a


def required(strings: set[str]) -> Clauses:
    return simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def walk(items) -> tuple[set[str] | None, Clauses]:
    """The strings the items can be (None: too many to list) and what any text they match must hold."""
    now, exact, known = {""}, True, ANYTHING

    def give_up():
        nonlocal now, exact, known
        now, exact, known = {""}, False, both(known, required(now))

    def extend(more: set[str] | None, clauses: Clauses) -> None:
        nonlocal now, known
        if more is not None and len(now) * len(more) > MOST:
            give_up()
        if more is None or len(more) > MOST:
            give_up()
            known = both(known, clauses)
        else:
            now = {a + b for a in now for b in more}

    for kind, arg in items:
        if kind is op.LITERAL:
            extend({chr(arg).lower()}, ANYTHING)
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            extend({chr(c).lower() for _, c in arg}, ANYTHING)
        elif kind is op.SUBPATTERN:
            extend(*walk(arg[-1]))
        elif kind is op.BRANCH:
            ways = [walk(way) for way in arg[1]]
            strings = None if any(s is None for s, _ in ways) else set().union(*[s for s, _ in ways])
            extend(strings, simple(frozenset().union(*[c if s is None else both(c, required(s)) for s, c in ways])))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = arg
            strings, clauses = walk(inner)
            if (least, most) == (0, 1) and strings is not None:
                extend(strings | {""}, ANYTHING)
            elif least == 0:
                give_up()
            else:
                for _ in range(min(least, 3)):
                    extend(strings, clauses)
                if most != least or least > 3:
                    give_up()
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        else:
            give_up()
    return (now if exact else None), (known if exact else both(known, required(now)))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which any matching text holds whole; None: every text must be scanned."""
    strings, clauses = walk(parser.parse(regex))
    if strings is not None:
        clauses = both(clauses, required(strings))
    return None if frozenset() in clauses else sorted(clauses, key=sorted)
