"""Rule sets over one household as Python values: the helper of chats and of verdicts on a stream, with the columns' semantics.

A household is a list of dicts of facts, the applicant first; an absent key is an unknown fact, None a null value. Trits
are 0 for false, 1 for unknown, 2 for true.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from verdictlake.operators.evaluate import ELIGIBLE, INELIGIBLE, UNDETERMINED
from verdictlake.plans.rulesets import Exclusion, Leaf, RuleSet

People = list[dict[str, Any]]


def holds(op: str, actual: Any, expected: Any) -> int:
    """compare() of two Python values as a trit; unknown where they can't be compared."""
    number = lambda v: isinstance(v, bool | int | float)
    alike = (number(actual) and number(expected)) or (isinstance(actual, str) and isinstance(expected, str))
    if op in ("==", "!="):
        same = actual is None if expected is None else (alike or isinstance(actual, list) and isinstance(expected, list | tuple)) and actual == expected
        return 2 * (same == (op == "=="))
    if op in ("in", "not_in"):
        if isinstance(expected, list | tuple):
            found = any(type(v) is type(actual) and v == actual or number(v) and number(actual) and v == actual for v in expected)
        elif isinstance(expected, str) and isinstance(actual, str):
            found = actual in expected
        else:
            return 1
        return 2 * (found == (op == "in"))
    if not alike:
        return 1
    return 2 * {"<": actual < expected, "<=": actual <= expected, ">": actual > expected, ">=": actual >= expected}[op]


class Said(dict):
    """A fact of which is known only what leaves say of it: trits by said_of()."""


def said_of(x: Leaf | Exclusion) -> tuple[str, str]:
    return x.op, repr(x.value)


def leaf(x: Leaf | Exclusion, facts: dict[str, Any]) -> int:
    if x.field not in facts:
        return 1
    fact = facts[x.field]
    return fact[said_of(x)] if isinstance(fact, Said) else holds(x.op, fact, x.value)


def tree(node: Any, facts: dict[str, Any]) -> int:
    if isinstance(node, Leaf):
        return leaf(node, facts)
    return reduce(min if node.kind == "and" else max, (tree(c, facts) for c in node.children), 2 if node.kind == "and" else 0)


def member(x: Exclusion, facts: dict[str, Any]) -> int:
    """Whether the condition holds for a member and no member-scoped exception does."""
    return min(leaf(x, facts), 2 - leaf(x.exception, facts)) if x.exception and x.except_scope == "member" else leaf(x, facts)


def excluded(x: Exclusion, people: People) -> int:
    hits = [member(x, m) for m in (people[:1] if x.quantifier == "self" else people)]
    if x.quantifier == "count_family_members":
        compare = {"<": int.__lt__, "<=": int.__le__, "==": int.__eq__, ">=": int.__ge__, ">": int.__gt__}[x.count_op]
        ends = {compare(n, x.count) for n in range(hits.count(2), hits.count(2) + hits.count(1) + 1)}
        held = 1 if len(ends) > 1 else 2 * ends.pop()
    else:
        held = min(hits) if x.quantifier == "all_family_members" else max(hits)
    return min(held, 2 - leaf(x.exception, people[0])) if x.exception and x.except_scope == "applicant" else held


def verdict(rules: RuleSet, people: People) -> str:
    found = min(tree(rules.inclusion, people[0]), 2 - max((excluded(x, people) for x in rules.exclusions), default=0))
    return (INELIGIBLE, UNDETERMINED, ELIGIBLE)[found]


def missing(rules: RuleSet, people: People) -> list[tuple[int, str]]:
    """Places of members with facts that they lack under no decided node, in the order of missing_facts()."""
    if verdict(rules, people) != UNDETERMINED:
        return []
    out: list[tuple[int, str]] = []
    me = people[0]

    def walk(node: Any) -> None:
        if tree(node, me) != 1:
            return
        if isinstance(node, Leaf):
            if node.field not in me:
                out.append((0, node.field))
            return
        for child in node.children:
            walk(child)

    walk(rules.inclusion)
    for x in rules.exclusions:
        if excluded(x, people) != 1:
            continue
        for part in (x, x.exception if x.except_scope == "member" else None):
            who = people[:1] if x.quantifier == "self" else people
            out += [(i, part.field) for i, m in enumerate(who) if part and member(x, m) == 1 and part.field not in m]
        if x.exception and x.except_scope == "applicant" and x.exception.field not in me:
            out.append((0, x.exception.field))
    return list(dict.fromkeys(out))
