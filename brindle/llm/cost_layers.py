"""The cheapest repair of a run of turns, by layers of equal cost.

States of the grammar ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end. In every state but
0 one symbol can follow, and in 0 only u can be inserted or come from a new role, so an audit settles the repair.

A turn is one sign. s, u, a, x: its role's initial (x: another). Upper case: truncated, so staying costs 1 more. 0 to 3
(for s, u, a, x): blank or duplicate, so it must go. Keep costs 0, a new role 2, removal 3, an inserted turn 2.

For each cost from 0 on, a layer holds for every place between turns the bitset of states from which the rest can be
repaired at that cost exactly. It follows from the three layers before, so the first layer with the start state
gives the least cost, and a walk forward through the layers the audit that is least in ASCII.
"""

from __future__ import annotations

from functools import lru_cache

ROLES = "suax"
_STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
_FORCED = {0: 2, 1: 2, 2: 3, 3: 2}
#: A state that no path gives within what can matter.
NEVER = 1 << 40


def _backward(step: dict[int, int]) -> list[int]:
    """For each bitset of states after a step, the bitset of states before it."""
    return [sum(1 << a for a, b in step.items() if after >> b & 1) for after in range(16)]


_BEFORE = {role: _backward(step) for role, step in _STEP.items()}
_BEFORE_FORCED = _backward(_FORCED)


def _turns(codes: str) -> list[tuple[dict, list[int], int, bool]]:
    """Of each turn: the step of keeping it, backwards too, what staying costs more, whether it may stay."""
    out = []
    for c in codes:
        must_go = c.isdigit()
        role = ROLES[int(c)] if must_go else c.lower()
        out.append((_STEP[role], _BEFORE[role], int(c.isupper()), not must_go))
    return out


def _layers(turns: list, ends: tuple[int, ...], last: bool, wanted: int) -> tuple[int, list[list[int]]]:
    """The least of ends, and the layers from that cost on until all states of wanted are in one for place 0. ends: what
    is still to be paid in each state after the last turn. last: turns can be inserted there too."""
    base, n = min(ends), len(turns)
    layers: list[list[int]] = []
    empty = [0] * (n + 1)
    missing, cost = wanted, 0
    while missing:
        one, two, three = (layers[-k] if len(layers) >= k else empty for k in (1, 2, 3))
        now = [0] * (n + 1)
        now[n] = sum(1 << s for s in range(4) if ends[s] - base == cost) | (_BEFORE_FORCED[two[n]] if last else 0)
        for i in range(n - 1, -1, -1):
            _, before, more, stays = turns[i]
            found = three[i + 1] | _BEFORE_FORCED[two[i]]
            if stays:
                found |= before[one[i + 1] if more else now[i + 1]] | _BEFORE_FORCED[three[i + 1] if more else two[i + 1]]
            now[i] = found
        layers.append(now)
        missing &= ~now[0]
        cost += 1
    return base, layers


def _walk(turns: list, ends: tuple[int, ...], last: bool, base: int, layers: list[list[int]], state: int) -> tuple[int, list[str], list[str], int]:
    """The cost from state on, the audit's letters up to and with each turn's (and those after the last turn), the roles
    that are written for them, and the state reached. Roles: u, a for an inserted or changed one, = for a kept one."""
    left = next(c for c, layer in enumerate(layers) if layer[0] >> state & 1)
    total, i, n = base + left, 0, len(turns)
    audit, roles = [""], [""]

    def can(cost: int, place: int, to: int) -> bool:
        return cost >= 0 and bool(layers[cost][place] >> to & 1)

    while i < n or (ends[state] - base != left):
        step, _, more, stays = turns[i] if i < n else ({}, None, 0, False)
        to = _FORCED[state]
        if i < n and can(left - 3, i + 1, state):
            letter, left, i = "D", left - 3, i + 1
        elif (i < n or last) and can(left - 2, i, to):
            audit[-1] += "I"
            roles[-1] += "ua"[to - 2]
            left, state = left - 2, to
            continue
        elif stays and state in step and can(left - more, i + 1, step[state]):
            letter, left, i, state = "K", left - more, i + 1, step[state]
            roles[-1] += "="
        else:
            letter, left, i, state = "R", left - 2 - more, i + 1, to
            roles[-1] += "ua"[to - 2]
        audit[-1] += letter
        audit.append("")
        roles.append("")
    return total, audit, roles, state


_ACCEPTED = (0, NEVER, NEVER, 0)


@lru_cache(1 << 14)
def repair(codes: str) -> tuple[int, list[str], list[str]]:
    """The least cost of a whole conversation, and the letters and roles of each turn; those after the last turn are
    one more entry."""
    turns = _turns(codes)
    base, layers = _layers(turns, _ACCEPTED, True, 1)
    return _walk(turns, _ACCEPTED, True, base, layers, 0)[:3]


def to_go(codes: str, ends: tuple[int, ...], last: bool) -> tuple[int, ...]:
    """What is to be paid in each state before these turns, given what is after them."""
    base, layers = _layers(_turns(codes), ends, last, 15)
    return tuple(base + next(c for c, layer in enumerate(layers) if layer[0] >> s & 1) for s in range(4))


def repair_part(codes: str, ends: tuple[int, ...], last: bool, state: int) -> tuple[list[str], list[str], int]:
    """Letters and roles of a part of a conversation that is entered in a state, and the state after it."""
    turns = _turns(codes)
    base, layers = _layers(turns, ends, last, 1 << state)
    return _walk(turns, ends, last, base, layers, state)[1:]


def matrix(codes: str) -> list[int]:
    """What the turns cost from each state to each other, row by row: the layers of all four starts at once, in
    bitsets of 16. Turns are inserted before turns only. Ends that cost over SLACK more than the end at 3 can't
    matter, whatever follows, and are NEVER."""
    turns, costs = _turns(codes), [NEVER] * 16
    n = len(turns)
    empty = [0] * (n + 1)
    held = [empty] * 3
    cost, stop = 0, None
    while stop is None or cost <= stop:
        three, two, one = held
        now = [0] * (n + 1)
        now[0] = 0x8421 if cost == 0 else 0
        for i in range(n):
            step, _, more, stays = turns[i]
            now[i] |= _forced(two[i])
            found = three[i]
            if stays:
                found |= _kept(step, one[i] if more else now[i]) | _forced(three[i] if more else two[i])
            now[i + 1] = found
        held = [two, one, now]
        for k in range(16):
            if costs[k] == NEVER and now[n] >> k & 1:
                costs[k] = cost
        if stop is None and all(costs[4 * s + 3] < NEVER for s in range(4)):
            stop = cost + SLACK
        cost += 1
    return costs


#: From 3, what follows costs 3 more than from any other state at most: remove the s that only 0 may keep, or insert a turn.
SLACK = 4


def _forced(m: int) -> int:
    zero, one, two, three = (m >> s & 0x1111 for s in range(4))
    return (zero | one | three) << 2 | two << 3


def _kept(step: dict[int, int], m: int) -> int:
    found = 0
    for a, b in step.items():
        found |= (m >> a & 0x1111) << b
    return found
