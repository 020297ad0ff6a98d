"""Cheapest edits of a sequence of turns, found in linear space.

Reading the edited turns, a conversation is in one of four states: nothing yet, after the system turn, after a user turn, after an
assistant turn. Each row is a 4 x 4 matrix: the least cost, and the ASCII-least edits of that cost, that lead over this row from one state to another
(insertions before the row included). A stretch of rows is such a matrix too. Edits over a row end with the letter that uses the
row, so no edits over a stretch are a prefix of others over it: of two paths the order is settled where they first differ, and a forward
vector only has to keep, beside each state's cost, the place of its edits among those of the other states.
"""

from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60
#: Classes of roles by their first letter, and faults of rows; a row's code is class * 4 + fault.
CLASSES, (FINE, BLANK, DUPLICATE, TRUNCATED) = "sua", range(4)
DELETE, REROLE, INSERT, CUT_SHORT = 2, 1, 5, 5
#: Edits that end a conversation in each state: cost and letters.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def follows(state: int) -> int:
    """The state that the next turn leads to, if it is no system turn."""
    return ASSISTANT if state == USER else USER


def _uses(code: int, state: int):
    """Ways to use a row in `state`: cost, letter, next state."""
    kind, fault = divmod(code, 4)
    yield DELETE, "D", state
    if fault in (FINE, TRUNCATED):
        extra = CUT_SHORT if fault == TRUNCATED else 0
        if kind < 3 and (CLASSES[kind] == "s" and state == START or CLASSES[kind] == "ua"[follows(state) - USER]):
            yield extra, "K", SYSTEM if CLASSES[kind] == "s" else follows(state)
        yield REROLE + extra, "R", follows(state)


def _matrix(code: int):
    """Costs, places among the same start's edits, and edits, each by start * 4 + end."""
    best = [(FAR, "~")] * 16
    for start in STATES:
        state, cost, letters = start, 0, ""
        for _ in range(4):
            for more, letter, end in _uses(code, state):
                best[start * 4 + end] = min(best[start * 4 + end], (cost + more, letters + letter))
            state, cost, letters = follows(state), cost + INSERT, letters + "I"
    places = [sorted(b for _, b in best[s * 4:s * 4 + 4]).index(best[s * 4 + e][1]) for s in STATES for e in STATES]
    return (tuple(c for c, _ in best), tuple(places)), tuple(b for _, b in best)


ROWS, LETTERS = zip(*(_matrix(code) for code in range(16)))


def unit(state: int):
    return tuple(0 if s == state else FAR for s in STATES), tuple(0 if s == state else 4 for s in STATES)


@lru_cache(1 << 16)
def _ahead(matrix, vector):
    """The vector after one matrix, its least cost taken off, and that cost."""
    (costs, places), (now, order) = matrix, vector
    met = [min((now[p] + costs[p * 4 + q], order[p], places[p * 4 + q]) for p in STATES) for q in STATES]
    met = [m if m[0] < FAR else (FAR, 4, 4) for m in met]
    least, ranks = min(met)[0], sorted(m[1:] for m in met)
    return (tuple(c - least if c < FAR else FAR for c, _, _ in met), tuple(ranks.index(m[1:]) for m in met)), least


@lru_cache(1 << 16)
def _behind(matrix, costs):
    met = [min(matrix[0][p * 4 + q] + costs[q] for q in STATES) for p in STATES]
    least = min(met)
    return tuple(min(m - least, FAR) for m in met)


def ahead(chain, lo: int, hi: int, vector):
    """`vector` led over chain[lo:hi], and the cost taken off it."""
    total = 0
    for i in range(lo, hi):
        vector, more = _ahead(chain[i], vector)
        total += more
    return vector, total


def combined(chain):
    """The matrix of the whole chain: costs, and the order of a start's edits."""
    costs, places = [], []
    for start in STATES:
        (now, order), total = ahead(chain, 0, len(chain), unit(start))
        costs += [c + total if c < FAR else FAR for c in now]
        places += order
    return tuple(costs), tuple(places)


def best_end(chain):
    """The end state of the cheapest, then ASCII-least edits of a whole conversation, and their cost with the closing ones."""
    (now, order), total = ahead(chain, 0, len(chain), unit(START))
    cost, _, end = min((now[s] + CLOSING[s][0], order[s], s) for s in STATES)
    return end, cost + total


def crossings(chain, start: int, end: int) -> list[int]:
    """The states after each element of the cheapest, then ASCII-least way from `start` to `end`. Forward vectors of the first half and
    backward vectors of the second meet in the middle; the crossing splits the work, and nothing else is kept."""
    out: list[int] = []

    def halve(lo: int, hi: int, p: int, q: int) -> None:
        if hi - lo == 1:
            out.append(q)
            return
        mid = (lo + hi) // 2
        (now, order), _ = ahead(chain, lo, mid, unit(p))
        rest = unit(q)[0]
        for i in range(hi - 1, mid - 1, -1):
            rest = _behind(chain[i], rest)
        _, _, cross = min((now[s] + rest[s], order[s], s) for s in STATES)
        halve(lo, mid, p, cross)
        halve(mid, hi, cross, q)

    if len(chain):
        halve(0, len(chain), start, end)
    return out
