"""A generalised LR automaton with edits over a small grammar, and its cheapest parse of a stream of symbols.

Stacks are cells (LR state, cell beneath), each made once, so that equal stacks are one cell and stacks share
their lower parts: the graph-structured stack. Of several ways to one stack the least (cost, audit) stays.

An audit has one letter an edit: D deletes a symbol, I inserts one before it, K keeps it, R puts another in its
place. Audits of one number of symbols read, each ending with the edit of the last, are never proper prefixes
of each other, so their order stays as it is whatever follows, and a rank can stand for each.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

#: Conversations: one system turn or none, then one or more pairs of user and assistant; or nothing at all.
ROLES = {"C": ("", "HT"), "H": ("", "s"), "T": ("P", "TP"), "P": ("ua",)}
TOP = ""


class Costs(NamedTuple):
    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    #: Added to a row that stays although it is cut short.
    truncated: int = 3


class Row(NamedTuple):
    """What the parser knows of a row: the initial of its role, and its fault."""

    symbol: str
    must_go: bool = False
    truncated: bool = False


class Step(NamedTuple):
    """How one stack of the new front came about: from which of the old, what was inserted, the edit, the symbol put."""

    parent: int
    inserted: str
    edit: str
    symbol: str


class Automaton:
    """LR(0) states of a grammar whose capitals are nonterminals; conflicts are followed both ways."""

    def __init__(self, grammar: dict[str, tuple[str, ...]] = ROLES, start: str = "C"):
        self.rules = [(TOP, start), *((left, right) for left, all_ in grammar.items() for right in all_)]
        self.grammar = grammar
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.gotos: dict[tuple[int, str], int] = {}
        self._state({(0, 0)})
        done = 0
        while done < len(self.states):
            moves: dict[str, set] = {}
            for rule, dot in self.states[done]:
                right = self.rules[rule][1]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((rule, dot + 1))
            for symbol in sorted(moves):
                self.gotos[done, symbol] = self._state(moves[symbol])
            done += 1
        self.cells: dict[tuple, tuple] = {}
        self.bottom = self._cell(0, None)

    def _state(self, kernel: set) -> int:
        items, todo = set(kernel), list(kernel)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            for k, (left, _) in enumerate(self.rules):
                if dot < len(right) and left == right[dot] and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        key = frozenset(items)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key]

    def _cell(self, state: int, below: tuple | None) -> tuple:
        return self.cells.setdefault((state, id(below)), (state, below))

    def _complete(self, cell: tuple) -> list[int]:
        return sorted(rule for rule, dot in self.states[cell[0]] if dot == len(self.rules[rule][1]))

    def _reduced(self, cell: tuple, rule: int) -> tuple | None:
        left, right = self.rules[rule]
        for _ in right:
            cell = cell[1]
        return None if left == TOP else self._cell(self.gotos[cell[0], left], cell)

    @cache  # noqa: B019  an automaton lives as long as its task
    def reductions(self, cell: tuple) -> tuple[tuple, ...]:
        """The cell and all that reductions make of it."""
        out = [cell]
        for c in out:
            for rule in self._complete(c):
                new = self._reduced(c, rule)
                if new is not None and new not in out:
                    out.append(new)
        return tuple(out)

    @cache  # noqa: B019
    def shifts(self, cell: tuple, symbol: str) -> tuple[tuple, ...]:
        """The stacks after one more symbol. A state that can only reduce does so at once, so that equal tops meet."""
        out = []
        for c in self.reductions(cell):
            if symbol.islower() and (c[0], symbol) in self.gotos:
                new = self._cell(self.gotos[c[0], symbol], c)
                while len(self.states[new[0]]) == 1 and self._complete(new):
                    new = self._reduced(new, self._complete(new)[0])
                out.append(new)
        return tuple(dict.fromkeys(out))

    @cache  # noqa: B019
    def accepts(self, cell: tuple) -> bool:
        return any((0, 1) in self.states[c[0]] for c in self.reductions(cell))


class Repair:
    """The cheapest edits of a stream of rows, one step at a time.

    A front is a tuple of (stack, cost above the least) in the order of the audits. There are few different
    fronts, so the step from each by each kind of row is worked out once. `slack` bounds them: from any stack a
    cheaper one can be followed in its place at that much more, so what costs more than that is never least.
    """

    def __init__(self, automaton: Automaton | None = None, costs: Costs = Costs(), reroled: str = "ua", slack: int | None = None):
        self.automaton, self.costs, self.reroled = automaton or Automaton(), costs, reroled
        self.slack = 2 * costs.insert + costs.delete if slack is None else slack
        self.start = ((self.automaton.bottom, 0),)
        self._steps: dict = {}
        self._ends: dict = {}

    @cache  # noqa: B019
    def _inserted(self, cell) -> tuple[tuple, ...]:
        """(stack, symbols) for each stack that insertions make of the cell, by the fewest."""
        best = {cell: ""}
        for c in (todo := [cell]):
            for symbol in self.reroled:
                for new in self.automaton.shifts(c, symbol):
                    if new not in best:  # breadth first
                        best[new] = best[c] + symbol
                        todo.append(new)
        return tuple(best.items())

    def step(self, front: tuple, row: Row) -> tuple[tuple, int, list[Step]]:
        """(new front, rise of the least cost, how each of its stacks came about)."""
        got = self._steps.get((front, row))
        if got is None:
            got = self._steps[front, row] = self._step(front, row)
        return got

    def _step(self, front, row):
        c, found = self.costs, {}
        stay = c.truncated * row.truncated

        def offer(new, cost, rank, put, edit, symbol=""):
            order = (cost, rank, "I" * len(put) + edit)
            if new not in found or order < found[new][0]:
                found[new] = (order, Step(rank, put, edit, symbol))

        for rank, (origin, over) in enumerate(front):
            for cell, put in self._inserted(origin):
                cost = over + c.insert * len(put)
                offer(cell, cost + c.delete, rank, put, "D")
                if row.must_go:
                    continue
                for new in self.automaton.shifts(cell, row.symbol):
                    offer(new, cost + c.keep + stay, rank, put, "K", row.symbol)
                for symbol in self.reroled:
                    for new in self.automaton.shifts(cell, symbol):
                        offer(new, cost + c.rerole + stay, rank, put, "R", symbol)
        least = min(order[0] for order, _ in found.values())
        alive = sorted(((order[1:], order[0], cell, step) for cell, (order, step) in found.items() if order[0] <= least + self.slack), key=lambda x: x[0])
        return tuple((cell, cost - least) for _, cost, cell, _ in alive), least, [step for *_, step in alive]

    def end(self, front: tuple) -> tuple[int, int, str]:
        """(cost over the least, which stack, what is inserted after the last row) of the cheapest way to an accepted end."""
        got = self._ends.get(front)
        if got is None:
            got = self._ends[front] = min(
                (over + self.costs.insert * len(put), rank, put) for rank, (origin, over) in enumerate(front) for cell, put in self._inserted(origin) if self.automaton.accepts(cell)
            )
        return got
