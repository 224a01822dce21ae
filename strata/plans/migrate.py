"""Migrations between versions: a graph of edges, shortest chains, and their composition into one projection."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from strata.errors import NoMigrationPath, StrataError
from strata.schema import Family

Move = Callable[[DataFrame], DataFrame]
Ref = tuple[int, int]


@dataclass
class MigrationGraph:
    """Edges between (struct id, version) pairs, forwards and backwards, with the projections that go along them."""

    forward: dict[Ref, dict[Ref, Move | None]] = field(default_factory=dict)
    backward: dict[Ref, dict[Ref, Move | None]] = field(default_factory=dict)
    composed: dict[Ref, tuple[tuple[Ref, ...], Callable[[dict[Ref, DataFrame]], DataFrame] | None]] = field(default_factory=dict)

    def add(self, a: Ref, b: Ref, move: Move | None = None, rollback: Move | None = None, can_roll_back: bool | None = None) -> None:
        self.forward.setdefault(a, {})[b] = move
        if rollback is not None or can_roll_back:
            self.add_rollback(b, a, rollback)

    def add_rollback(self, a: Ref, b: Ref, move: Move | None = None) -> None:
        self.backward.setdefault(a, {})[b] = move

    def compose(self, sources: tuple[Ref, ...], target: Ref, move: Callable[[dict[Ref, DataFrame]], DataFrame] | None = None) -> None:
        """Several families make one: an edge from each, and a move that takes all of them, mostly a join."""
        self.composed[target] = (sources, move)
        for s in sources:
            self.add(s, target)

    def combine(self, frames: dict[Ref, DataFrame], target: Ref) -> DataFrame:
        """The target of a composition from the rows of its sources; rows of an earlier version of a source are moved up to it first."""
        sources, move = self.composed.get(target, ((), None))
        if move is None:
            raise NoMigrationPath(f"nothing composes {target}")
        ready = {}
        for s in sources:
            start = next((r for r in frames if r == s), None) or next((r for r in frames if self._walk(self.forward, r, s) is not None), None)
            if start is None:
                raise NoMigrationPath(f"{target} needs {s}")
            ready[s] = self.migrate(frames[start], start, s)
        return move(ready)

    @staticmethod
    def _walk(edges: dict[Ref, dict[Ref, Move | None]], a: Ref, b: Ref) -> list[tuple[Ref, Ref]] | None:
        came: dict[Ref, Ref] = {a: a}
        queue = deque([a])
        while queue:
            at = queue.popleft()
            if at == b:
                path = []
                while at != a:
                    path.append((came[at], at))
                    at = came[at]
                return path[::-1]
            for nxt in edges.get(at, {}):
                if nxt not in came:
                    came[nxt] = at
                    queue.append(nxt)
        return None

    def resolve(self, a: Ref, b: Ref) -> list[tuple[Ref, Ref]]:
        """The fewest forward edges from a to b; none if they are the same."""
        path = self._walk(self.forward, a, b)
        if path is None:
            raise NoMigrationPath(f"from {a} to {b}")
        return path

    def can_roll_back(self, a: Ref, b: Ref) -> bool:
        return self._walk(self.backward, a, b) is not None

    def count(self) -> int:
        return sum(len(v) for v in self.forward.values())

    def migrate(self, df: DataFrame, a: Ref, b: Ref) -> DataFrame:
        for x, y in self.resolve(a, b):
            move = self.forward[x][y]
            if move is None:
                raise NoMigrationPath(f"the edge from {x} to {y} has no function")
            df = df.transform(move)
        return df

    def roll_back(self, df: DataFrame, a: Ref, b: Ref) -> DataFrame:
        """From a back to b, along the forward path in reverse."""
        for x, y in reversed(self.resolve(b, a)):
            move = self.backward.get(y, {}).get(x)
            if move is None:
                raise NoMigrationPath(f"the edge from {y} back to {x} has no function")
            df = df.transform(move)
        return df


def graph_of(family: Family) -> MigrationGraph:
    """The chain of a family's versions, each with its move from the one before and its way back."""
    graph = MigrationGraph()
    numbers = sorted(family.by_number)
    for a, b in zip(numbers, numbers[1:], strict=False):
        v = family.by_number[b]
        if v.forward:
            graph.add((family.struct_id, a), (family.struct_id, b), v.forward)
        if v.rollback:
            graph.add_rollback((family.struct_id, b), (family.struct_id, a), v.rollback)
    return graph


def check_links(family: Family) -> None:
    """The first version of a family has no version to come from."""
    first = family.by_number[min(family.by_number)]
    if first.forward or first.rollback or first.forward_with or first.rollback_with:
        raise StrataError(f"{family.name}: version {first.number} has no version before it to migrate from")


def read_as(df: DataFrame, family: Family, stored: int, wanted: int, session: object = None) -> DataFrame:
    """Rows of one stored version in the layout of another: the same, up by forward moves, or down by rollbacks. Moves that look things up get the session."""
    step = 1 if wanted > stored else -1
    numbers = sorted(family.by_number)
    at = numbers.index(stored)
    while numbers[at] != wanted:
        v = family.by_number[numbers[at + 1] if step > 0 else numbers[at]]
        move, with_session = (v.forward, v.forward_with) if step > 0 else (v.rollback, v.rollback_with)
        if move is not None:
            df = df.transform(move)
        elif with_session is not None and session is not None:
            df = with_session(session, df)
        else:
            raise NoMigrationPath(f"{family.name}: from version {stored} to {wanted}")
        at += step
    return df


def first_try_or(found: DataFrame, family: Family, wanted: int) -> DataFrame:
    """The hooks around a search: what first_try gives goes before what is found, fallback stands in for nothing."""
    v = family.version(wanted)
    tried = v.first_try() if v.first_try else None
    if tried is not None and not tried.isEmpty():
        return tried
    if v.fallback and found.isEmpty():
        return v.fallback()
    return found


def split(df: DataFrame, targets: dict[str, Move]) -> dict[str, DataFrame]:
    """One family's rows as several families' rows, from one scan if the source is cached or written before."""
    return {name: df.transform(move) for name, move in targets.items()}


def lifted(columns: tuple[str, ...], keep: tuple[str, ...] = ("tenant", "created_at")) -> Move:
    """A move to a family that has some of the columns, and the source's tenant and tick."""
    return lambda df: df.select(*[c for c in keep if c in df.columns], *[c for c in columns if c not in keep])
