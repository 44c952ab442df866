"""Repair of an assignment: districts in one piece, then as many people in each as moves of border cells allow.

One state (and arm) is a group: each step depends on all before it, and a state's grid is bounded. Cells are numbers in
the order of (r, c). Every change goes on a log, so that a step that did not help is taken back and is not counted. Border
cells are kept by the pair of districts that they part and only looked at again around a cell that moved. Whether a district stays whole
without some cells is searched from all sides of the gap in turn, so that a part that comes off costs its own size; such parts are kept while
they hold."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .kernels import Budget, checked_state, failure

Cell = tuple[int, int]
#: A detached piece of more than this share of the ideal is divided among its neighbours; chains run while a district
#: is further off than this; at most so many ways are tried in a round of chains.
LARGE, NEAR_ENOUGH, WAYS = 0.1, 0.009, 4
#: Tasks that groups are dealt over at least. Groups are few and their rows small, so adaptive execution would put them into one task after each other.
TASKS = 64
#: Cells that kept parts may hold in all; what is not kept is searched again.
KEPT = 4_000_000


class Board:
    def __init__(self, pop: dict[Cell, int], district: dict[Cell, int], seats: int, ideal: float, bridges: Iterable[tuple[Cell, Cell]] = (), budget: Budget | None = None):
        self.budget = budget or Budget()
        self.cells = sorted(pop)
        self.number = number = {k: i for i, k in enumerate(self.cells)}
        near = [[number[x] for x in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)) if x in number] for r, c in self.cells]
        for a, b in bridges:
            if a in number and b in number:
                near[number[a]].append(number[b])
                near[number[b]].append(number[a])
        self.near = near
        self.pop = [pop[k] for k in self.cells]
        self.seats, self.ideal = seats, ideal
        self.of = [district[k] for k in self.cells]
        self.own: list[set[int]] = [set() for _ in range(seats + 1)]
        self.people = [0] * (seats + 1)
        for i, d in enumerate(self.of):
            self.own[d].add(i)
            self.people[d] += self.pop[i]
        self.log: list[tuple[int, int]] = []
        self.orphan_pieces = self.orphan_cells = self.settled = 0
        self.border: dict[tuple[int, int], set[int]] = {}
        self.filed: list[tuple[int, set[int]]] = [(0, set())] * len(self.cells)
        self.offers: dict[tuple[int, int], list[tuple[float, int]]] = {}
        #: By district and cell: a part of the district that nothing but this cell joins to the rest.
        self.parted: list[dict[int, set[int]]] = [{} for _ in range(seats + 1)]
        self.kept = 0
        for i in range(len(self.cells)):
            self._file(i)

    # ------------------------------------------------------------ moves

    @property
    def moves(self) -> int:
        """Cells moved for balance, less those taken back."""
        return len(self.log) - self.settled

    def _file(self, i: int) -> None:
        """Put i under the pairs of its own district and those beside it."""
        d = self.of[i]
        beside = {self.of[j] for j in self.near[i]} - {d}
        was, before = self.filed[i]
        if (was, before) == (d, beside):
            return
        for e in before:
            self.border[was, e].discard(i)
            self.offers.pop((was, e), None)
        for e in beside:
            self.border.setdefault((d, e), set()).add(i)
            self.offers.pop((d, e), None)
        self.filed[i] = (d, beside)

    def _put(self, i: int, to: int) -> None:
        d = self.of[i]
        self.of[i] = to
        self.own[d].discard(i)
        self.own[to].add(i)
        self.people[d] -= self.pop[i]
        self.people[to] += self.pop[i]
        self._adjust(i, d, to)
        for k in (i, *self.near[i]):
            self._file(k)
        for pair in [p for p in self.offers if p[0] in (d, to) or p[1] in (d, to)]:
            del self.offers[pair]

    def _adjust(self, i: int, d: int, to: int) -> None:
        """Keep the parts of both districts right after i went from d to to; those that i joins to others are dropped."""
        for part in self.parted[d].values():
            if i in part:
                part.discard(i)
                self.kept -= 1
        self.kept -= len(self.parted[d].pop(i, ()))
        beside = [j for j in self.near[i] if self.of[j] == to]
        for k, part in list(self.parted[to].items()):
            n = sum(j in part for j in beside)
            if n and n + (k in beside) == len(beside):
                part.add(i)
                self.kept += 1
            elif n:
                self.kept -= len(self.parted[to].pop(k))

    def give(self, cells: Iterable[int], to: int) -> None:
        for i in cells:
            self.budget.check()
            self.log.append((i, self.of[i]))
            self._put(i, to)

    def back_to(self, mark: int) -> None:
        """Take back what was done since the log had this length."""
        while len(self.log) > mark:
            self._put(*self.log.pop())

    # ------------------------------------------------------------ shapes

    def grow(self, seeds: dict[int, Iterable[int]], free: set[int], turn: Callable[[int], float] = lambda tag: 0) -> Iterator[tuple[int, int, int | None]]:
        """(tag, cell, cell before it): each tag spreads from its seeds through free cells, nearest first, then by number. Who
        is next is the tag of least turn(tag)."""
        waiting = {tag: [(0, i, -1) for i in sorted(cells)] for tag, cells in seeds.items()}
        taken: set[int] = set()
        while True:
            self.budget.check()
            for heap in waiting.values():
                while heap and heap[0][1] in taken:
                    heapq.heappop(heap)
            tags = [tag for tag, heap in waiting.items() if heap]
            if not tags:
                return
            tag = min(tags, key=lambda t: (turn(t), t))
            steps, i, before = heapq.heappop(waiting[tag])
            taken.add(i)
            for j in self.near[i]:
                if j in free and j not in taken:
                    heapq.heappush(waiting[tag], (steps + 1, j, i))
            yield tag, i, None if before < 0 else before

    def pieces(self, cells: set[int]) -> list[set[int]]:
        """Connected parts, by their first cells."""
        left, out = set(cells), []
        for start in sorted(cells):
            if start not in left:
                continue
            left.discard(start)
            part, stack = {start}, [start]
            while stack:
                fresh = [j for j in self.near[stack.pop()] if j in left]
                left.difference_update(fresh)
                part.update(fresh)
                stack += dict.fromkeys(fresh)
            out.append(part)
        return out

    def _loose(self, d: int, gone: set[int]) -> set[int] | None:
        """A part that comes off d, in one piece now, without some cells; empty if nothing of d is left, None if d stays whole. The cells beside
        the gap must reach each other: all of them search in turn, a cell at a time, and those that meet go on as one."""
        of, near = self.of, self.near
        rim = dict.fromkeys(j for i in gone for j in near[i] if of[j] == d and j not in gone)
        if not rim:
            return None if len(self.own[d]) > len(gone) and not gone & self.own[d] else set()
        seen = {j: k for k, j in enumerate(rim)}
        fronts = {k: deque([j]) for j, k in seen.items()}
        members = {k: [j] for j, k in seen.items()}
        one = list(fronts)  # the search that each search has joined
        while len(fronts) > 1:
            for k in list(fronts):
                if k not in fronts:
                    continue
                if not fronts[k]:
                    return set(members[k])
                for j in near[fronts[k].popleft()]:
                    if of[j] != d or j in gone:
                        continue
                    if j not in seen:
                        seen[j] = k
                        fronts[k].append(j)
                        members[k].append(j)
                        continue
                    other = seen[j]
                    while one[other] != other:
                        other = one[other]
                    if other != k:
                        if len(members[other]) > len(members[k]):
                            k, other = other, k
                        one[other] = k
                        fronts[k].extend(fronts.pop(other))
                        members[k] += members.pop(other)
        return None

    def whole_without(self, d: int, gone: set[int]) -> bool:
        """Whether d, in one piece now, stays so without some cells."""
        return self._loose(d, gone) is None

    def free(self, i: int) -> bool:
        """Whether i may leave its district whole. A part that comes off is kept: while i has cells of it and others of the district beside
        it, the answer is the same."""
        d = self.of[i]
        part = self.parted[d].get(i)
        if part is not None:
            if len({j in part for j in self.near[i] if self.of[j] == d}) == 2:
                return False
            self.kept -= len(self.parted[d].pop(i))
        part = self._loose(d, {i})
        if part:
            if self.kept > KEPT:
                self.parted, self.kept = [{} for _ in self.own], 0
            self.parted[d][i] = part
            self.kept += len(part)
        return part is None

    def beside(self, cells: Iterable[int], d: int) -> set[int]:
        return {self.of[j] for i in cells for j in self.near[i]} - {d}

    def _most(self, parts: list[set[int]]) -> set[int]:
        """The part of most people, then of most cells, then of the first cell."""
        return max(parts, key=lambda p: (sum(self.pop[i] for i in p), len(p), -min(p)))

    # ------------------------------------------------------------ one piece

    def settle(self) -> None:
        """Each district keeps its main part; the others go to neighbours. In the first seats + 2 rounds all districts give at the same time. Parts
        beside each other may change places so, round after round: what is left then is given by one district after the other, so that a part
        joins the part beside it, there is one fewer each time, and none is left at the end. A part of the grid that nothing touches goes to
        the nearest district, once."""
        islands: set[int] = set()
        every = range(1, self.seats + 1)
        for _ in range(self.seats + 2):
            loose = [(d, part) for d in every for part in self._detached(d, islands)]
            if not loose:
                break
            for d, part in loose:
                self._send(d, part, islands)
        else:
            while sum([self._send(d, part, islands) for d in every for part in self._detached(d, islands)]):
                pass
        self.settled = len(self.log)

    def _detached(self, d: int, islands: set[int]) -> list[set[int]]:
        """The parts of d now besides its main part, without those that begin an island."""
        parts = self.pieces(self.own[d])
        main = self._most(parts) if parts else None
        return [p for p in parts if p is not main and min(p) not in islands]

    def _send(self, d: int, part: set[int], islands: set[int]) -> int:
        """Count a detached part and house it: one more."""
        self.orphan_pieces += 1
        self.orphan_cells += len(part)
        if all(j in part for i in part for j in self.near[i]):
            islands.add(min(part))
        self._house(d, part)
        return 1

    def _house(self, d: int, part: set[int]) -> None:
        """A detached part goes to the neighbour of fewest people; a large one is shared by its neighbours by what they lack."""
        around = sorted(self.beside(part, d))
        folk = sum(self.pop[i] for i in part)
        if not around:
            r, c = self.cells[min(part)]
            around = [self._nearest(r, c, d)] if len(self.own[d]) < len(self.cells) else [d]
        if len(around) < 2 or folk <= LARGE * self.ideal:
            self.give(sorted(part), min(around, key=lambda e: (self.people[e], e)))
            return
        lack = {e: max(0.0, self.ideal - self.people[e]) for e in around}
        if not any(lack.values()):
            lack = dict.fromkeys(around, 1.0)
        share = {e: folk * x / sum(lack.values()) for e, x in lack.items()}
        got = dict.fromkeys(around, 0)
        seeds = {e: [i for i in part if any(self.of[j] == e for j in self.near[i])] for e in around}
        taken: dict[int, int] = {}
        for e, i, _ in self.grow(seeds, part, lambda e: got[e] / share[e] if share[e] else float("inf")):
            taken[i] = e
            got[e] += self.pop[i]
        for i in sorted(part):
            self.give([i], taken[i])

    def _nearest(self, r: int, c: int, d: int) -> int:
        """The district other than d with the cell that is fewest rows or columns away, then the smallest: looked for in rings, or among all
        cells where the rings would hold more."""
        for n in range(int(len(self.cells) ** 0.5) // 2 + 1):
            ring = [(r + s * n, c + k) for s in (-1, 1) for k in range(-n, n + 1)] + [(r + k, c + s * n) for s in (-1, 1) for k in range(1 - n, n)]
            found = {self.of[self.number[x]] for x in ring if x in self.number} - {d}
            if found:
                return min(found)
        far = lambda i: max(abs(self.cells[i][0] - r), abs(self.cells[i][1] - c))
        return min((far(i), self.of[i]) for i in range(len(self.cells)) if self.of[i] != d)[1]

    # ------------------------------------------------------------ balance

    def change(self, d: int, e: int, n: int) -> float:
        """By how much the sum of deviations changes when n people go from d to e."""
        over, under = self.people[d] - self.ideal, self.people[e] - self.ideal
        return abs(over - n) - abs(over) + abs(under + n) - abs(under)

    def _unequal(self) -> list[tuple[int, int]]:
        """Pairs of neighbours, the first above the ideal and the second below."""
        return sorted((d, e) for (d, e), cells in self.border.items() if cells and self.people[d] > self.ideal > self.people[e])

    def single(self) -> bool:
        """The border cell whose move helps most, by 1 at least, and leaves its district whole; ties by cell, then taker."""
        def told(d: int, e: int) -> Iterator[tuple[float, int, int, int]]:
            return ((x, i, e, d) for x, i in self.offers[d, e])

        lists = []
        for d, e in self._unequal():
            if (d, e) not in self.offers:
                self.offers[d, e] = sorted((x, i) for i in self.border[d, e] if (x := self.change(d, e, self.pop[i])) <= -1)
            lists.append(told(d, e))
        for _, i, e, _ in heapq.merge(*lists):
            if self.free(i):
                self.give([i], e)
                return True
        return False

    def corridor(self) -> bool:
        """The way through cells without people, from a border to the first cell with people, whose move helps most."""
        found = []
        for d, e in self._unequal():
            came: dict[int, int | None] = {}
            for _, i, before in self.grow({d: self.border[d, e]}, self.own[d]):
                came[i] = before
                if self.pop[i]:
                    way = [i]
                    while came[way[-1]] is not None:
                        way.append(came[way[-1]])
                    found.append((self.change(d, e, self.pop[i]), len(way), way[-1], e, d, way))
                    break
        useful = [x for x in found if x[0] <= -1]
        if not useful:
            return False
        *_, e, d, way = min(useful)
        if not self.whole_without(d, set(way)):
            return False
        self.give(way[::-1], e)
        return True

    def balance(self) -> None:
        """Single moves, and a corridor where none helps; each lowers the sum of deviations by 1 at least."""
        for _ in range(500 + 5 * self.orphan_cells):
            if not self.single() and not self.corridor():
                return

    # ------------------------------------------------------------ chains

    def worst(self) -> float:
        return max(abs(x - self.ideal) for x in self.people[1:])

    def chains(self) -> None:
        """While a district is too far off: people go from the largest to the smallest along neighbours. A round that does not
        lower the worst deviation is taken back and is the last."""
        for _ in range(8 * self.seats):
            worst, mark = self.worst(), len(self.log)
            if worst <= NEAR_ENOUGH * self.ideal:
                return
            if not self._flow():
                return
            if self.worst() >= worst:
                self.back_to(mark)
                return

    def _flow(self) -> bool:
        seats = range(1, self.seats + 1)
        high = max(seats, key=lambda d: (self.people[d], -d))
        low = min(seats, key=lambda d: (self.people[d], d))
        amount = min(self.people[high] - self.ideal, self.ideal - self.people[low])
        barred: set[tuple[int, int]] = set()
        links = {(d, e) for (d, e), cells in self.border.items() if cells}
        for _ in range(WAYS):
            mark, way = len(self.log), self._way(high, low, links - barred)
            stuck = next(((a, b) for a, b in zip(way, way[1:], strict=False) if not self._pass_on(a, b, amount)), None)
            if way and stuck is None:
                return True
            self.back_to(mark)
            if stuck is None:
                return False
            barred.add(stuck)
        return False

    @staticmethod
    def _way(start: int, end: int, links: set[tuple[int, int]]) -> list[int]:
        """A shortest chain of districts, the smallest number first at every step; empty if there is none."""
        steps, layer = {end: 0}, {end}
        while layer and start not in steps:
            layer = {a for a, b in links if b in layer and a not in steps}
            steps |= dict.fromkeys(layer, max(steps.values()) + 1)
        if start not in steps:
            return []
        way = [start]
        while way[-1] != end:
            way.append(min(b for a, b in links if a == way[-1] and steps.get(b) == steps[way[-1]] - 1))
        return way

    def _pass_on(self, a: int, b: int, amount: float) -> bool:
        """b gets cells of a, about so many people, half as many each time that a would fall apart. If even the least bite
        parts a, the parts that come off go to the neighbour of fewest people each."""
        bite: list[int] = []
        while amount >= 1:
            bite, folk = [], 0
            for _, i, _ in self.grow({a: self.border.get((a, b), set())}, self.own[a]):
                if folk and abs(folk + self.pop[i] - amount) > abs(folk - amount):
                    break
                bite.append(i)
                folk += self.pop[i]
                if folk >= amount:
                    break
            if not folk:
                return False
            if self.whole_without(a, set(bite)):
                self.give(bite, b)
                return True
            amount = amount / 2 if amount < 2 else amount // 2
        if not bite:
            return False
        self.give(bite, b)
        parts = self.pieces(self.own[a])
        main = self._most(parts) if parts else None
        for part in parts:
            if part is not main:
                self.give(sorted(part), min(self.beside(part, a) or {b}, key=lambda e: (self.people[e], e)))
        return True


def repair(pop: dict[Cell, int], district: dict[Cell, int], seats: int, ideal: float, bridges: Iterable[tuple[Cell, Cell]] = (), budget: Budget | None = None) -> Board:
    board = Board(pop, district, seats, ideal, bridges, budget)
    board.settle()
    board.balance()
    board.chains()
    return board


def repair_all(assigned: DataFrame, seats: DataFrame, bridges: DataFrame | None = None, errors: bool = False, budget: float | None = None) -> DataFrame:
    """(state, r, c, pop, district, orphan_pieces, orphan_cells, rebalance_moves, repair_moves) after repair, state by state. bridges:
    (state, ar, ac, br, bc). orphan_pieces and orphan_cells: detached parts that found a district; rebalance_moves: cells moved for
    balance; repair_moves: both cells. With errors there is a column error: a state whose repair fails is one row with it, and the others go
    on; without, a failure ends the job. budget: seconds a state."""
    counts = ["orphan_pieces", "orphan_cells", "rebalance_moves", "repair_moves"]
    names = ["state", "r", "c", "pop", "district", *counts, *["error"] * errors]

    def run(key: tuple, pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=names)
        try:
            pdf = pdf.sort_values(["r", "c"])
            keys = list(zip(pdf["r"].tolist(), pdf["c"].tolist(), strict=True))
            pop = dict(zip(keys, pdf["pop"].tolist(), strict=True))
            n = checked_state(pop.values(), pdf["seats"].iloc[0])
            if not pdf["district"].between(1, n).all():
                raise ValueError(f"districts outside 1 to {n}")
            pairs = [((a, b), (c, d)) for a, b, c, d in links[["ar", "ac", "br", "bc"]].itertuples(index=False)]
            board = repair(pop, dict(zip(keys, pdf["district"].tolist(), strict=True)), n, sum(pop.values()) / n, pairs, Budget(budget))
            told = dict(zip(counts, (board.orphan_pieces, board.orphan_cells, board.moves, board.orphan_cells + board.moves), strict=True))
            return pdf.assign(district=board.of, error=None, **told)[names]
        except Exception as e:
            if not errors:
                raise
            return pd.DataFrame([(key[0], *[None] * (len(names) - 2), failure(e))], columns=names)

    own = assigned.join(seats, "state").select("state", "r", "c", "pop", "district", "seats")
    kinds = dict(own.dtypes)
    if bridges is None:
        bridges = own.sparkSession.createDataFrame([], f"state {kinds['state']}, ar int, ac int, br int, bc int")
    schema = f"state {kinds['state']}, r {kinds['r']}, c {kinds['c']}, pop {kinds['pop']}, district int, " + ", ".join(f"{c} int" for c in counts) + ", error string" * errors
    tasks = max(TASKS, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt, links = own.repartition(tasks, "state"), bridges.repartition(tasks, "state")
    return dealt.groupBy("state").cogroup(links.groupBy("state")).applyInPandas(run, schema)
