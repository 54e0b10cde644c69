"""Constrained inference as a user declares and calls it: learners' scores, normalisers, constraints, exact 0-1 programs.

An Inference names the head column, a normaliser for each learner and a constraint, a function of a head's variables that
returns a tree (see constraints.py). Calling it on a table of scores deals them by head, so that each head's problem
is read as one run of rows and heads are solved in parallel; no cache of live problems is needed.

Trees may also hold ("same", var, var) and ("equal", value, value); `for_all`, `exists`, `at_least` and `at_most` expand a
quantifier over a collection, and a constraint that calls another is a function call.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from corpusloom.functions.normalize import log_softmax, sigmoid, softmax
from corpusloom.operators.constraints import linearize, truth
from corpusloom.sources.views import table

# ---------------------------------------------------------------------------------------------- constraints as logic


def for_all(items: Iterable, body: Callable) -> tuple:
    """The body for every item; true over nothing."""
    return ("and", *[body(x) for x in items])


def exists(items: Iterable, body: Callable) -> tuple:
    """The body for some item; false over nothing."""
    return ("or", *[body(x) for x in items])


def at_least(m: int, items: Iterable, body: Callable) -> tuple:
    """The body for m items or more; a negative m counts as 0."""
    return ("atleast", max(0, m), *[body(x) for x in items])


def at_most(m: int, items: Iterable, body: Callable) -> tuple:
    return ("atmost", m, *[body(x) for x in items])


def variables_of(c: tuple) -> set:
    """The variables a tree speaks of."""
    if c[0] == "is":
        return {c[1]}
    if c[0] == "same":
        return {c[1], c[2]}
    return set().union(*[variables_of(x) for x in c[1:] if isinstance(x, tuple)], set())


def propositional(c: tuple, domains: dict) -> tuple:
    """The tree over literals ("is", var, value) and constants alone; two variables are the same where they share a value."""
    kind = c[0]
    if kind == "equal":
        return ("const", c[1] == c[2])
    if kind == "same":
        shared = [v for v in domains[c[1]] if v in domains[c[2]]]
        return ("or", *[("and", ("is", c[1], v), ("is", c[2], v)) for v in shared])
    if kind == "is":
        return c if c[2] in domains[c[1]] else ("const", False)
    return tuple(propositional(x, domains) if isinstance(x, tuple) else x for x in c)


def negated(c: tuple) -> tuple:
    """The opposite, with the negation moved to the literals."""
    kind = c[0]
    if kind == "const":
        return ("const", not c[1])
    if kind == "is":
        return ("not", c)
    if kind == "not":
        return simplified(c[1])
    if kind == "and":
        return simplified(("or", *[negated(x) for x in c[1:]]))
    if kind == "or":
        return simplified(("and", *[negated(x) for x in c[1:]]))
    if kind == "implies":
        return simplified(("and", c[1], negated(c[2])))
    if kind == "iff":
        return simplified(("iff", c[1], negated(c[2])))
    if kind == "atmost":
        return simplified(("atleast", c[1] + 1, *c[2:]))
    n = len(c) - 2  # fewer than m hold if n - m + 1 or more do not
    return simplified(("atleast", n - c[1] + 1, *[negated(x) for x in c[2:]]))


def simplified(c: tuple) -> tuple:
    """Negations at the literals, no implication, constants folded, nested and repeated parts joined."""
    kind = c[0]
    if kind in ("const", "is"):
        return c
    if kind == "not":
        return c if c[1][0] == "is" else negated(c[1])
    if kind == "implies":
        return simplified(("or", negated(c[1]), c[2]))
    if kind == "atmost":
        return simplified(("atleast", len(c) - 2 - c[1], *[negated(x) for x in c[2:]]))
    if kind == "iff":
        a, b = simplified(c[1]), simplified(c[2])
        if "const" in (a[0], b[0]):
            held, other = (a, b) if a[0] == "const" else (b, a)
            return other if held[1] else negated(other)
        return ("const", True) if a == b else ("iff", a, b)
    if kind == "atleast":
        parts = [simplified(x) for x in c[2:]]
        m = max(0, c[1]) - sum(x == ("const", True) for x in parts)
        parts = [x for x in parts if x[0] != "const"]
        if m <= 0 or m > len(parts):
            return ("const", m <= 0)
        if m == 1 or m == len(parts):
            return simplified(("or" if m == 1 else "and", *parts))
        return ("atleast", m, *parts)
    neutral = kind == "and"
    parts: list[tuple] = []
    for x in map(simplified, c[1:]):
        for y in x[1:] if x[0] == kind else (x,):
            if y == ("const", not neutral):
                return y
            if y[0] != "const" and y not in parts:
                parts.append(y)
    if any((("not", x) if x[0] == "is" else x[1]) in parts for x in parts if x[0] in ("is", "not")):
        return ("const", not neutral)
    return ("const", neutral) if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def choices(n: int, m: int) -> Iterator[tuple[int, ...]]:
    """All ways to choose m of n places, in order."""
    return itertools.combinations(range(n), m)


def _spread(c: tuple, outer: str) -> list[frozenset]:
    """The parts of a normal form: sets of literals, joined by the other connective inside; outer is `and` or `or`."""
    inner = "or" if outer == "and" else "and"
    c = simplified(c)
    if c[0] == "const":
        return [] if c[1] == (outer == "and") else [frozenset()]
    if c[0] in ("is", "not"):
        return [frozenset([c])]
    if c[0] == "iff":
        return _spread(("and", ("or", negated(c[1]), c[2]), ("or", c[1], negated(c[2]))) if outer == "and" else ("or", ("and", c[1], c[2]), ("and", negated(c[1]), negated(c[2]))), outer)
    if c[0] == "atleast":
        n, m = len(c) - 2, c[1]
        size = n - m + 1 if outer == "and" else m  # some of any n - m + 1 must hold, or all of some m
        return _spread((outer, *[(inner, *[c[2 + i] for i in own]) for own in choices(n, size)]), outer)
    if c[0] == outer:
        found = [x for part in c[1:] for x in _spread(part, outer)]
    else:
        found = [frozenset().union(*own) for own in itertools.product(*[_spread(part, outer) for part in c[1:]])]
    clear = {x for x in found if not any(("not", y) in x for y in x if y[0] == "is")}
    return sorted((x for x in clear if not any(y < x for y in clear)), key=lambda x: sorted(map(str, x)))


def cnf(c: tuple) -> tuple:
    """Conjunctive normal form: an and of ors of literals, without parts that follow from others."""
    return simplified(("and", *[("or", *sorted(x, key=str)) for x in _spread(c, "and")]))


def dnf(c: tuple) -> tuple:
    """Disjunctive normal form."""
    return simplified(("or", *[("and", *sorted(x, key=str)) for x in _spread(c, "or")]))


def factored(c: tuple) -> tuple:
    """Literals that all parts of an or of ands share, before the or."""
    c = simplified(c)
    if c[0] != "or" or any(x[0] != "and" for x in c[1:]):
        return c
    shared = [x for x in c[1][1:] if all(x in y[1:] for y in c[2:])]
    return c if not shared else simplified(("and", *shared, ("or", *[("and", *[x for x in y[1:] if x not in shared]) for y in c[1:]])))


# ------------------------------------------------------------------------------------------------------ 0-1 programs


class NotOptimal(Exception):
    """A program without a solution was asked for its values."""


class TooWide(Exception):
    """A program was not solved within the number of branches that it may try."""


@dataclass
class Program:
    """A 0-1 program: maximise (or minimise) a sum of weights under linear rows; solved exactly by branch and bound.

    Values are bound part by part: rows that share no variable are solved apart. Inside a part, variables of one discrete
    choice are tried together, best first; a branch ends where a bound on what is open can't beat the best known
    solution, or where some row can no longer be met. Rows of one choice alone are met beforehand, and of options that use the other rows alike one is tried. Wide parts charge each row a price for what it uses, which gives a bound that
    knows of the rows. Branches are kept on a list, so depth has no limit; their number has one, `most`, beyond which solve() raises TooWide.
    """

    maximize: bool = True
    weights: list[float] = field(default_factory=list)
    groups: list[list[int]] = field(default_factory=list)  # of each group exactly one is 1
    rows: list[tuple[dict[int, float], str, float]] = field(default_factory=list)
    values: list[int] | None = None
    most: int = 2_000_000

    def add_boolean(self, weight: float = 0.0) -> int:
        if math.isnan(weight):
            raise ValueError("a weight is no number")
        self.weights.append(weight)
        return len(self.weights) - 1

    def add_discrete(self, weights: Sequence[float]) -> list[int]:
        """A variable for each value, exactly one of which is 1."""
        made = [self.add_boolean(w) for w in weights]
        self.groups.append(made)
        return made

    def add_row(self, coefficients: dict[int, float], op: str, bound: float) -> None:
        if op not in ("=", ">=", "<="):
            raise ValueError(op)
        self.rows.append((coefficients, op, bound))

    def reset(self) -> None:
        self.weights, self.groups, self.rows, self.values = [], [], [], None

    def value(self, variable: int) -> bool:
        if self.values is None:
            raise NotOptimal("the program has no solution")
        return self.values[variable] == 1

    def solve(self) -> bool:
        """Whether there is a solution; ties go to the earlier variables of a choice, and to 0 for free ones."""
        sign = 1.0 if self.maximize else -1.0
        rows = [(c, "<=", b) for c, op, b in self.rows if op != ">="] + [({k: -v for k, v in c.items()}, "<=", -b) for c, op, b in self.rows if op != "<="]
        parent = list(range(len(self.weights)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for own in [*self.groups, *[list(c) for c, _, _ in rows]]:
            for x in own[1:]:
                parent[root(x)] = root(own[0])
        grouped = {x for g in self.groups for x in g}
        choices_of: dict[int, list[list[tuple[int, ...]]]] = {}
        for g in self.groups:
            choices_of.setdefault(root(g[0]), []).append([(x,) for x in g])
        for x in range(len(self.weights)):
            if x not in grouped:
                choices_of.setdefault(root(x), []).append([(), (x,)])
        members: dict[int, list[int]] = {}
        for x in range(len(self.weights)):
            members.setdefault(root(x), []).append(x)
        self.values = None
        values = [0] * len(self.weights)
        if any(not c and b < 0 for c, _, b in rows):
            return False
        for top, sets in choices_of.items():
            found = self._part(sets, members[top], [(c, b) for c, _, b in rows if c and root(next(iter(c))) == top], sign)
            if found is None:
                return False
            for x in found:
                values[x] = 1
        self.values = values
        return True

    def _part(self, sets: list, members: list[int], rows: list, sign: float) -> list[int] | None:
        gain = lambda own: sum(sign * self.weights[x] for x in own)
        options = [sorted([(own, gain(own)) for own in s], key=lambda o: -o[1]) for s in sets]
        options.sort(key=lambda s: s[-1][1] - s[0][1])
        at_choice = {x: i for i, s in enumerate(options) for own, _ in s for x in own}
        shared = []
        for c, b in rows:  # a row of one choice alone rules options out for good
            if len(among := {at_choice[x] for x in c}) > 1:
                shared.append((c, b))
                continue
            i = among.pop()
            options[i] = [(own, g) for own, g in options[i] if sum(c.get(x, 0.0) for x in own) <= b + 1e-9]
            if not options[i]:
                return None
        rows = shared
        inside: dict[int, list[tuple[int, float]]] = {x: [] for x in members}
        for r, (c, _) in enumerate(rows):
            for x, coefficient in c.items():
                inside[x].append((r, coefficient))
        uses = [[_total(inside, own) for own, _ in s] for s in options]  # of each option: row to coefficient
        for i, us in enumerate(uses):  # of options that use the rows alike, the first gains most
            firsts = list({frozenset(u.items()): k for k, u in reversed(list(enumerate(us)))}.values())
            if len(firsts) < len(us):
                firsts.sort()
                options[i], uses[i] = [options[i][k] for k in firsts], [us[k] for k in firsts]
        touched = [sorted(set().union(*u)) for u in uses]
        lows = [{r: min(u.get(r, 0.0) for u in us) for r in rs} for us, rs in zip(uses, touched, strict=True)]
        prices = _prices(options, uses, [b for _, b in rows]) if len(options) > WIDE else [0.0] * len(rows)
        plain, priced = [0.0], [0.0]  # the most that options from a place on can still add, without and with prices
        for s, us in zip(reversed(options), reversed(uses), strict=True):
            plain.append(plain[-1] + s[0][1])
            priced.append(priced[-1] + max(g - sum(prices[r] * v for r, v in u.items()) for (_, g), u in zip(s, us, strict=True)))
        plain.reverse()
        priced.reverse()
        bounds = [b for _, b in rows]
        credit = sum(p * b for p, b in zip(prices, bounds, strict=True))
        lowest = [0.0] * len(rows)  # what a row has at least, if the open options add the least to it
        for low in lows:
            for r, v in low.items():
                lowest[r] += v
        if any(v > b + 1e-9 for v, b in zip(lowest, bounds, strict=True)):
            return None
        best, found, total, paid, tried = -math.inf, None, 0.0, 0.0, 0
        at, pick = 0, [-1] * (len(options) + 1)
        while at >= 0:
            if pick[at] >= 0:  # takes the last option of this place back
                use = uses[at][pick[at]]
                total -= options[at][pick[at]][1]
                for r in touched[at]:
                    lowest[r] -= use.get(r, 0.0) - lows[at][r]
                paid -= sum(prices[r] * v for r, v in use.items())
            pick[at] += 1
            if pick[at] == len(options[at]):
                pick[at] = -1
                at -= 1
                continue
            tried += 1
            if tried > self.most:
                raise TooWide(f"{len(options)} choices under {len(rows)} rows were not decided within {self.most} branches")
            use = uses[at][pick[at]]
            total += options[at][pick[at]][1]
            for r in touched[at]:
                lowest[r] += use.get(r, 0.0) - lows[at][r]
            paid += sum(prices[r] * v for r, v in use.items())
            if any(lowest[r] > bounds[r] + 1e-9 for r in touched[at]):
                continue
            if found is not None and (total + plain[at + 1] <= best + 1e-12 or total - paid + credit + priced[at + 1] <= best + 1e-9 * max(1.0, abs(best))):
                continue
            if at + 1 == len(options):
                best, found = total, [x for s, p in zip(options, pick, strict=False) for x in s[p][0]]
                continue
            at += 1
        return found


#: Parts of more choices than this get prices.
WIDE = 48


def _total(inside: dict[int, list[tuple[int, float]]], own: tuple[int, ...]) -> dict[int, float]:
    out: dict[int, float] = {}
    for x in own:
        for r, coefficient in inside[x]:
            out[r] = out.get(r, 0.0) + coefficient
    return out


def _prices(options: list, uses: list, bounds: list[float], sweeps: int = 3) -> list[float]:
    """A price from 0 for each row, one row after another at the point where the options that are best at these prices just
    use up the row: any prices give a bound, and these a close one."""
    prices = [0.0] * len(bounds)
    members: list[list[int]] = [[] for _ in bounds]
    for i, us in enumerate(uses):
        for r in set().union(*us):
            members[r].append(i)
    for _ in range(sweeps if len(bounds) > 1 else 1):
        for r, own in enumerate(members):
            # of each choice that names the row: what its options gain at the other rows' prices, and what they use of this one
            lines = [[(g - sum(prices[q] * v for q, v in u.items() if q != r), u.get(r, 0.0)) for (_, g), u in zip(options[i], uses[i], strict=True)] for i in own]
            fixed = lambda p: -sum(max((g - p * v, -v) for g, v in line)[1] for line in lines)  # noqa: B023, E731
            if fixed(0.0) <= bounds[r]:
                prices[r] = 0.0
                continue
            low, high = 0.0, 1.0
            while fixed(high) > bounds[r] and high < 1e12:
                low, high = high, 2 * high
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if fixed(middle) > bounds[r] else (low, middle)
            prices[r] = high
    return prices


def assign(scores: dict, constraint: tuple, naive: bool = False) -> dict:
    """Variable to value: the assignment of the highest total score under a propositional constraint, by linear rows.

    scores: variable to {value: score}. The constraint is simplified first; `naive` linearises it as it is, with a helper
    for each node. Raises NotOptimal where no assignment satisfies it.
    """
    program, places = Program(), {}
    for var, own in scores.items():
        for value, at in zip(own, program.add_discrete(list(own.values())), strict=True):
            places["is", var, value] = at
    tree = constraint if naive else simplified(constraint)
    if tree != ("const", True):
        rows, helpers = [], {}
        literal, sign = linearize(tree, rows, helpers)
        for z in helpers.values():
            places[z] = program.add_boolean()
        for own, op, bound in rows:
            sums: dict[int, float] = {}
            for name, coefficient in own:
                sums[places[name]] = sums.get(places[name], 0.0) + coefficient
            program.add_row(sums, op, bound)
        program.add_row({places[literal]: 1.0}, "=", 1.0 if sign > 0 else 0.0)
    program.solve()
    return {var: next(value for value in own if program.value(places["is", var, value])) for var, own in scores.items()}


def k_best(scores: dict, constraint: tuple, k: int) -> list[tuple[float, dict]]:
    """The k assignments of the highest total score that satisfy the constraint, best first, by best-first search. Totals equal to nine places
    are ordered by the values."""
    order = sorted(scores, key=str)
    ranked = [sorted(scores[v].items(), key=lambda x: (-x[1], str(x[0]))) for v in order]
    rest = [0.0]
    for own in reversed(ranked):
        rest.append(rest[-1] + own[0][1])
    rest.reverse()
    heap, out, tied, serial = [(-rest[0], 0, 0.0, ())], [], [], itertools.count(1)
    while heap or tied:
        if tied and (not heap or -heap[0][0] < tied[0][0] - 1e-9):  # nothing that is left is as good
            out += sorted(tied, key=lambda x: [str(x[1][v]) for v in order])
            tied = []
            if len(out) >= k:
                break
            continue
        _, _, total, own = heapq.heappop(heap)
        values = dict(zip(order, own, strict=False))
        if truth(constraint, values) is False:
            continue
        if len(own) == len(order):
            tied.append((total, values))
            continue
        for value, score in ranked[len(own)]:
            heapq.heappush(heap, (-(total + score + rest[len(own) + 1]), next(serial), total + score, (*own, value)))
    return out[:k]


def rerank(scores: dict, constraint: tuple, k: int, alpha: float, coherence: Callable[[dict], float]) -> dict:
    """Of the k best assignments, the one of the highest alpha * score + (1 - alpha) * coherence."""
    return max(k_best(scores, constraint, k), key=lambda x: alpha * x[0] + (1 - alpha) * coherence(x[1]))[1]


# --------------------------------------------------------------------------------------------- inference over tables

NORMALISERS: dict[str, Callable[[Column, list[str]], Column]] = {"identity": lambda s, by: s, "softmax": softmax, "log_softmax": log_softmax, "sigmoid": lambda s, by: sigmoid(s)}


@dataclass(frozen=True)
class Inference:
    """head: the column whose rows form one problem; normalisers: learner to a name of NORMALISERS, `*` for the others;
    constraint: takes {(learner, object): values} of a head and returns a tree; solver: another function of scores and a
    propositional tree that gives the values or raises NotOptimal."""

    head: str
    constraint: Callable[[dict], tuple]
    normalisers: dict[str, str] = field(default_factory=dict)
    naive: bool = False
    solver: Callable[[dict, tuple], dict] | None = None

    def __call__(self, scores: DataFrame) -> DataFrame:
        """head, learner, object, value, score, optimal of rows (head, learner, object, value, score).

        Repeated variables count once. A score that is null or no number, before or after it is normalised, is refused. Where no assignment satisfies a head's constraint, its variables have null values
        and `optimal` is false.
        """
        constraint, naive, solver = self.constraint, self.naive, self.solver

        def solved(key, held: dict) -> list[tuple]:
            tree = propositional(constraint(held), held)
            try:
                found = solver(held, tree) if solver else assign(held, tree, naive)
            except NotOptimal:
                return [(key, a, b, None, None, False) for a, b in held]
            return [(key, a, b, v, held[a, b][v], True) for (a, b), v in found.items()]

        return self._by_head(scores, solved, {"learner": "string", "object": "string", "value": "string", "score": "double", "optimal": "boolean"})

    def k_best(self, scores: DataFrame, k: int) -> DataFrame:
        """head, rank, total, values of the k assignments of the highest total score, best first; fewer where fewer satisfy the
        constraint. values: map from `learner object` to the value."""
        constraint = self.constraint

        def ranked(key, held: dict) -> list[tuple]:
            found = k_best(held, propositional(constraint(held), held), k)
            return [(key, i + 1, total, [(f"{a} {b}", v) for (a, b), v in values.items()]) for i, (total, values) in enumerate(found)]

        return self._by_head(scores, ranked, {"rank": "int", "total": "double", "values": "map<string,string>"})

    def _by_head(self, scores: DataFrame, answer: Callable[[Any, dict], list[tuple]], columns: dict[str, str]) -> DataFrame:
        """The answers for each head, one head after another of a sorted partition; no more than a head's scores and a batch's answers are held."""
        own = [self.head, "learner", "object"]
        n = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = scores.repartition(n, self.head).dropDuplicates([self.head, "learner", "object", "value"])  # the one shuffle
        value = NORMALISERS[self.normalisers.get("*", "identity")](F.col("score"), own)
        for name in [x for x in self.normalisers if x != "*"]:
            value = F.when(F.col("learner") == name, NORMALISERS[self.normalisers[name]](F.col("score"), own)).otherwise(value)
        rows = rows.select(self.head, "learner", "object", "value", value.cast("double").alias("score"))
        names = [self.head, *columns]
        types = [to_arrow_type(DataType.fromDDL(t)) for t in columns.values()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, kind = None, {}, None

            def sent(made: list[tuple]) -> pa.RecordBatch:
                found = zip(*made, strict=True) if made else [()] * len(names)
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, [kind, *types], strict=True)], names=names)

            for batch in batches:
                kind, made = batch.schema.field(0).type, []
                for now, learner, obj, value, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and now != key:
                        made += answer(key, held)
                        held = {}
                    key = now
                    if score is None or math.isnan(score):
                        raise ValueError(f"no number as score of {value!r} for {learner!r}, {obj!r} of {now!r}")
                    held.setdefault((learner, obj), {})[value] = score
                yield sent(made)
            if held:
                yield sent(answer(key, held))

        ordered = rows.sortWithinPartitions(self.head, "learner", "object", "value")
        return ordered.mapInArrow(run, ", ".join([f"{self.head} {dict(scores.dtypes)[self.head]}", *[f"{c} {t}" for c, t in columns.items()]]))


def reranked(ranked: DataFrame, head: str, coherence: Column, alpha: float) -> DataFrame:
    """Of each head's assignments (head, rank, total, values, and what `coherence` reads), the one of the highest
    alpha * total + (1 - alpha) * coherence, the better ranked of equals; with the columns coherence and combined."""
    rows = ranked.withColumn("coherence", coherence.cast("double"))
    rows = rows.withColumn("combined", alpha * F.col("total") + (1 - alpha) * F.col("coherence"))
    best = rows.groupBy(head).agg(F.min(F.struct((-F.col("combined")).alias("c"), "rank", "total", "coherence", "combined", F.map_entries("values").alias("v"))).alias("b"))
    return best.select(head, "b.rank", "b.total", "b.coherence", "b.combined", F.map_from_entries("b.v").alias("values"))


_WORDS = {"de": " der ", "en": " the ", "es": " que ", "fr": " les "}


def _language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, learner, object, value, score: languages of both halves of a text by one word each, and its size."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = rows.select("doc_id", F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))").alias("one"),
        F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)").alias("two"), (half > 1000).alias("large"))
    times = lambda c, w: F.size(F.split(c, w)) - 1
    made = [F.struct(F.lit("lang").alias("learner"), F.lit(o).alias("object"), F.lit(k).alias("value"), (F.least(times(F.col(c), w),
        F.lit(20)) / 10 + F.lit(step * i)).alias("score")) for o, c, step in (("1", "one", 0.011), ("2", "two", 0.013)) for i, (k, w) in enumerate(_WORDS.items())]
    made += [F.struct(F.lit("size").alias("learner"), F.lit("0").alias("object"), F.lit(v).alias("value"), F.when(F.col("large") == (v == "large"),
        s).otherwise(0.017).alias("score")) for v, s in (("large", 0.31), ("small", 0.29))]
    return parts.select("doc_id", F.explode(F.array(*made)).alias("x")).select("doc_id", "x.*")


def _one_language(held: dict) -> tuple:
    """Both halves have one language; English and Spanish texts are large."""
    halves = [("lang", "1"), ("lang", "2")]
    same = ("same", *halves)
    return ("and", same, for_all(halves, lambda h: ("implies", exists(["en", "es"], lambda v: ("is", h, v)), ("is", ("size", "0"), "large"))))


def constrained_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, learner, object, value, score of the best assignment, languages by softmax and sizes as they are."""
    found = Inference("doc_id", _one_language, {"lang": "softmax"})(_language_scores(spark, sf_dir))
    return found.select("doc_id", "learner", "object", "value", F.round("score", 6).alias("score"), "optimal")


def free_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a constraint."""
    found = Inference("doc_id", lambda held: ("const", True), {"*": "sigmoid"})(_language_scores(spark, sf_dir))
    return found.select("doc_id", "learner", "object", "value", F.round("score", 6).alias("score"), "optimal")


K, ALPHA = 6, 0.55


def _large_if_english(held: dict) -> tuple:
    """A half in English or Spanish makes a text large; a large text has a half in one of them."""
    some = exists([("lang", "1"), ("lang", "2")], lambda h: exists(["en", "es"], lambda v: ("is", h, v)))
    return ("iff", some, ("is", ("size", "0"), "large"))


def k_best_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rank, total, one, two, size of the K best assignments of each document."""
    found = Inference("doc_id", _large_if_english).k_best(_language_scores(spark, sf_dir), K)
    return found.select("doc_id", "rank", F.round("total", 6).alias("total"), *[F.element_at("values", F.lit(k)).alias(n) for k, n in (("lang 1", "one"), ("lang 2", "two"), ("size 0", "size"))])


def reranked_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rank, total, coherence, combined of the best of these by score and coherence: halves that agree, and with the stored language."""
    found = Inference("doc_id", _large_if_english).k_best(_language_scores(spark, sf_dir), K).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    one, two = F.element_at("values", F.lit("lang 1")), F.element_at("values", F.lit("lang 2"))
    coherence = F.when(one == two, 0.5).otherwise(0.0) + F.when(one == F.col("lang"), 0.25).otherwise(0.0) + F.when(two == F.col("lang"), 0.125).otherwise(0.0)
    best = reranked(found, "doc_id", coherence, ALPHA)
    return best.select("doc_id", "rank", F.round("total", 6).alias("total"), F.round("coherence", 6).alias("coherence"), F.round("combined", 6).alias("combined"))


def constraint_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, holds: whether the best values of each variable on their own satisfy the constraint; SQL booleans."""
    rows = _language_scores(spark, sf_dir)
    best = rows.groupBy("doc_id", "learner", "object").agg(F.max_by("value", "score").alias("value"))
    wide = best.groupBy("doc_id").agg(*[F.max(F.when((F.col("learner") == a) & (F.col("object") == b), F.col("value"))).alias(a + b) for a, b in (("lang", "1"), ("lang", "2"), ("size", "0"))])
    large = F.col("size0") == "large"
    return wide.select("doc_id", ((F.col("lang1") == F.col("lang2")) & (~F.col("lang1").isin("en", "es") | large) & (~F.col("lang2").isin("en", "es") | large)).alias("holds"))


def _scores_sql() -> str:
    counts = " UNION ALL ".join(f"SELECT doc_id, 'lang' AS learner, '{o}' AS object, '{k}' AS value, least(len(string_split({c}, '{w}')) - 1, 20) / 10 + {step * i!r} AS score FROM parts" for o,
        c, step in (("1", "one", 0.011), ("2", "two", 0.013)) for i, (k, w) in enumerate(_WORDS.items()))
    sizes = " UNION ALL ".join(f"SELECT doc_id, 'size', '0', '{v}', CASE WHEN large = {str(v == 'large').lower()} THEN {s} ELSE 0.017 END FROM parts" for v, s in (("large", 0.31), ("small", 0.29)))
    return f"""parts AS (SELECT doc_id, substring(t, 1, len(t) // 2) AS one, substring(t, len(t) // 2 + 1) AS two, len(t) // 2 > 1000 AS large FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        s AS ({counts} UNION ALL {sizes})"""


_LANG = "SELECT *, CASE WHEN learner = 'lang' THEN exp(score) / sum(exp(score)) OVER (PARTITION BY doc_id, learner, object) ELSE score END AS z FROM s"
_KBEST = f"""WITH {_scores_sql()}, a AS (SELECT x.doc_id, x.value AS one, y.value AS two, z.value AS size, x.score + y.score + z.score AS total FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.learner = 'lang'
        AND x.object = '1' AND y.learner = 'lang' AND y.object = '2' JOIN s z ON z.doc_id = x.doc_id AND z.object = '0' WHERE (x.value IN ('en', 'es') OR y.value IN ('en', 'es')) = (z.value = 'large')),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(total, 9) DESC, one, two, size) AS rank FROM a QUALIFY rank <= {K})"""
QUERIES = {f.__name__: f for f in (constrained_inference, free_inference, constraint_satisfied, k_best_assignments, reranked_inference)}
SQL = {
    "constrained_inference": f"""WITH {_scores_sql()}, n AS ({_LANG}),
        a AS (SELECT x.doc_id, x.value AS v1, y.value AS v2, z.value AS v0, x.z AS z1, y.z AS z2, z.z AS z0 FROM n x JOIN n y ON x.doc_id = y.doc_id AND x.learner = 'lang' AND x.object = '1' AND y.object = '2'
            JOIN n z ON z.doc_id = x.doc_id AND z.object = '0' WHERE x.value = y.value AND (x.value NOT IN ('en', 'es') OR z.value = 'large')
            QUALIFY row_number() OVER (PARTITION BY x.doc_id ORDER BY x.z + y.z + z.z DESC, x.value, z.value) = 1)
        SELECT doc_id, 'lang' AS learner, '1' AS object, v1 AS value, round(z1, 6) AS score, true AS optimal FROM a UNION ALL SELECT doc_id, 'lang', '2', v2, round(z2, 6), true
            FROM a UNION ALL SELECT doc_id, 'size', '0', v0, round(z0, 6), true FROM a""",
    "free_inference": f"""WITH {_scores_sql()} SELECT doc_id, learner, object, value, round(1 / (1 + exp(-score)), 6) AS score, true AS optimal FROM s
        QUALIFY row_number() OVER (PARTITION BY doc_id, learner, object ORDER BY score DESC, value) = 1""",
    "constraint_satisfied": f"""WITH {_scores_sql()}, b AS (SELECT doc_id, learner || object AS k, value FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, learner, object ORDER BY score DESC, value) = 1),
        w AS (SELECT doc_id, max(value) FILTER (k = 'lang1') AS a, max(value) FILTER (k = 'lang2') AS b, max(value) FILTER (k = 'size0') AS z FROM b GROUP BY 1)
        SELECT doc_id, a = b AND (a NOT IN ('en', 'es') OR z = 'large') AND (b NOT IN ('en', 'es') OR z = 'large') AS holds FROM w""",
    "k_best_assignments": f"{_KBEST} SELECT doc_id, rank::INT AS rank, round(total, 6) AS total, one, two, size FROM r",
    "reranked_inference": f"""{_KBEST}, c AS (SELECT doc_id, rank, total, CASE WHEN one = two THEN 0.5 ELSE 0 END + CASE WHEN one = lang THEN 0.25 ELSE 0 END + CASE WHEN two = lang THEN 0.125 ELSE 0 END AS coherence
            FROM r JOIN documents USING (doc_id)), d AS (SELECT *, {ALPHA} * total + (1 - {ALPHA}) * coherence AS combined FROM c)
        SELECT doc_id, rank::INT AS rank, round(total, 6) AS total, round(coherence, 6)::DOUBLE AS coherence, round(combined, 6) AS combined FROM d
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(combined, 12) DESC, rank) = 1""",
}
