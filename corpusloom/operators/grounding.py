"""Quantified constraints grounded by joins, and solved part by part.

A rule over a collection is a grouping of rows: every group is a clause that needs so many of its literals. All clauses of all
heads are one table (head, clause, literal, sign, need). Literals that share a clause are connected; the connected parts of
a head share no clause, so each is a 0-1 program of its own, and a large head is solved by as many tasks as it has parts.

Clauses are many times as many as their rows. Where heads are small, as documents are, rules are read off the rows of their literals instead: a head is dealt
once, before its literals are made, and its parts are found and solved where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from corpusloom.operators.coref import pair_score
from corpusloom.operators.inference import NotOptimal, Program
from corpusloom.sources.shared import kept
from corpusloom.sources.views import MENTIONS_SQL, mentions

_CLAUSE = ("head", "rule", "clause", "literal", "sign", "need")


def at_least(rule: str, rows: DataFrame, by: Sequence[str], m: int = 1) -> DataFrame:
    """Of the literals of each group of rows (head, literal, by), `m` or more hold. exists is the case of 1."""
    return _clauses(rule, rows, by, True, F.lit(m))


def at_most(rule: str, rows: DataFrame, by: Sequence[str], m: int = 1) -> DataFrame:
    """At most `m` hold: of their opposites, all but m or more do. Groups of m or fewer rows are no clause."""
    made = _clauses(rule, rows, by, False, F.col("_n") - m, counted=True)
    return made.where("need > 0")


def for_all(rule: str, rows: DataFrame, holds: bool = True) -> DataFrame:
    """Every literal of rows (head, literal) holds, or none does: a clause for each."""
    return _clauses(rule, rows, ["literal"], holds, F.lit(1))


def implies(rule: str, rows: DataFrame) -> DataFrame:
    """If the literal `given` of a row (head, given, literal) holds, so does the row's literal."""
    pair = F.array(F.struct(F.col("given").alias("literal"), F.lit(False).alias("sign")), F.struct("literal", F.lit(True).alias("sign")))
    each = rows.distinct().select("head", F.concat_ws("=>", "given", "literal").alias("clause"), F.explode(pair).alias("x"))
    return each.select("head", F.lit(rule).alias("rule"), "clause", "x.literal", "x.sign", F.lit(1).cast("long").alias("need"))


def _clauses(rule: str, rows: DataFrame, by: Sequence[str], sign: bool, need: Column, counted: bool = False) -> DataFrame:
    """counted: need reads the size of the clause, `_n`."""
    each = rows.select("head", "literal", F.concat_ws("|", *[F.col(c).cast("string") for c in by]).alias("clause")).distinct()
    if counted:
        each = each.join(each.groupBy("head", "clause").agg(F.count(F.lit(1)).alias("_n")).hint("merge"), ["head", "clause"])
    return each.select("head", F.lit(rule).alias("rule"), "clause", "literal", F.lit(sign).alias("sign"), need.cast("long").alias("need"))


def ground(*rules: DataFrame) -> DataFrame:
    """The clause table of all rules."""
    out = rules[0].select(*_CLAUSE)
    for more in rules[1:]:
        out = out.unionByName(more.select(*_CLAUSE))
    return out


def parts(clauses: DataFrame) -> DataFrame:
    """head, literal, part: the smallest literal connected with each literal of the clause table.

    Literals are read once for their least clause, which is linked with their other clauses; what is iterated is this table of clauses alone. Each
    turn, a clause takes the least group of its neighbours, and then the group of its group, so that
    the turns grow with the logarithm of the longest chain. Least values are made in tasks before they are sent, so a large clause is
    no hot group. Turns are kept in the shared folder. Kept files are far smaller than their rows, so no join sends them through the driver.
    """
    links = kept(clauses.select("head", F.concat_ws(":", "rule", "clause").alias("clause"), "literal"), "links")
    first = links.groupBy("head", "literal").agg(F.min("clause").alias("node"), F.max("clause").alias("last"), F.count(F.lit(1)).alias("n"))
    first = kept(first, "first")
    few = first.where("n > 1").select("head", F.col("node").alias("a"), F.col("last").alias("b"))
    more = links.join(first.where("n > 2").select("head", "literal", F.col("node").alias("a")).hint("merge"), ["head", "literal"]).select("head", "a", F.col("clause").alias("b"))
    edges = few.unionByName(more).where("a <> b").distinct()
    edges = kept(edges.unionByName(edges.select("head", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = kept(edges.groupBy("head", "a").agg(F.least("a", F.min("b")).alias("part")), "parts")
    while True:
        near = edges.join(now.select("head", F.col("a").alias("b"), "part").hint("merge"), ["head", "b"]).select("head", "a", "part").unionByName(now.select("head", "a", "part"))
        near = near.groupBy("head", "a").agg(F.min("part").alias("part"))
        jump = now.select("head", F.col("a").alias("part"), F.col("part").alias("_further"))
        last, now = now, kept(near.join(jump.hint("merge"), ["head", "part"], "left").select("head", "a", F.coalesce("_further", "part").alias("part")), "parts")
        if now.join(last.withColumnRenamed("part", "_before").hint("merge"), ["head", "a"]).where("part <> _before").isEmpty():
            break
    held = first.join(now.select("head", F.col("a").alias("node"), "part").hint("merge"), ["head", "node"], "left").select("head", "literal", F.coalesce("part", "node").alias("group"))
    least = held.groupBy("head", "group").agg(F.min("literal").alias("part"))
    return kept(held.join(least.hint("merge"), ["head", "group"]).select("head", "literal", "part"), "parts")


def solve_parts(worth: DataFrame, clauses: DataFrame) -> DataFrame:
    """head, part, literal, value, optimal of literals (head, literal, worth): those that together are worth most under the clauses.

    A literal without a clause is a part of its own. Literals of clauses that have no worth count as 0. Of a part without any
    solution, values are null. A task holds one part after another.
    """
    found = parts(clauses)
    scored = worth.join(found.hint("merge"), ["head", "literal"], "full_outer").select("head", F.coalesce("part", "literal").alias("part"), F.lit(None).cast("string").alias("clause"), "literal", F.lit(True).alias("sign"),
        F.lit(0).cast("long").alias("need"), F.coalesce("worth", F.lit(0.0)).cast("double").alias("worth"))
    ruled = clauses.join(found.hint("merge"), ["head", "literal"]).select("head", "part", F.concat_ws(":", "rule", "clause").alias("clause"), "literal", "sign", "need", F.lit(0.0).alias("worth"))
    n = int(worth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scored.unionByName(ruled).repartition(n, "head", "part").sortWithinPartitions("head", "part", F.col("clause").asc_nulls_first(), "literal")
    kind = dict(worth.dtypes)["head"]

    def solved(held: list[dict]) -> list[tuple]:
        program, places, own = Program(), {}, {}
        for r in held:
            if r["clause"] is None:
                places[r["literal"]] = program.add_boolean(r["worth"])
            else:
                own.setdefault(r["clause"], []).append(r)
        for terms in own.values():
            program.add_row({places[r["literal"]]: 1.0 if r["sign"] else -1.0 for r in terms}, ">=", terms[0]["need"] - sum(not r["sign"] for r in terms))
        program.solve()
        try:
            return [(held[0]["head"], held[0]["part"], literal, program.value(at), True) for literal, at in places.items()]
        except NotOptimal:
            return [(held[0]["head"], held[0]["part"], literal, None, False) for literal in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def sent(made: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [()] * 5
            types = (of, pa.string(), pa.string(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["head", "part", "literal", "value", "optimal"])

        for batch in batches:
            of, made = batch.schema.field(0).type, []
            for r in batch.to_pylist():
                if held and (held[-1]["head"], held[-1]["part"]) != (r["head"], r["part"]):
                    made += solved(held)
                    held = []
                held.append(r)
            yield sent(made)
        if held:
            yield sent(solved(held))

    return rows.mapInArrow(run, f"head {kind}, part string, literal string, value boolean, optimal boolean")


# ------------------------------------------------------------------------------------------- heads in one place


@dataclass(frozen=True)
class Rule:
    """A rule over rows (head, literal, ...): of those of which `where` is true, in groups of equal `by`, at `least` or at `most` so many
    hold; with neither, each of them holds or, by `holds`, doesn't."""

    name: str
    by: tuple[str, ...] = ("literal",)
    where: str = "true"
    least: int | None = None
    most: int | None = None
    holds: bool = True

    def clauses(self, rows: DataFrame) -> DataFrame:
        own = rows.where(self.where)
        if self.least is not None:
            return at_least(self.name, own, self.by, self.least)
        return for_all(self.name, own, self.holds) if self.most is None else at_most(self.name, own, self.by, self.most)

    def key(self) -> Column:
        """The clause of a row; null where it has none."""
        return F.when(F.expr(self.where), F.concat_ws("|", *[F.col(c).cast("string") for c in self.by]))


def _linked(literals: list[str], keys: list[list], rules: Sequence[Rule]) -> tuple[dict[str, str], dict[str, list]]:
    """The part of each literal of a head, and the clauses (rule, literals) of each part. A part is named by its smallest literal."""
    above = {x: x for x in literals}

    def root(x: str) -> str:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    clauses = []
    for rule, own in zip(rules, keys, strict=True):
        groups: dict[str, dict] = {}
        for x, k in zip(literals, own, strict=True):
            if k is not None:
                groups.setdefault(k, {})[x] = None
        clauses += [(rule, list(g)) for g in groups.values() if rule.most is None or len(g) > rule.most]
    for _, own in clauses:
        a = root(own[0])
        for x in own[1:]:
            if (b := root(x)) != a:
                a, b = min(a, b), max(a, b)
                above[b] = a
    of = {x: root(x) for x in above}
    ruled: dict[str, list] = {}
    for c in clauses:
        ruled.setdefault(of[c[1][0]], []).append(c)
    return of, ruled


def _best(worth: dict[str, float], clauses: list[tuple[Rule, list[str]]]) -> set[str] | None:
    """The literals of a part that hold; None if no values meet its clauses. Literals of which one at most holds are a choice of one or none."""
    program, at = Program(), {}
    for rule, own in clauses:
        if rule.most == 1 and not any(x in at for x in own):
            at |= zip(own, program.add_discrete([0.0, *[worth[x] for x in own]])[1:], strict=True)
    for x, w in worth.items():
        if x not in at:
            at[x] = program.add_boolean(w)
    for rule, own in clauses:
        each = {at[x]: 1.0 for x in own}
        if rule.least is not None:
            program.add_row(each, ">=", rule.least)
        elif rule.most is None:
            program.add_row(each, "=", float(rule.holds))
        elif not any(set(each) <= set(g) for g in program.groups):
            program.add_row(each, "<=", rule.most)
    return {x for x, v in at.items() if program.value(v)} if program.solve() else None


def _solved(literals: list[str], worth: list[float | None], keys: list[list], rules: Sequence[Rule]) -> list[list]:
    of, ruled = _linked(literals, keys, rules)
    worths: dict[str, dict[str, float]] = {}
    row: dict[str, int] = {}  # of rows of the same literal the first that is worth most
    for i, (x, w) in enumerate(zip(literals, worth, strict=True)):
        own, w = worths.setdefault(of[x], {}), 0.0 if w is None else w
        if x not in own or w > own[x]:
            own[x], row[x] = w, i
    held = {p: _best(own, ruled.get(p, [])) for p, own in worths.items()}
    return [[of[x] for x in literals], [None if (h := held[of[x]]) is None else row[x] == i and x in h for i, x in enumerate(literals)], [held[of[x]] is not None for x in literals]]


def _parted(literals: list[str], worth: list[float | None], keys: list[list], rules: Sequence[Rule]) -> list[list]:
    of, ruled = _linked(literals, keys, rules)
    first = {x: i for i, x in reversed(list(enumerate(literals)))}
    return [[of[x] if of[x] in ruled and first[x] == i else None for i, x in enumerate(literals)]]


def _in_heads(rows: DataFrame, rules: Sequence[Rule], made: dict, answer: Callable[..., list[list]]) -> DataFrame:
    """rows, whose heads each lie together in one task, with the columns `made` of a head's literals, worths and clauses; a task holds one head and a batch."""
    rules, n = list(rules), len(rows.columns)
    keyed = rows.select("*", *[r.key().alias(f"_rule{i}") for i, r in enumerate(rules)])
    schema = StructType([*rows.schema.fields, *[StructField(c, t) for c, t in made.items()]])
    places = [rows.columns.index(c) for c in ("head", "literal", "worth")]
    types = [to_arrow_type(t) for t in made.values()]

    def answered(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of a batch of whole heads."""
        literals, worth, *keys = [batch.column(i).to_pylist() for i in (*places[1:], *range(n, n + len(rules)))]
        out, begin = [[] for _ in types], 0
        for end in pc.run_end_encode(batch.column(places[0])).run_ends.to_pylist():
            for c, own in zip(out, answer(literals[begin:end], worth[begin:end], [k[begin:end] for k in keys], rules), strict=True):
                c += own
            begin = end
        columns = [*batch.columns[:n], *[pa.array(c, t) for c, t in zip(out, types, strict=True)]]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last head so far
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pc.run_end_encode(batch.column(places[0])).run_ends
            last = ends[-2].as_py() if len(ends) > 1 else 0
            if held and (last or held[-1].column(places[0])[-1] != batch.column(places[0])[0]):
                yield answered(pa.concat_batches([*held, batch.slice(0, last)]))
                held, batch = [], batch.slice(last)
            elif last:
                yield answered(batch.slice(0, last))
                batch = batch.slice(last)
            held.append(batch)
        if held:
            yield answered(pa.concat_batches(held))

    return keyed.mapInArrow(run, schema)


def solve_heads(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows (head, literal, worth, ...) with part, value and optimal, as solve_parts has them; rows of a head lie together in one task. Of rows of the same
    literal, the one that is worth most has its value and others are false."""
    return _in_heads(rows, rules, {"part": StringType(), "value": BooleanType(), "optimal": BooleanType()}, _solved)


def part_heads(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows with their literal's part; null for literals without a clause, which parts leaves out, and for repeated ones."""
    return _in_heads(rows, rules, {"part": StringType()}, _parted)


# ------------------------------------------------------------------------------------------- the rules of links


def near_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """head, literal, sent, idx, prev, mtype, prev_type, back, worth: links of mentions to earlier ones of their own sentence and the one before;
    `back` for the latter. Documents are dealt once, by a hash of the name; each mention has the few of two sentences beside it, and a document's links lie together."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = mentions(spark, sf_dir).where("doc IS NOT NULL").select("doc", "sent", "idx", "mtype", "v").repartition(n, "doc")
    near = F.collect_list(F.struct("sent", "idx", "mtype", "v")).over(Window.partitionBy("doc").orderBy("sent").rangeBetween(-1, 0))
    made = rows.withColumn("near", near).withColumn("p", F.explode("near")).where("p.idx < idx")
    literal = F.concat_ws(">", F.lpad(F.col("idx").cast("string"), 6, "0"), F.lpad(F.col("p.idx").cast("string"), 6, "0"))
    return made.select(F.col("doc").alias("head"), literal.alias("literal"), "sent", "idx", F.col("p.idx").alias("prev"), "mtype", F.col("p.mtype").alias("prev_type"),
        (F.col("p.sent") < F.col("sent")).alias("back"), (F.round(pair_score(F.col("v"), F.col("p.v")), 4) - 5).alias("worth"))


#: Each mention links to one at most; an `error` mention links; no other mention links to an `error`; of the mentions of a sentence, one at least links to the sentence before.
LINK_RULES = (
    Rule("best", ("idx",), most=1), Rule("force", ("idx",), "mtype = 'error'", least=1),
    Rule("no_error", where="mtype <> 'error' AND prev_type = 'error'", holds=False), Rule("back", ("sent",), "back", least=1),
)


def link_rules(links: DataFrame) -> DataFrame:
    """The clause table of LINK_RULES."""
    return ground(*[r.clauses(links) for r in LINK_RULES])


def ground_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, rule, clauses, literals: how many clauses a document has by each rule, and literals in them."""
    found = link_rules(near_links(spark, sf_dir)).groupBy("head", "rule", "clause").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy(F.col("head").alias("doc"), "rule").agg(F.count(F.lit(1)).alias("clauses"), F.sum("n").alias("literals"))


def ground_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, parts, smallest, largest: connected parts of a document's program, and the fewest and most literals of one."""
    found = part_heads(near_links(spark, sf_dir), LINK_RULES).where("part IS NOT NULL")
    sizes = found.groupBy("head", "part").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(F.col("head").alias("doc")).agg(F.count(F.lit(1)).alias("parts"), F.min("n").alias("smallest"), F.max("n").alias("largest"))


def grounded_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, sent, total, optimal: what the best links of a sentence's mentions are worth under the rules; null where none satisfy them."""
    found = solve_heads(near_links(spark, sf_dir), LINK_RULES)
    total = F.sum(F.when(F.col("value"), F.col("worth")).otherwise(0.0))
    made = found.groupBy(F.col("head").alias("doc"), "sent").agg(total.alias("t"), F.bool_and("optimal").alias("optimal"))
    return made.select("doc", "sent", F.when(F.col("optimal"), F.round("t", 4) + F.lit(0.0)).alias("total"), "optimal")


_LINKS = f"""WITH {MENTIONS_SQL}, links AS (SELECT a.doc, a.sent, a.idx, b.idx AS prev, a.mtype, b.mtype AS prev_type, b.sent < a.sent AS back, round(10.0 - abs(a.v - b.v), 4) - 5 AS worth
    FROM mentions a JOIN mentions b ON a.doc = b.doc AND b.idx < a.idx AND b.sent >= a.sent - 1)"""
QUERIES = {f.__name__: f for f in (ground_clauses, ground_parts, grounded_inference)}
SQL = {
    "ground_clauses": f"""{_LINKS}, c AS (SELECT doc, 'best' AS rule, idx AS k, count(*) AS n FROM links GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT doc, 'force', idx, count(*) FROM links WHERE mtype = 'error' GROUP BY ALL
        UNION ALL SELECT doc, 'no_error', idx * 1000 + prev, 1 FROM links WHERE mtype <> 'error' AND prev_type = 'error' UNION ALL SELECT doc, 'back', sent, count(*) FROM links WHERE back GROUP BY ALL)
        SELECT doc, rule, count(*) AS clauses, sum(n)::BIGINT AS literals FROM c GROUP BY ALL""",
    # In the first sentence each mention is a part of its own, later ones hang together by the rule on the sentence before.
    "ground_parts": f"""{_LINKS}, ruled AS (SELECT *, count(*) OVER (PARTITION BY doc, idx) > 1 OR mtype = 'error' OR prev_type = 'error' OR back AS inside, bool_or(back) OVER (PARTITION BY doc, sent) AS whole,
            bool_or(back) OVER (PARTITION BY doc, idx) AS reaches FROM links),
        p AS (SELECT doc, CASE WHEN whole AND reaches THEN 's' || sent ELSE 'i' || idx END AS part, count(*) AS n FROM ruled WHERE inside GROUP BY ALL)
        SELECT doc, count(*) AS parts, min(n) AS smallest, max(n) AS largest FROM p GROUP BY 1""",
    "grounded_inference": f"""{_LINKS}, allowed AS (SELECT *, NOT (mtype <> 'error' AND prev_type = 'error') AS ok FROM links),
        each AS (SELECT doc, sent, idx, CASE WHEN mtype = 'error' THEN max(worth) FILTER (ok) ELSE greatest(0, coalesce(max(worth) FILTER (ok), 0)) END AS base, max(worth) FILTER (ok AND back) AS prior, bool_or(back) AS back
            FROM allowed GROUP BY doc, sent, idx, mtype),
        s AS (SELECT doc, sent, sum(base) AS base, max(prior - base) AS loss, bool_or(back) AS ruled FROM each GROUP BY ALL)
        SELECT doc, sent, CASE WHEN NOT ruled THEN round(base, 4) + 0.0 WHEN loss IS NOT NULL THEN round(base + loss, 4) + 0.0 END AS total, NOT ruled OR loss IS NOT NULL AS optimal FROM s""",
}
