"""Features as rows of a struct, and the algebra over lists of them: conjunction, sets, order, products, domains.

A feature has a package, an identifier, a value (null for real features), a strength (1 for discrete ones), its place in
an array feature (`at` of `length`, null for scalars) and its place in the domain of allowed values (`place` of `total`,
-1 and 0 where the domain is open). All operators are column expressions inside a row; only products of two tables join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.lexing import counted, let
from corpusloom.sources.views import WORDS_SQL, all_words, table, unfolded

FEATURE = "struct<pkg:string,id:string,value:string,strength:double,at:int,length:int,place:int,total:int>"


def _fields(pkg: Column, id_: Column, value: Column, strength: Column, at: Column, length: Column, place: Column, total: Column) -> dict[str, Column]:
    names = ("pkg", "id", "value", "strength", "at", "length", "place", "total")
    return dict(zip(names, (pkg, id_, value, strength, at, length, place, total), strict=True))


def _feature(*parts: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in _fields(*parts).items()]).cast(FEATURE)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def place_of(value: Column, domain: Sequence[str]) -> Column:
    """The place of a value in its domain from 0, -1 where it isn't in it."""
    return F.array_position(F.array(*[F.lit(x) for x in domain]).cast("array<string>"), value) - F.lit(1)


def discrete_fields(name: str, value: Column, domain: Sequence[str] = (), pkg: str = "") -> dict[str, Column]:
    """The fields of one discrete feature; a value outside of a closed domain has place -1."""
    value = value.cast("string")
    place = place_of(value, domain).cast("int") if domain else F.lit(-1)
    return _fields(F.lit(pkg), F.lit(name), value, F.lit(1.0), _null("int"), _null("int"), place, F.lit(len(domain)))


def real_fields(name: str, value: Column, pkg: str = "", at: int | None = None, length: int | None = None) -> dict[str, Column]:
    """The fields of one real feature, or of that at a place of an array."""
    return _fields(F.lit(pkg), F.lit(name), _null("string"), value.cast("double"), F.lit(at).cast("int"), F.lit(length).cast("int"), F.lit(-1), F.lit(0))


def discrete(name: str, value: Column, domain: Sequence[str] = (), pkg: str = "") -> Column:
    """A list of one discrete feature; a value outside of a closed domain has place -1."""
    return F.array(_feature(*discrete_fields(name, value, domain, pkg).values()))


def real(name: str, value: Column, pkg: str = "") -> Column:
    """A list of one real feature."""
    return F.array(_feature(*real_fields(name, value, pkg).values()))


def discrete_array(name: str, values: Column, pkg: str = "") -> Column:
    """A feature for each value of an array, with its place."""
    return F.transform(values, lambda v, i: _feature(F.lit(pkg), F.lit(name), v.cast("string"), F.lit(1.0), i, F.size(values), F.lit(-1), F.lit(0)))


def real_array(name: str, values: Column, pkg: str = "") -> Column:
    return F.transform(values, lambda v, i: _feature(F.lit(pkg), F.lit(name), _null("string"), v.cast("double"), i, F.size(values), F.lit(-1), F.lit(0)))


def generated(name: str, senses: dict[str, Column | None], kind: str = "discrete", pkg: str = "") -> Column:
    """The features of a generator: for each sensed identifier its value, `true` (discrete) or 1 (real) where none is given;
    identifiers whose value is null are not sensed."""
    default = F.lit("true") if kind == "discrete" else F.lit(1.0)
    made = [(discrete if kind == "discrete" else real)(f"{name}:{x}", default if v is None else v, pkg=pkg)[0] for x, v in senses.items()]
    kept = [F.when(F.lit(True) if v is None else v.isNotNull(), f) for f, v in zip(made, senses.values(), strict=True)]
    return F.array_compact(F.array(*kept))


def sensed(name: str, features: Column, pkg: str = "") -> Column:
    """The features of another classifier under a generator's name; array features go on with a running place."""
    named = lambda f: F.concat(F.lit(f"{name}:"), F.when(f["pkg"] != pkg, F.concat(f["pkg"], F.lit(":"))).otherwise(""), f["id"])
    return F.transform(features, lambda f, i: _feature(F.lit(pkg), named(f), f["value"], f["strength"], F.when(f["at"].isNotNull(), i), F.when(f["at"].isNotNull(), F.size(features)), f["place"], f["total"]))


def _joined(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """One feature of two, which may be given by their fields: discrete ones join their values, a real one takes a discrete one's value into its name, real
    ones multiply; places in arrays and domains become those of the product."""
    left, right = a["value"].isNotNull(), b["value"].isNotNull()
    value = F.when(left & right, F.concat(a["value"], F.lit("&"), b["value"]))
    marked = lambda f, other: F.when(f["value"].isNotNull() & other["value"].isNull(), F.concat(f["id"], F.lit("_"), f["value"])).otherwise(f["id"])
    id_ = F.concat(marked(a, b), F.lit("&"), marked(b, a))
    at = F.when(a["at"].isNotNull() & b["at"].isNotNull(), a["at"] * b["length"] + b["at"]).otherwise(F.coalesce(a["at"], b["at"]))
    length = F.when(a["at"].isNotNull() & b["at"].isNotNull(), a["length"] * b["length"]).otherwise(F.coalesce(a["length"], b["length"]))
    closed = (a["place"] >= 0) & (b["place"] >= 0) & left & right
    place = F.when(closed, a["place"] * b["total"] + b["place"]).otherwise(-1)
    total = F.when(left & right, a["total"] * b["total"]).otherwise(0)
    return _feature(a["pkg"], id_, value, a["strength"] * b["strength"], at, length, place, total)


def conjunction(a: Column, b: Column, same: bool = False) -> Column:
    """All pairs of two feature lists; with `same`, where both are one classifier's, equal features are not paired."""
    pair = lambda x: F.transform(b, lambda y: F.when(~x.eqNullSafe(y), _joined(x, y)) if same else _joined(x, y))
    made = F.flatten(F.transform(a, pair))
    return F.array_compact(made) if same else made


def fixed_conjunction(a: Sequence[dict[str, Column]], b: Sequence[dict[str, Column]], same: bool = False) -> list[Column]:
    """conjunction() of lists whose features are known one by one, given by their fields: columns that Spark compiles, where lambdas
    are interpreted for each row. With `same`, a pair of equal features is null."""
    equal = lambda x, y: reduce(lambda p, q: p & q, [x[n].eqNullSafe(y[n]) for n in x])
    return [F.when(~equal(x, y), _joined(x, y)) if same else _joined(x, y) for x in a for y in b]


def union(*lists: Column) -> Column:
    """All features of the lists, equal ones as often as they come."""
    return F.concat(*lists)


def key_of(f: Column) -> Column:
    """What a weight is stored under: package, identifier, the place in an array, and the value of a discrete feature."""
    return F.concat_ws("\x1f", f["pkg"], f["id"], F.coalesce(f["at"].cast("string"), F.lit("")), F.coalesce(f["value"], F.lit("")))


def keys_of(features: Column) -> Column:
    return F.transform(features, key_of)


def in_order(features: Column) -> Column:
    """Discrete features before real ones, arrays before scalars, then by package, identifier, place and value."""
    kind = lambda f: F.when(f["value"].isNull(), 2).otherwise(0) + F.when(f["at"].isNull(), 1).otherwise(0)
    order = F.transform(features, lambda f: F.struct(kind(f).alias("k"), f["pkg"].alias("p"), f["id"].alias("i"), F.coalesce(f["at"], F.lit(-1)).alias("a"), F.coalesce(f["value"],
        F.lit("")).alias("v"), f["strength"].alias("s"), f.alias("f")))
    return F.transform(F.array_sort(order), lambda x: x["f"])


def equal_bags(a: Column, b: Column) -> Column:
    """Whether two lists hold the same features, each as often."""
    return in_order(a) == in_order(b)


def common(a: Column, b: Column) -> Column:
    """Keys in both lists."""
    return F.array_intersect(keys_of(a), keys_of(b))


def rest(a: Column, b: Column) -> Column:
    """Keys of a that b lacks."""
    return F.array_except(keys_of(a), keys_of(b))


def holds_all(a: Column, b: Column) -> Column:
    """Whether a has every key of b."""
    return F.size(rest(b, a)) == 0


def dot(a: Column, b: Column) -> Column:
    """Sum of products of the strengths of features with equal keys; repeated ones count each time."""
    def summed(features: Column) -> Column:
        return F.aggregate(features, F.create_map().cast("map<string,double>"), lambda m, f: F.map_concat(F.map_filter(m, lambda k, v: k != key_of(f)), F.create_map(key_of(f),
            F.coalesce(F.element_at(m, key_of(f)), F.lit(0.0)) + f["strength"])))

    return F.aggregate(F.map_values(F.map_zip_with(summed(a), summed(b), lambda k, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)


def table_dot(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """key, dot of long tables (key, feature, strength): a join by feature inside a key, sums of products, 0 where none meets."""
    one = a.groupBy(key, "feature").agg(F.sum("strength").alias("x"))
    other = b.groupBy(key, "feature").agg(F.sum("strength").alias("y"))
    met = one.join(other, [key, "feature"]).groupBy(key).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return a.select(key).distinct().join(met, key, "left").select(key, F.coalesce("dot", F.lit(0.0)).alias("dot"))


def bag_dot(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """key, dot of tables (key, bag): as table_dot() of their elements (form, times), 0 where none meets.

    Whole bags are shuffled, by the key. Rows of one key multiply pair by pair, which adds up to the product of their sums; a key's
    pair of bags is merged in its row: a form that both have stands twice in the sorted list of their forms.
    """
    side = lambda df, n: df.select(key, F.transform("bag", lambda x: F.struct(x["form"].alias("form"), F.lit(n).alias("side"), x["times"].alias("times"))).alias(f"_{n}"))
    met = side(a, 1).join(side(b, 2).hint("merge"), key, "left")  # bags are larger than their file and never sent through the driver

    def product(s: Column) -> Column:
        pair = lambda x, y: F.when((x["form"] == y["form"]) & (x["side"] != y["side"]), x["times"].cast("double") * y["times"]).otherwise(0.0)
        return F.aggregate(F.transform(F.slice(s, 2, F.size(s)), lambda y, i: pair(F.get(s, i), y)), F.lit(0.0), lambda t, x: t + x)

    dot = let(F.sort_array(F.concat("_1", F.coalesce("_2", F.slice("_1", 1, 0)))), product)
    return met.select(key, dot.alias("dot")).groupBy(key).agg(F.sum("dot").alias("dot"))


def labels_of(df: DataFrame) -> DataFrame:
    """A stored vector's labels as its value (idx, values)."""
    return df.select("idx", F.col("labels").alias("values"))


def features_of(df: DataFrame) -> DataFrame:
    """A stored vector's features as its value (idx, values)."""
    return df.select("idx", F.col("features").alias("values"))


def muxed(parts: dict[str, Column], select: Column) -> Column:
    """The features of the part that select names; of none for other names. parts are a composite's children."""
    out = F.array().cast(f"array<{FEATURE}>")
    for name, features in parts.items():
        out = F.when(select == name, features).otherwise(out)
    return out


#: Kinds of classifiers: what their features hold, and whether there is one, an array or any number of them.
CONTENTS, SHAPES = ("discrete", "real", "mixed"), ("", "[]", "%")


def kind_of(content: str, shape: str) -> str:
    """A kind's name; mixed features are always of any number."""
    return f"{content}%" if content == "mixed" else content + shape


def parts_of(kind: str) -> tuple[str, str]:
    shape = next(x for x in reversed(SHAPES) if kind.endswith(x))
    content = kind[: len(kind) - len(shape)]
    if content not in CONTENTS or (content == "mixed" and shape != "%"):
        raise TypeError(f"no such kind: {kind}")
    return content, shape


def conjunction_kind(a: str, b: str) -> str:
    """The kind of a conjunction: discrete features stay so, a real one makes it real, a mixed one mixed; the wider shape."""
    (c, s), (d, t) = parts_of(a), parts_of(b)
    content = "mixed" if "mixed" in (c, d) else "real" if "real" in (c, d) else "discrete"
    return kind_of(content, max(s, t, key=SHAPES.index))


def composite_kind(*kinds: str) -> str:
    """The least kind that holds the features of all parts."""
    found = [parts_of(x) for x in kinds]
    contents = {c for c, _ in found}
    shape = "%" if any(s == "%" for _, s in found) else "[]" if len(found) > 1 else found[0][1]
    return kind_of(contents.pop(), shape) if len(contents) == 1 else "mixed%"


FLAGS, STATES = ("A", "N", "R"), ("F", "O")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    flag, state = discrete("flag", F.col("l_returnflag"), FLAGS), discrete("state", F.col("l_linestatus"), STATES)
    amount, tax = real("amount", F.col("l_quantity")), real("tax", F.col("l_tax"))
    both = real_array("both", F.array("l_discount", "l_tax"))
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in (("flag", flag), ("state", state), ("amount", amount), ("tax", tax), ("both", both))])


def _long(df: DataFrame, features: Column) -> DataFrame:
    rows = unfolded(df.select("l_orderkey", "l_linenumber", features.alias("f")), "f")
    return rows.select("l_orderkey", "l_linenumber", "f.id", "f.value", F.round("f.strength", 6).alias("strength"), F.col("f.at").alias("array_place"), F.col("f.length").alias("array_length"), "f.place", "f.total")


def mixed_conjunctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of discrete, real and array features of order lines, one row for each made feature."""
    flag, state = [discrete_fields("flag", F.col("l_returnflag"), FLAGS)], [discrete_fields("state", F.col("l_linestatus"), STATES)]
    amount, tax = [real_fields("amount", F.col("l_quantity"))], [real_fields("tax", F.col("l_tax"))]
    both = [real_fields("both", F.col(x), at=i, length=2) for i, x in enumerate(("l_discount", "l_tax"))]
    pairs = ((flag, state), (flag, amount), (amount, tax), (both, amount))
    made = [f for a, b in pairs for f in fixed_conjunction(a, b)] + fixed_conjunction(both, both, same=True)
    return _long(table(spark, sf_dir, "lineitem"), F.array(*made))


def generator_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generators with and without values, and another classifier's features under a generator's name."""
    rows = _lines(spark, sf_dir)
    heavy = F.when(rows.amount[0]["strength"] > 40, F.lit("yes"))
    made = union(generated("g", {"seen": None, "heavy": heavy}), generated("r", {"one": None}, "real"), sensed("s", F.col("both")), sensed("q", F.col("flag")))
    return _long(rows, made)


def feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, ids: the features that a line has, in order; which it has goes by its number and amounts."""
    has = {"tax": F.col("l_linenumber") % 3 == 0, "both": F.col("strength") > 25, "state": F.col("l_linenumber") % 2 == 0, "amount": F.col("strength") % 2 == 0, "flag": F.lit(True)}
    made = in_order(union(*[F.when(test, F.col(x)).otherwise(F.slice(x, 1, 0)) for x, test in has.items()]))
    return _lines(spark, sf_dir).withColumn("strength", F.get("amount", F.lit(0))["strength"]).select("l_orderkey", "l_linenumber", F.array_join(F.transform(made, lambda f: f["id"]), ",").alias("ids"))


def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set algebra of the word features of conversation turns and of the turn before; same_bag: whether a turn stays the same bag, in
    any order, when its last word gives way to its first."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.filter(F.split("text", " "), lambda w: w != "")).alias("w"))
    rows = rows.withColumn("p", F.coalesce(F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>")))
    a, b = F.transform("w", lambda x: discrete("w", x)[0]), F.transform("p", lambda x: discrete("w", x)[0])
    return rows.select("conv_id", "turn", F.size(common(a, b)).alias("n_common"), F.size(rest(a, b)).alias("n_rest"), holds_all(a, b).alias("holds_all"), equal_bags(a,
        F.reverse(F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(1), F.when(F.col("turn") % 2 == 0, F.least(F.size(a), F.lit(1))).otherwise(0)),
            F.when(F.col("turn") % 2 == 1, F.slice(a, F.greatest(F.size(a), F.lit(1)), F.lit(1))).otherwise(F.slice(a, 1, 0))))).alias("same_bag"), F.size(union(a, b)).alias("n_union"))


def feature_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dot: of each document's word counts and those of the document with the next id, by feature."""
    texts = table(spark, sf_dir, "documents").select("doc_id", counted(all_words(F.col("text"))).alias("bag")).where(F.size("bag") > 0)
    return bag_dot(texts, texts.withColumn("doc_id", F.col("doc_id") - 1), "doc_id")


def muxed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount of lines with flag A, the tax of those with flag R, as features."""
    rows = _lines(spark, sf_dir)
    return _long(rows, muxed({"A": F.col("amount"), "R": F.col("tax")}, rows.flag[0]["value"]))


_F = "SELECT l_orderkey, l_linenumber, {id} AS id, {value} AS value, round({strength}, 6) AS strength, {at} AS array_place, {length} AS array_length, {place} AS place, {total} AS total FROM lineitem"


def _f(id_: str, value: str = "NULL", strength: str = "1.0", at: str = "NULL::INT", length: str = "NULL::INT", place: str = "-1", total: str = "0", where: str = "") -> str:
    return _F.format(id=id_, value=value, strength=strength, at=at, length=length, place=place, total=total) + where


_PAIRS = [(i, j) for i in (0, 1) for j in (0, 1)]
_BOTH = ("l_discount", "l_tax")
_DIFFER = {(0, 0): "false", (1, 1): "false", (0, 1): "true", (1, 0): "true"}
QUERIES = {f.__name__: f for f in (mixed_conjunctions, generator_defaults, feature_order, feature_sets, feature_dot, muxed_features)}
SQL = {
    "mixed_conjunctions": " UNION ALL ".join([
        _f("'flag&state'", "l_returnflag || '&' || l_linestatus", place="(list_position(['A', 'N', 'R'], l_returnflag) - 1) * 2 + list_position(['F', 'O'], l_linestatus) - 1", total="6"),
        _f("'flag_' || l_returnflag || '&amount'", strength="l_quantity"),
        _f("'amount&tax'", strength="l_quantity * l_tax"),
        *[_f("'both&amount'", strength=f"{_BOTH[i]} * l_quantity", at=str(i), length="2") for i in (0, 1)],
        *[_f("'both&both'", strength=f"{_BOTH[i]} * {_BOTH[j]}", at=str(2 * i + j), length="4", where=f" WHERE {_DIFFER[i, j]}") for i, j in _PAIRS],
    ]),
    "generator_defaults": " UNION ALL ".join([
        _f("'g:seen'", "'true'"), _f("'g:heavy'", "'yes'", where=" WHERE l_quantity > 40"), _f("'r:one'"),
        *[_f("'s:both'", strength=_BOTH[i], at=str(i), length="2") for i in (0, 1)],
        _f("'q:flag'", "l_returnflag", place="list_position(['A', 'N', 'R'], l_returnflag) - 1", total="3"),
    ]),
    "feature_order": """SELECT l_orderkey, l_linenumber, 'flag' || CASE WHEN l_linenumber % 2 = 0 THEN ',state' ELSE '' END || CASE WHEN l_quantity > 25 THEN ',both,both' ELSE '' END ||
        CASE WHEN l_quantity % 2 = 0 THEN ',amount' ELSE '' END || CASE WHEN l_linenumber % 3 = 0 THEN ',tax' ELSE '' END AS ids FROM lineitem""",
    "feature_sets": """WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(text, ' '), lambda w: w <> '')) AS w FROM conversations),
        u AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY conv_id ORDER BY turn), []) AS p FROM t)
        SELECT conv_id, turn, len(list_intersect(w, p)) AS n_common, len(list_filter(w, lambda x: NOT list_contains(p, x))) AS n_rest, len(list_filter(p,
            lambda x: NOT list_contains(w, x))) = 0 AS holds_all, turn % 2 = 1 OR len(w) <= 1 AS same_bag, len(w) + len(p) AS n_union FROM u""",
    "feature_dot": f"""WITH {WORDS_SQL}, c AS (SELECT doc_id, form, count(*) AS n FROM words GROUP BY ALL), d AS (SELECT a.doc_id, sum(a.n * b.n) AS dot FROM c a
            JOIN c b ON b.doc_id = a.doc_id + 1 AND a.form = b.form GROUP BY 1)
        SELECT doc_id, coalesce(dot, 0)::DOUBLE AS dot FROM (SELECT DISTINCT doc_id FROM c) LEFT JOIN d USING (doc_id)""",
    "muxed_features": f"""{_f("'amount'", strength="l_quantity", where=" WHERE l_returnflag = 'A'")} UNION ALL {_f("'tax'", strength="l_tax", where=" WHERE l_returnflag = 'R'")}""",
}
