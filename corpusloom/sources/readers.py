"""File sources and sinks: lines, columns, bracketed tags, pair scores, mention annotations, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.shared import numbered


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, value of text files, which may be cut into splits: a line's number is its place in its split and the
    number of lines in the splits before it. A final line break adds no line."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_serial"), F.regexp_replace("value", "\r$", "").alias("value"))
    inside = Window.partitionBy("path", "_block").orderBy("_serial")
    counts = rows.groupBy(F.col("path").alias("_path"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    counts = counts.select("_path", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(counts, (F.col("path") == F.col("_path")) & (F.col("_block") == F.col("_b"))).select("path", (F.col("_before") + F.col("_row")).alias("line"), "value")


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """path, line, fields: white-space separated fields; an empty line has none."""
    return lines(spark, path).select("path", "line", F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("fields"))


def read_pos_sentences(spark: SparkSession, path: str) -> DataFrame:
    """path, sent, words (tag, form, start, end) of lines like `(DT the) (NN cat)`; start and end (inclusive) are places in
    the sentence's forms joined by spaces."""
    part = lambda i: F.regexp_extract_all("value", F.lit(r"\((\S+) (\S+)\)"), F.lit(i))
    rows = lines(spark, path).select("path", F.col("line").alias("sent"), part(1).alias("tags"), part(2).alias("forms"))
    starts = F.transform("forms", lambda w, i: F.aggregate(F.slice("forms", 1, i), F.lit(0), lambda n, x: n + F.length(x) + 1))
    made = F.transform("forms", lambda w, i: F.struct(F.get("tags", i).alias("tag"), w.alias("form"), F.get("starts", i).alias("start"), (F.get("starts", i) + F.length(w) - 1).alias("end")))
    return rows.withColumn("starts", starts).select("path", "sent", made.alias("words"))


def children(df: DataFrame, column: str) -> DataFrame:
    """The members of an array column as rows, with their place `pos`; other columns stay."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(column).alias("pos", "_child")).select(*kept, "pos", "_child.*")


def read_pos_brackets(spark: SparkSession, path: str) -> DataFrame:
    """path, sent, pos, tag, form, start, end: the words of read_pos_sentences as rows."""
    return children(read_pos_sentences(spark, path), "words")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a list file, without blank lines and `#` comments."""
    return spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.col("value").alias("path"))


def read_pair_scores(spark: SparkSession, path: str) -> DataFrame:
    """doc, m1, m2, score of lines `doc|m1|m2 score`, in both orders of the pair."""
    parts = F.split(F.substring_index("value", " ", 1), r"\|")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("doc"), parts[1].alias("m1"), parts[2].alias("m2"), F.substring_index("value", " ", -1).cast("double").alias("score"))
    return rows.unionByName(rows.select("doc", F.col("m2").alias("m1"), F.col("m1").alias("m2"), "score").where("m1 <> m2"))


def signed_scores(scores: DataFrame) -> DataFrame:
    """The pair scores with `positive` and `negative`: the score where it has that sign, else 0."""
    return scores.withColumns({"positive": F.greatest("score", F.lit(0.0)), "negative": F.least("score", F.lit(0.0))})


def read_mention_xml(spark: SparkSession, path: str) -> DataFrame:
    """path, doc, entity, entity_type, mention, mtype, and text, start and end of head and extent, of annotation files."""
    span = "struct<charseq:struct<_VALUE:string,_START:long,_END:long>>"
    schema = f"_DOCID string, entity array<struct<_ID:string,_TYPE:string,entity_mention:array<struct<_ID:string,_TYPE:string,extent:{span},head:{span}>>>>"
    rows = spark.read.schema(schema).format("xml").option("rowTag", "document").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_DOCID").alias("doc"), F.explode("entity").alias("e"))
    rows = rows.select("path", "doc", F.col("e._ID").alias("entity"), F.col("e._TYPE").alias("entity_type"), F.explode("e.entity_mention").alias("m"))
    parts = [F.col(f"m.{x}.charseq.{f}").alias(f"{x}{n}") for x in ("head", "extent") for f, n in (("_VALUE", ""), ("_START", "_start"), ("_END", "_end"))]
    return rows.select("path", "doc", "entity", "entity_type", F.col("m._ID").alias("mention"), F.col("m._TYPE").alias("mtype"), *parts)


def read_predicted_mentions(spark: SparkSession, root: str, names: DataFrame | None = None) -> DataFrame:
    """Mentions of the files NAME.pred.apf.xml below the folders train, dev and test of root, with `name` and `part`; only of
    the names in the column `path` of a list, if one is given."""
    rows = read_mention_xml(spark, f"{root}/{{train,dev,test}}/*.pred.apf.xml")
    rows = rows.withColumns({"name": F.regexp_extract("path", r"([^/]+)\.pred\.apf\.xml$", 1), "part": F.regexp_extract("path", r"/(train|dev|test)/[^/]+$", 1)})
    if names is None:
        return rows
    return rows.join(names.select(F.regexp_replace("path", r"\.[^/]*$", "").alias("_name")).distinct(), F.col("name") == F.col("_name"), "left_semi")


def with_predictions(mentions: DataFrame, predicted: DataFrame, on: list[str], column: str = "entity") -> DataFrame:
    """mentions with the cluster of `predicted` (on, column) in place of their own; without one they keep none."""
    return mentions.drop(column).join(predicted.select(*on, column), on, "left")


def tagged_body(text: Column) -> tuple[Column, Column]:
    """The body between <TEXT> and </TEXT> without tags, and how many characters without tags are before it; in the JVM."""
    strip = lambda c: F.regexp_replace(c, "<[^>]*>", "")
    begin = F.instr(text, "<TEXT>")
    after = text.substr(begin + 6, F.length(text))
    stop = F.instr(after, "</TEXT>")
    inside = F.when((begin > 0) & (stop > 0), after.substr(F.lit(1), stop - 1)).otherwise("")
    return strip(inside), F.when((begin > 0) & (stop > 0), F.length(strip(text.substr(F.lit(1), begin - 1)))).otherwise(0)


def read_tagged_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text, offset: tagged_body of each file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))  # a row for each document
    body, offset = tagged_body(F.col("text"))
    return rows.select("path", body.alias("text"), offset.alias("offset"))


def align_mentions(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """Each mention with the word whose span covers its head's start; a range join inside a document."""
    return mentions.join(words, (mentions.path == words.path) & (words.start <= mentions.head_start) & (mentions.head_start <= words.end), "left").drop(words.path)


def write_model(weights: DataFrame, path: str, **parameters: str) -> None:
    """A weights table as Parquet and beside it the model's parameters."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    weights.sparkSession.createDataFrame([(k, str(v)) for k, v in parameters.items()], "name string, value string").write.mode("overwrite").parquet(f"{path}/parameters")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The weights and the parameters of a written model."""
    return spark.read.parquet(f"{path}/weights"), {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/parameters").collect()}


def write_model_text(weights: DataFrame, path: str) -> None:
    """The weights by target and feature, as tab-separated text."""
    weights.orderBy("target", "feature").write.mode("overwrite").option("sep", "\t").csv(path)


def pre_extract(features: DataFrame, order: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(examples with ids, lexicon): features of rows (idx, features) replaced by dense ids, by first appearance.

    First appearances are found by a group-by and numbered over ranges of examples. The lexicon stands on the right of a left
    join, as Spark takes exploded rows for as small as the file they come from and would send them through the driver.
    """
    each = features.select(order, F.posexplode("features").alias("at", "feature"))
    firsts = each.groupBy("feature").agg(F.min(F.struct(order, "at")).alias("first"))
    lexicon = numbered(firsts, ["first"], "feature_id").select("feature", "feature_id")
    coded = each.where("feature IS NOT NULL").join(lexicon, "feature", "left").groupBy(order).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "feature_id"))), lambda x: x["feature_id"]).alias("features"))
    return coded, lexicon


def read_examples(examples: DataFrame, lexicon: DataFrame, order: str = "idx") -> DataFrame:
    """Pre-extracted examples (idx, features as ids) with their features again, in their order."""
    each = examples.select(order, F.posexplode("features").alias("at", "feature_id")).join(lexicon.hint("shuffle_hash"), "feature_id")
    return each.groupBy(order).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "feature"))), lambda x: x["feature"]).alias("features"))


def read_example_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx, fold, labels, features of text lines of integers `labels... | features...`; a line `-1` begins the next fold."""
    rows = lines(spark, path).select(F.col("line").alias("idx"), "value")
    numbers = lambda i: F.transform(F.filter(F.split(F.split("value", r"\|")[i], " "), lambda x: x != ""), lambda x: x.cast("int"))
    made = numbered(rows.withColumn("sep", (F.trim("value") == "-1").cast("long")), ["idx"], "fold", F.col("sep")).where("sep = 0")
    return made.select("idx", "fold", numbers(0).alias("labels"), numbers(1).alias("features"))


def to_hex(value: Column) -> Column:
    """Bytes as hexadecimal text, lower case."""
    return F.lower(F.hex(value))


def from_hex(text: Column) -> Column:
    """The bytes of hexadecimal text in either case; null for other text."""
    return F.unhex(text)


def as_html(mentions: DataFrame) -> DataFrame:
    """doc, html: a document's mentions in order, coloured by cluster; columns doc, idx, entity, mtype. One row a document."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("x.mtype"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    hue = F.pmod(F.xxhash64(F.col("x.entity").cast("string")), F.lit(360)).cast("string")
    span = F.concat(F.lit('<span style="color:hsl('), hue, F.lit(',80%,35%)">'), text, F.lit("<sub>"), F.col("x.entity").cast("string"), F.lit("</sub></span>"))
    rows = mentions.select("doc", F.struct("idx", "entity", "mtype").alias("x")).select("doc", F.struct(F.col("x.idx"), span.alias("s")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["s"]), " ")
    return rows.groupBy("doc").agg(F.concat(F.lit("<html><body><p>"), body, F.lit("</p></body></html>")).alias("html"))


def fixed_width(rows: list[tuple], header: list[str], digits: int = 3, rules: tuple[int, ...] = ()) -> str:
    """A text table of a small result: numbers to so many places at the right, text at the left, a rule before each row in
    `rules` and behind the header; missing values are dashes."""
    shown = [[("-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)) for v in row] for row in rows]
    wide = [max(len(x) for x in column) for column in zip(header, *shown, strict=True)]
    right = [all(isinstance(r[i], (int, float, type(None))) for r in rows) for i in range(len(header))]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, wide, right, strict=True)).rstrip()
    rule = "  ".join("-" * w for w in wide)
    out = [line(header), rule]
    for i, cells in enumerate(shown):
        out += [rule] * (i in rules and i > 0) + [line(cells)]
    return "\n".join(out)


def plot_script(points: str, slope: float, intercept: float, r: float, title: str = "") -> str:
    """Commands for a plotting program: the points of a file of two columns and their regression line."""
    return "\n".join([f'set title "{title}"', f"f(x) = {slope!r} * x + {intercept!r}", f'plot "{points}" using 1:2 with points title "r = {r:.4f}", f(x) with lines title "fit"', ""])
