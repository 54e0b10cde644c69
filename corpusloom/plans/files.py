"""Queries that write a given table in a file format to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import formats
from corpusloom.sources.readers import read_mention_xml, tagged_body
from corpusloom.sources.shared import shared_path
from corpusloom.sources.views import MENTIONS_SQL, mentions, table, unfolded

#: Small ranges, so that records of the round trips lie across many cuts.
RANGE = 48 << 10
#: Documents of an annotation file at most: Spark reads such a file whole in one task, and a document of 120 mentions has some 46 kB.
DOCUMENTS = 1000


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x09-\x0D\x20]+"), F.lit(0))


def _loaded(spark: SparkSession, lines: DataFrame, kind: str) -> DataFrame:
    """The text lines written to the shared folder and read as a format."""
    path = shared_path(spark, kind)
    lines.write.text(path)
    formats.register(spark)
    return spark.read.format(kind).option("rangeBytes", RANGE).load(path)


def column_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, form, tag of conversations, through files in column format: a word a line, an empty line after each turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _words("text").alias("w")).where(F.size("w") > 0)
    line = lambda w: F.concat_ws("\t ", "conv_id", "turn", w, F.when(w.rlike("^[A-Z]"), "B").otherwise("O"))
    found = _loaded(spark, rows.select(F.concat(F.array_join(F.transform("w", line), "\n"), F.lit("\n"))), "columns")
    part = lambda i: F.get("fields", F.lit(i))
    return found.select(part(0).cast("long").alias("conv_id"), part(1).cast("long").alias("turn"), "pos", part(2).alias("form"), part(3).alias("tag"))


def bracket_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, tag, form of the words without brackets, through files of lines `(ID conv:turn) (tag word) ...`."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(_words("text"), lambda w: ~w.rlike("[()]")).alias("w"))
    pair = lambda w: F.concat(F.lit("("), F.when(w.rlike("^[0-9]"), "CD").otherwise("NN"), F.lit(" "), w, F.lit(")"))
    first = F.concat(F.lit("(ID "), "conv_id", F.lit(":"), "turn", F.lit(")"))
    found = _loaded(spark, rows.select(F.concat_ws(" ", first, F.array_join(F.transform("w", pair), " "))), "named_brackets")
    words = found.where("pos > 0").select(F.split("name", ":").alias("id"), "pos", "tag", "form")
    return words.select(F.get("id", F.lit(0)).cast("long").alias("conv_id"), F.get("id", F.lit(1)).cast("long").alias("turn"), (F.col("pos") - 1).alias("pos"), "tag", "form")


def example_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality, n, total, first of pre-extracted examples, through files of lines `labels | features`: the lengths of a document's words."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", F.transform(_words("text"), F.length).alias("n"))
    found = _loaded(spark, rows.select(F.concat_ws(" | ", F.concat_ws(" ", "doc_id", F.coalesce("quality", F.lit(-1))), F.array_join("n", " "))), "examples")
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.get("labels", F.lit(0)).cast("long").alias("doc_id"), F.get("labels", F.lit(1)).alias("quality"), F.size("features").alias("n"), total.alias("total"), F.get("features", F.lit(0)).alias("first"))


def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, entity, entity_type, mention, mtype, head, head_start, head_end, extent, extent_start, extent_end of the mention view, through
    annotation files: a document element with its entities, each with its mentions and their spans."""
    rows = mentions(spark, sf_dir)
    start = F.col("idx").cast("long") * 10

    def span(text: Column, first: Column, last: Column, name: str) -> Column:
        return F.struct(F.struct(text.alias("_VALUE"), first.alias("_START"), last.alias("_END")).alias("charseq")).alias(name)

    extent = F.concat_ws(" & <", "mtype", F.col("pred").cast("string"))
    mention = F.struct(F.format_string("m%06d", "idx").alias("_ID"), F.col("mtype").alias("_TYPE"), span(extent, start, start + F.length(extent) - 1, "extent"), span(F.col("mtype"), start, start + F.length("mtype") - 1, "head"))
    entities = rows.groupBy("doc", "entity").agg(F.array_sort(F.collect_list(mention)).alias("m"))
    element = F.struct(F.col("entity").cast("string").alias("_ID"), F.when(F.col("entity") % 2 == 0, "PER").otherwise("ORG").alias("_TYPE"), F.col("m").alias("entity_mention"))
    docs = entities.groupBy("doc").agg(F.array_sort(F.collect_list(element)).alias("entity"))
    document = lambda name, held: F.struct(name.alias("_DOCID"), held.alias("entity"))
    empty = document(F.concat(F.lit("empty-"), "doc"), F.slice("entity", 1, 0))  # beside each document, one without entities
    path = shared_path(spark, "annotations")
    each = unfolded(docs.select(F.array(document(F.col("doc"), F.col("entity")), empty).alias("d")), "d").select("d.*")
    each.write.format("xml").option("rootTag", "source_file").option("rowTag", "document").option("maxRecordsPerFile", 2 * DOCUMENTS).save(path)
    return read_mention_xml(spark, path).drop("path")


def tagged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, body, before: the body of a tagged text and how many characters without tags are before it."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>]", "")
    marked = F.concat(F.lit("<DOC>\n<ID> "), F.col("doc_id").cast("string"), F.lit(" </ID>\n<TEXT>"), F.regexp_replace(text, "\n", "<P>\n"), F.lit("</TEXT>\n</DOC>"))
    body, offset = tagged_body(F.col("marked"))
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("marked")).select("doc_id", body.alias("body"), offset.alias("before"))


_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')"
QUERIES = {f.__name__: f for f in (column_files, bracket_files, example_files, annotation_files, tagged_texts)}
SQL = {
    "column_files": f"""WITH t AS (SELECT conv_id, turn, {_SPLIT} AS w FROM conversations), e AS (SELECT conv_id, turn, (generate_subscripts(w, 1) - 1)::INT AS pos, unnest(w) AS form FROM t)
        SELECT *, CASE WHEN regexp_matches(form, '^[A-Z]') THEN 'B' ELSE 'O' END AS tag FROM e""",
    "bracket_files": f"""WITH t AS (SELECT conv_id, turn, list_filter({_SPLIT}, lambda w: NOT regexp_matches(w, '[()]')) AS w FROM conversations),
        e AS (SELECT conv_id, turn, (generate_subscripts(w, 1) - 1)::INT AS pos, unnest(w) AS form FROM t) SELECT *, CASE WHEN regexp_matches(form, '^[0-9]') THEN 'CD' ELSE 'NN' END AS tag FROM e""",
    "example_files": f"""WITH t AS (SELECT doc_id, quality, list_transform({_SPLIT}, lambda w: len(w)) AS n FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, quality, len(n)::INT AS n, coalesce(list_sum(n), 0)::BIGINT AS total, n[1]::INT AS first FROM t""",
    "annotation_files": f"""WITH {MENTIONS_SQL}, x AS (SELECT *, mtype || ' & <' || pred AS extent FROM mentions)
        SELECT doc, entity::VARCHAR AS entity, CASE WHEN entity % 2 = 0 THEN 'PER' ELSE 'ORG' END AS entity_type, 'm' || lpad(idx::VARCHAR, 6, '0') AS mention, mtype, mtype AS head, idx::BIGINT * 10 AS head_start,
            idx::BIGINT * 10 + len(mtype) - 1 AS head_end, extent, idx::BIGINT * 10 AS extent_start, idx::BIGINT * 10 + len(extent) - 1 AS extent_end FROM x""",
    "tagged_texts": """SELECT doc_id, regexp_replace(coalesce(text, ''), '[<>]', '', 'g') AS body, (len(doc_id::VARCHAR) + 4)::INT AS before FROM documents""",
}
