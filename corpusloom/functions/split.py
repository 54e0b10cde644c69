"""Rule-based sentence splitting, tokens, tags and renderings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.lexing import ENDING, PIECE, TOKEN, WORDY, let, running, words
from corpusloom.sources.views import SENTENCES_SQL, sentences, table

# Abbreviations before which a period doesn't end a sentence.
HONORIFICS = frozenset("""
APR AUG Adj Adm Adv Apr Asst Aug Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Cpl DEC DR Dec Dr Ens FEB Feb Gen Gov Hon
Hosp Insp JAN JUL JUN Jan Jul Jun Lt MAR MM MR MRS MS MT Maj Mar Messrs Mlle Mme Mr Mrs Ms Msgr Mt NO NOV No Nov OCT
Oct Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt SEP SEPT ST Sen Sens Sep Sept Sfc Sgt Sr St Supt Surg U.S apr aug dec
feb jan jul jun nov oct sep sept v vs
""".split())
# Abbreviations that may end a sentence, and time zones.
TERMINALS = frozenset("Esq Jr Sr M.D Ph.D".split())
ZONES = frozenset("AST CST EST HST MST PST ADT CDT EDT HDT MDT PDT UTC UTC-11".split())

# Bracket names of tagged text, and the mark that belongs to a name.
_CLOSE = frozenset([")", "}", "]", "-RBR-"])
_TAILS = _CLOSE | {"'", "\'\'", "\'\'\'", '"', "\'\""}
_TOKEN = re.compile(TOKEN)

#: Whether a mark ends a sentence, by the kind of the next token (rows) and the mark, bare or closed by a quote or bracket
#: (columns). What isn't yes or no names a test of _TESTS.
_TABLE = """
next     period   asking  period+  asking+
end      yes      yes     yes      yes
single   yes      yes     no       no
double   yes      yes     titled   yes
open     yes      no      titled   yes
bracket  dashless capital no       no
close    yes      no      no       no
period   stem     yes     no       no
dash     resumes  capital no       no
upper    settled  yes     titled   yes
digit    settled  no      no       no
other    no       no      no       no
"""
_COLUMNS, *_ROWS = (line.split() for line in _TABLE.strip().splitlines())
_VERDICTS = {(kind, mark): verdict for kind, *verdicts in _ROWS for mark, verdict in zip(_COLUMNS[1:], verdicts, strict=True)}
_NEXT = (
    ("period", re.compile(r"\.\Z")), ("dash", re.compile(r"--\Z")), ("bracket", re.compile(r"-RBR-\Z")), ("close", re.compile(r"[)}\]]\Z")),
    ("single", re.compile("'")), ("double", re.compile('["`]')), ("open", re.compile(r"[({\[]|-LBR-")),
)


def kind_of(token: str | None) -> str:
    """The row of the table that a token behind a mark belongs to."""
    if token is None:
        return "end"
    named = next((kind for kind, shape in _NEXT if shape.match(token)), None)
    return named or ("upper" if token[0].isupper() else "digit" if token[0].isdigit() else "other")


class Stem:
    """What stands before a mark in its token: with opening quotes and brackets, and without."""

    def __init__(self, text: str):
        self.text, self.bare = text, text.lstrip("\"'`{[(")
        self.opened = len(self.bare) < len(text) or text.startswith("-LBR-")
        self.titled = self.bare in HONORIFICS
        self.final = self.bare in TERMINALS
        self.clock = self.bare in ("a.m", "p.m")
        self.initials = bool(re.fullmatch(r"(?:[A-Z]\.)*[A-Z]", text))


def _settled(stem: Stem, after: str, second: str | None) -> bool:
    """A period before a capital or digit ends a sentence unless it belongs to an abbreviation."""
    if stem.final:
        return True
    abbreviates = stem.titled or stem.opened or (stem.clock and after in ZONES) or (stem.initials and after != "The")
    return not abbreviates


def _resumes(stem: Stem, after: str, second: str | None) -> bool:
    """A period before a dash ends a sentence if a quote or, behind an unquoted stem, a capital follows the dash."""
    return kind_of(second) in ("single", "double") or (kind_of(second) == "upper" and stem.text[-1:] not in ("'", '"'))


_TESTS = {
    "titled": lambda stem, after, second: not stem.titled,
    "dashless": lambda stem, after, second: second != "--",
    "capital": lambda stem, after, second: (second or "")[:1].isupper(),
    "stem": lambda stem, after, second: bool(stem.text),
    "settled": _settled,
    "resumes": _resumes,
}


def ends_sentence(word: str, at: int, after: str | None, second: str | None) -> bool:
    """Whether the mark word[at] ends a sentence, given the next two words (None beyond the paragraph)."""
    stem, tail = Stem(word[:at]), word[at + 1 :]
    if word[at] == "!" and stem.bare.lower() == "yahoo":
        return False
    if tail and tail not in _TAILS:
        return after is None
    column = ("period" if word[at] == "." else "asking") + ("+" if tail else "")
    verdict = _VERDICTS[kind_of(after), column]
    return verdict == "yes" or (verdict != "no" and _TESTS[verdict](stem, after, second))


def split_sentences(text: str | None) -> list[dict]:
    """text, start, end (inclusive) of each sentence; blank lines always end one."""
    out = []
    for paragraph in re.finditer(r"(?:[^\n]*[^\x09-\x0D\x20][^\n]*(?:\n|$))+", text or ""):
        tokens = [(m.start() + paragraph.start(), m.group()) for m in _TOKEN.finditer(paragraph.group())]
        begin = 0
        for i, (_, word) in enumerate(tokens):
            after = tokens[i + 1][1] if i + 1 < len(tokens) else None
            second = tokens[i + 2][1] if i + 2 < len(tokens) else None
            last = max((word.rfind(c) for c in ".?!"), default=-1)
            if after is None or (last >= 0 and ends_sentence(word, last, after, second)):
                start, end = tokens[begin][0], tokens[i][0] + len(word)
                out.append({"text": text[start:end], "start": start, "end": end - 1})
                begin = i + 1
    return out


def split_by_case(text: str | None, extents: list[tuple[int, int]] = ()) -> list[dict]:
    """As split_sentences; text with hardly any capitals (under one for 300 small letters) is cut at every . ! ? outside
    the extents (first and last place) of mentions."""
    text = text or ""
    if 300 * sum(c.isupper() for c in text) >= sum(c.islower() for c in text):
        return split_sentences(text)
    out, begin = [], 0
    inside = {i for first, last in extents for i in range(first, last + 1)}
    for i, c in enumerate(text):
        if (c in ".!?" and i not in inside) or i == len(text) - 1:
            own = text[begin : i + 1]
            if own.strip():
                first = begin + len(own) - len(own.lstrip())
                out.append({"text": text[first : i + 1].rstrip(), "start": first, "end": first + len(own.strip()) - 1})
            begin = i + 1
    return out




def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _kind(token: Column) -> Column:
    """kind_of as a column."""
    first = F.substring(token, 1, 1)
    return (
        F.when(token.isNull(), "end").when(token == ".", "period").when(token == "--", "dash").when(token == "-RBR-", "bracket").when(token.isin(")", "}", "]"), "close")
        .when(first == "'", "single").when(first.isin('"', "`"), "double").when(first.isin("(", "{", "[") | token.startswith("-LBR-"), "open")
        .when(first.rlike(r"^\p{Lu}"), "upper").when(first.rlike(r"^\p{Nd}"), "digit").otherwise("other")
    )


def _ends(word: Column, after: Column, second: Column) -> Column:
    """ends_sentence as a column, for the last mark of a word; true for the last word of a paragraph, false without a mark."""
    part = lambda g: F.regexp_extract(word, r"(?s)^(.*)([.?!])([^.?!]*)\z", g)

    def ruled(stem: Column, sign: Column, tail: Column) -> Column:
        bare = F.regexp_replace(stem, "^[\"'`{\\[(]+", "")
        upper = lambda c: F.coalesce(F.substring(c, 1, 1).rlike(r"^\p{Lu}"), F.lit(False))
        opened, titled = (bare != stem) | stem.startswith("-LBR-"), bare.isin(*HONORIFICS)
        abbreviates = titled | opened | (bare.isin("a.m", "p.m") & after.isin(*ZONES)) | (stem.rlike(r"^(?:[A-Z]\.)*+[A-Z]\z") & (after != "The"))
        tests = {
            "yes": F.lit(True), "titled": ~titled, "dashless": ~second.eqNullSafe(F.lit("--")), "capital": upper(second), "stem": stem != "", "settled": bare.isin(*TERMINALS) | ~abbreviates,
            "resumes": F.coalesce(_kind(second).isin("single", "double") | (upper(second) & ~F.substring(stem, -1, 1).isin("'", '"')), F.lit(False)),
        }
        column = F.concat(F.when(sign == ".", "period").otherwise("asking"), F.when(tail == "", "").otherwise("+"))
        verdict = F.element_at(_map({f"{kind} {mark}": v for (kind, mark), v in _VERDICTS.items()}), F.concat(_kind(after), F.lit(" "), column))
        holds = let(verdict, lambda v: F.coalesce(*[F.when(v == name, test) for name, test in tests.items()], F.lit(False)))
        return ~((sign == "!") & (F.lower(bare) == "yahoo")) & ((tail == "") | tail.isin(*_TAILS)) & holds

    marked = let(F.struct(part(1).alias("stem"), part(2).alias("sign"), part(3).alias("tail")), lambda x: ruled(x["stem"], x["sign"], x["tail"]))
    return F.when(after.isNull(), True).when(word.rlike("[.?!]"), marked).otherwise(False)


def sentence_spans(text: Column) -> Column:
    """split_sentences as a column: array<struct<text, start, end>>; JVM expressions inside the row, places by lengths."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\x09-\x0D\x20]*" + TOKEN), F.lit(0))

    def token(p: Column) -> Column:
        """word, gap, and whether a blank line is before it."""
        word = F.ltrim(p, F.lit("\t\n\v\f\r "))
        return F.struct(word.alias("word"), (F.length(p) - F.length(word)).alias("gap"), (p.contains("\n") & p.rlike(r"^[\x09-\x0D\x20]*\n[\x09-\x0D\x20]*\n")).alias("breaks"))

    def spans(t: Column, p: Column) -> Column:
        n = F.size(t)

        def next_word(i: Column, k: int) -> Column:
            """The k-th word behind the i-th, null beyond the paragraph."""
            same = F.lit(True)
            for j in range(1, k + 1):
                same = same & ~F.coalesce(F.get(t, i + j)["breaks"], F.lit(True))
            return F.when(same, F.get(t, i + k)["word"])

        ends = F.filter(F.transform(t, lambda x, i: F.when(_ends(x["word"], next_word(i, 1), next_word(i, 2)), i)), lambda i: i.isNotNull())

        def made(e: Column, starts: Column) -> Column:
            def one(last: Column, k: Column) -> Column:
                first = F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1) + 1)
                own = F.array_join(F.slice(p, first + 1, last - first + 1), "")
                skip = F.get(t, first)["gap"]
                return F.struct(own.substr(skip + 1, F.length(own)).alias("text"), (F.get(starts, first) + skip).alias("start"), (F.get(starts, first) + F.length(own) - 1).alias("end"))

            return F.transform(e, one)

        found = let(ends, lambda e: let(running(F.transform(p, F.length)), lambda starts: made(e, starts)))
        return F.when(n > 0, found).otherwise(F.array().cast("array<struct<text:string,start:int,end:int>>"))

    return let(pieces, lambda p: let(F.transform(p, token), lambda t: spans(t, p)))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sent, text, start, stop (inclusive)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentence_spans(F.col("text"))).alias("sent", "s"))
    return rows.select("doc_id", "sent", "s.text", "s.start", F.col("s.end").alias("stop"))


def word_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, form, start, stop (inclusive) of the words of conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("pos", "w"))
    return rows.select("conv_id", "turn", "pos", "w.form", "w.start", F.col("w.end").alias("stop"))


def paragraph_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, form: the tokens of each text; a word cut by a hyphen at a line's end is one. JVM expressions only."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+(?:(?<=[^\s-]-)\n\s*\S*)*+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("pos", "form"))


def plain_tokens(words: DataFrame) -> DataFrame:
    """Word rows as token rows: empty `type` and `label` columns to be filled by a tagger."""
    return words.withColumns({"type": F.lit(None).cast("string"), "label": F.lit(None).cast("string")})


def bracketed(tag: Column, form: Column) -> Column:
    """`(TAG form)`, brackets in the form written by name."""
    return F.concat(F.lit("("), tag, F.lit(" "), F.regexp_replace(F.regexp_replace(form, r"\(", "-LRB-"), r"\)", "-RRB-"), F.lit(")"))


def bracket_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sent, line: each line's words in brackets, tagged CD with a digit first and NN else."""
    rows = sentences(table(spark, sf_dir, "documents"))
    made = F.transform("words", lambda w: bracketed(F.when(w.rlike("^[0-9]"), "CD").otherwise("NN"), w))
    return rows.select("doc_id", "sent", F.array_join(made, " ").alias("line"))


def entities_cleaned(text: Column) -> Column:
    """The written-out ampersand, in either case, as the character."""
    return F.regexp_replace(text, "&(?:amp|AMP);", "&")


# Part-of-speech tags and what they stand for.
TAGS = dict(x.split(" ", 1) for x in """
CC Coordinating conjunction
CD Cardinal number
DT Determiner
EX Existential there
FW Foreign word
IN Preposition or subordinating conjunction
JJ Adjective
JJR Adjective, comparative
JJS Adjective, superlative
LS List item marker
MD Modal
NN Noun, singular or mass
NNS Noun, plural
NNP Proper noun, singular
NNPS Proper noun, plural
PDT Predeterminer
POS Possessive ending
PRP Personal pronoun
PRP$ Possessive pronoun
RB Adverb
RBR Adverb, comparative
RBS Adverb, superlative
RP Particle
SYM Symbol
TO to
UH Interjection
VB Verb, base form
VBD Verb, past tense
VBG Verb, gerund or present participle
VBN Verb, past participle
VBP Verb, non-3rd person singular present
VBZ Verb, 3rd person singular present
WDT Wh-determiner
WP Wh-pronoun
WP$ Possessive wh-pronoun
WRB Wh-adverb
# Pound sign
$ Dollar sign
\'\' Closing quotation mark
`` Opening quotation mark
( Opening bracket
) Closing bracket
, Comma
. Sentence end
: Colon, semicolon or dash
""".strip().splitlines())


def tag_name(tag: Column) -> Column:
    """What a tag stands for; null for unknown tags."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair]), tag)


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sentences, tokens: how many sentences a document has, and tokens in all of them."""
    return sentence_split(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("tokens"))


def _names(values) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in sorted(values))


def _sentences_sql(last: str) -> str:
    """The table of rules as SQL: a verdict for each pair of next token and mark, tests as booleans."""
    upper = r"regexp_matches({}, '^\p{{Lu}}')"
    kinds = f"""CASE WHEN a IS NULL THEN 'end' WHEN a = '.' THEN 'period' WHEN a = '--' THEN 'dash' WHEN a = '-RBR-' THEN 'bracket'
        WHEN a IN (')', '}}', ']') THEN 'close' WHEN starts_with(a, chr(39)) THEN 'single' WHEN left(a, 1) IN ('"', '`') THEN 'double'
        WHEN left(a, 1) IN ('(', '{{', '[') OR starts_with(a, '-LBR-') THEN 'open' WHEN {upper.format("a")} THEN 'upper'
        WHEN regexp_matches(a, '^[0-9]') THEN 'digit' ELSE 'other' END"""
    verdicts = " ".join(f"WHEN kind = '{kind}' AND mark = '{mark}' THEN '{verdict}'" for (kind, mark), verdict in _VERDICTS.items())
    initials = r"regexp_matches(stem, '^(?:[A-Z]\.)*[A-Z]$')"
    tests = f"""CASE verdict WHEN 'yes' THEN true WHEN 'no' THEN false WHEN 'titled' THEN bare NOT IN ({_names(HONORIFICS)})
        WHEN 'dashless' THEN b IS DISTINCT FROM '--' WHEN 'capital' THEN coalesce({upper.format("b")}, false) WHEN 'stem' THEN stem <> ''
        WHEN 'resumes' THEN coalesce(left(b, 1) IN (chr(39), '"', '`') OR ({upper.format("b")} AND right(stem, 1) NOT IN (chr(39), '"')), false)
        ELSE bare IN ({_names(TERMINALS)}) OR NOT (bare IN ({_names(HONORIFICS)}) OR bare <> stem OR starts_with(stem, '-LBR-')
            OR (bare IN ('a.m', 'p.m') AND a IN ({_names(ZONES)})) OR ({initials} AND a <> 'The')) END"""
    part = r"""regexp_extract(w, '(?s)^(.*)([.?!])([^.?!]*)$', {})"""
    blank = r"[\x09-\x0D\x20]"
    piece = rf"{blank}*(?:[^\x09-\x0D\x20-](?:-\n[\x09\x0B-\x0D\x20]*[^\x09-\x0D\x20-])*(?:-\n[\x09\x0B-\x0D\x20]*-)?|[^\x09-\x0D\x20])+"
    return rf"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{piece}') AS p FROM documents),
        each AS (SELECT doc_id, t, generate_subscripts(p, 1) AS pos, unnest(p) AS p FROM cut),
        toks AS (SELECT doc_id, t, pos, w, begin, begin + len(p) - len(w) AS start, sum(br::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS par FROM (SELECT *, regexp_replace(p, '^{blank}+', '') AS w,
            regexp_matches(regexp_extract(p, '^{blank}*'), '(?s)\n.*\n') AS br, (sum(len(p)) OVER (PARTITION BY doc_id ORDER BY pos) - len(p))::BIGINT AS begin FROM each)),
        near AS (SELECT *, lead(w) OVER x AS a, lead(w, 2) OVER x AS b, {part.format(1)} AS stem, {part.format(2)} AS sign, {part.format(3)} AS tail FROM toks WINDOW x AS (PARTITION BY doc_id, par ORDER BY pos)),
        marked AS (SELECT *, {kinds} AS kind, CASE WHEN sign = '.' THEN 'period' ELSE 'asking' END || CASE WHEN tail = '' THEN '' ELSE '+' END AS mark, ltrim(stem, '"`{{[(' || chr(39)) AS bare FROM near),
        ruled AS (SELECT *, CASE {verdicts} END AS verdict FROM marked),
        ended AS (SELECT *, a IS NULL OR (sign <> '' AND NOT (sign = '!' AND lower(bare) = 'yahoo') AND (tail = '' OR tail IN ({_names(_TAILS)})) AND {tests}) AS ends FROM ruled),
        placed AS (SELECT *, (sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY pos) - ends::INT)::INT AS sent FROM ended)
        {last}"""


_COUNTS = "SELECT doc_id, count(*) FILTER (ends) AS sentences, count(*) AS tokens FROM placed GROUP BY 1"
_SPANS = """SELECT doc_id, sent, substring(any_value(t), min(start) + 1, max(start + len(w)) - min(start)) AS text, min(start)::INT AS start, (max(start + len(w)) - 1)::INT AS stop FROM placed GROUP BY doc_id, sent"""
_WORDS = rf"""WITH cut AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{PIECE.replace("'", "''").replace(")*+", ")*").replace(")++", ")+")}') AS p FROM conversations),
        each AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS i, unnest(p) AS p FROM cut),
        body AS (SELECT *, regexp_replace(p, '^[\x09-\x0D\p{{Z}}]+', '') AS w, max(CASE WHEN regexp_matches(p, '[\p{{L}}\p{{M}}\p{{N}}_]') THEN i END) OVER r AS word, coalesce(max(CASE WHEN contains(p, '.') THEN i END) OVER r, 0) AS dot
            FROM each WINDOW r AS (PARTITION BY conv_id, turn)),
        parts AS (SELECT *, regexp_matches(w, '{WORDY.replace("'", "''").replace(")*+", ")*")}') AS wordy, regexp_extract(w, '{ENDING.replace("'", "''")}', 1) AS base, regexp_extract(w, '{ENDING.replace("'", "''")}', 2) AS clitic,
            len(regexp_extract(w, '{ENDING.replace("'", "''")}', 3)) AS n FROM body),
        glue AS (SELECT *, CASE WHEN n = 0 OR n >= 3 OR (n = 1 AND i = word AND dot <= word) THEN '' ELSE '.' END AS g FROM parts),
        forms AS (SELECT conv_id, turn, i, len(p) - len(w) AS gap, list_filter(CASE WHEN NOT wordy THEN [w] WHEN base <> '' AND clitic <> '' THEN [base, clitic || g, repeat('.', n - len(g))]
            ELSE [base || clitic || g, repeat('.', n - len(g))] END, lambda x: x <> '') AS f FROM glue),
        flat AS (SELECT conv_id, turn, i, gap, generate_subscripts(f, 1) AS j, unnest(f) AS form FROM forms),
        ends AS (SELECT *, sum(len(form) + CASE WHEN j = 1 THEN gap ELSE 0 END) OVER o AS stop, row_number() OVER o - 1 AS pos FROM flat WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i, j))
        SELECT conv_id, turn, pos::INT AS pos, form, (stop - len(form))::INT AS start, (stop - 1)::INT AS stop FROM ends"""
QUERIES = {f.__name__: f for f in (sentence_split, sentence_counts, word_split, paragraph_tokens, bracket_rendering)}
SQL: dict[str, str] = {
    "sentence_counts": _sentences_sql(_COUNTS),
    "sentence_split": _sentences_sql(_SPANS),
    "word_split": _WORDS,
    "paragraph_tokens": r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?:[^\s-]-\n\s*|\S)+') AS w FROM documents)
        SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS form FROM t""",
    "bracket_rendering": f"""WITH {SENTENCES_SQL} SELECT doc_id, sent, array_to_string(list_transform(words, lambda w:
        '(' || CASE WHEN regexp_matches(w, '^[0-9]') THEN 'CD' ELSE 'NN' END || ' ' || replace(replace(w, '(', '-LRB-'), ')', '-RRB-') || ')'), ' ') AS line FROM sentences""",
}
