"""Word and sentence columns: texts are cut into pieces by what a word looks like, inside a row, by JVM expressions.

A pattern describes whole words of every shape: addresses, amounts, numbers, words with inner hyphens, apostrophes and
periods, runs of one mark, single marks. Its matches with the white space before them cover a text without a gap, so places
are running sums of lengths. A word's end (an enclitic, a period, an ellipsis) is then cut off by a second pattern.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocols and generic domain names of addresses. Any two letters count as a country's domain.
PROTOCOLS = ("telnet", "https", "file", "http", "nntp", "smtp")
DOMAINS = ("museum", "travel", "aero", "arpa", "coop", "info", "jobs", "name", "biz", "com", "edu", "gov", "int", "mil", "net", "org", "pro")

_SPACE, _BLACK, _LETTER = r"[\x09-\x0D\p{Z}]", r"[^\x09-\x0D\p{Z}]", r"[\p{L}\p{M}\p{N}_]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\v\f\r" or unicodedata.category(c)[0] == "Z")
_DOTS = r"\.*"
#: The shapes of a word, the first that fits; `{s}` is the white space before it. Loops over groups never give back what they
#: took, so that a word of any length needs no stack.
_SHAPES = (
    rf"{{s}}(?i:{'|'.join(PROTOCOLS)})://[^\x09-\x0D\p{{Z}},]+",  # an address with its protocol
    rf"{{s}}(?i:[a-z0-9][a-z0-9.-]*\.(?:{'|'.join(DOMAINS)}|[a-z]{{2}}))/[^\x09-\x0D\p{{Z}},]+",  # a host with a path
    rf"(?:^|{_SPACE}+)(?:[$-]{{1,2}}\.?|\.)\p{{N}}+(?:[.,:/]\p{{N}}+)*+{_LETTER}*{_DOTS}",  # a signed number, an amount
    rf"{{s}}\p{{N}}+(?:[.,:/]\p{{N}}+)++{_LETTER}*{_DOTS}",  # a number with separators, a time, a date, a fraction
    rf"{{s}}{_LETTER}+(?:(?:[-'.]|\.'){_LETTER}+)*+{_DOTS}",  # a word
    r"{s}(?:''|``|-+|\.+|!+|\?+|\*+|=+|#+|~+|\++)",  # a run of one mark
    rf"{{s}}{_BLACK}",  # any other mark
)
PIECE = "|".join(_SHAPES).replace("{s}", f"{_SPACE}*").replace("{{", "{").replace("}}", "}")
#: A word, its enclitic and its periods.
ENDING = r"^(.*?)([nN]'[tT]|'[sdmSDM]|'ll|'re|'ve|'LL|'RE|'VE|)(\.*)$"
#: Pieces that may have such an end: no address with a protocol, no mark.
WORDY = rf"^[-$.]{{0,3}}{_LETTER}+(?:(?:[-'.,:/]|\.'){_LETTER}+)*+{_DOTS}$"

#: A token of running text; one that a hyphen cuts at a line's end goes on in the next line.
_W = r"\x09-\x0D\x20"
TOKEN = rf"[^{_W}]+(?:(?<=[^{_W}-]-)\n[\x09\x0B-\x0D\x20]*[^{_W}]+)*+"
_ROW = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column) -> Column:
    """Sums of what stands before each place of an array of ints, in rows of _ROW places, so that long arrays aren't copied once for each place."""
    zero = F.array(F.lit(0))

    def sums(values: Column, start: Column) -> Column:
        """start, start + first, and so on; one more than values."""
        return F.aggregate(values, F.array(start), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))

    def whole(v: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _ROW).cast("int")), lambda i: F.slice(v, i * _ROW + 1, F.lit(_ROW)))

        def placed(r: Column) -> Column:
            totals = F.transform(r, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b))
            return let(sums(totals, F.lit(0)), lambda starts: F.flatten(F.transform(r, lambda x, i: F.slice(sums(x, F.get(starts, i)), F.lit(1), F.size(x)))))

        return let(rows, placed)

    return let(lengths, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.slice(zero, 1, 0)))


def counted(forms: Column) -> Column:
    """array<struct<form, times>> of the different strings of an array, sorted: equal ones stand together, so one pass counts them."""

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(firsts, lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("form"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).cast("long").alias("times"))))

    return let(F.sort_array(forms), runs)


def words(text: Column) -> Column:
    """array<struct<form, start, end>> of a text's words, end inclusive. Null and empty texts have none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))

    def cut(p: Column) -> Column:
        """gap, forms, of each piece."""
        last = lambda test: F.coalesce(F.array_max(F.transform(p, lambda x, i: F.when(test(x), i + 1))), F.lit(0))
        last_word, last_dot = last(lambda x: x.rlike(_LETTER)), last(lambda x: x.contains("."))

        def forms(piece: Column, i: Column, final: Column) -> Column:
            body = F.ltrim(piece, F.lit(_SPACES))
            base, clitic, dots = (F.regexp_extract(body, ENDING, g) for g in (1, 2, 3))
            n = F.length(dots)
            glued = F.when((n == 0) | (n >= 3) | ((n == 1) & (i + 1 == final)), F.lit("")).otherwise(F.lit("."))
            parts = F.when((clitic != "") & (base != ""), F.array(base, F.concat(clitic, glued))).otherwise(F.array(F.concat(base, clitic, glued)))
            rest = F.repeat(F.lit("."), n - F.length(glued))
            whole = ~body.contains(".") & ~body.contains("'")  # nothing to cut off
            made = F.when(whole | ~body.rlike(WORDY), F.array(body)).otherwise(F.filter(F.concat(parts, F.array(rest)), lambda x: x != ""))
            return F.struct((F.length(piece) - F.length(body)).alias("gap"), made.alias("forms"))

        whole = F.when(last_dot <= last_word, last_word).otherwise(F.lit(-1))  # the last word, if no period follows it
        return let(whole, lambda final: F.transform(p, lambda piece, i: forms(piece, i, final)))

    def flat(c: Column) -> Column:
        return F.flatten(F.transform(c, lambda x: F.transform(x["forms"], lambda f, j: F.struct(F.when(j == 0, x["gap"]).otherwise(0).alias("gap"), f.alias("form")))))

    def placed(t: Column) -> Column:
        before = running(F.transform(t, lambda x: x["gap"] + F.length(x["form"])))
        return let(before, lambda b: F.transform(t, lambda x, i: F.struct(x["form"].alias("form"), (F.get(b, i) + x["gap"]).alias("start"), (F.get(b, i) + x["gap"] + F.length(x["form"]) - 1).alias("end"))))

    return let(pieces, lambda p: let(cut(p), lambda c: let(flat(c), placed)))


def split_words_of(text: str | None) -> list[dict]:
    """The same for one text, as dictionaries."""
    pieces = list(regex.finditer(PIECE, text or ""))
    last_word = max((i for i, m in enumerate(pieces) if regex.search(_LETTER, m[0])), default=-1)
    last_dot = max((i for i, m in enumerate(pieces) if "." in m[0]), default=-1)
    out = []
    for i, m in enumerate(pieces):
        body = regex.sub(f"^{_SPACE}+", "", m[0])
        forms = [body]
        if regex.search(WORDY, body):
            base, clitic, dots = regex.match(ENDING, body).groups()
            n = len(dots)
            glued = "" if n == 0 or n >= 3 or (n == 1 and i == last_word >= last_dot) else "."
            forms = [x for x in ([base, clitic + glued] if clitic and base else [base + clitic + glued]) + ["." * (n - len(glued))] if x]
        at = m.end() - len(body)
        for form in forms:
            out.append({"form": form, "start": at, "end": at + len(form) - 1})
            at += len(form)
    return out
