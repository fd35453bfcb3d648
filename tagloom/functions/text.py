"""Column expressions over tag text, captions, prompts and judge replies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.bind import let

# The characters Python's str.split() treats as white space.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


# The characters that Python's repr() escapes, other than quotes and backslashes.
UNPRINTED = r"[\p{C}\p{Z}&&[^ ]]"


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


_STRING = r"""(?:'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+")"""


def parse_tag_literal(text) -> Column:
    """A list or tuple literal such as ``['a', "b's"]`` as an array of strings; NULL when it does not parse.

    As in Python a comma may follow the last element, and strings side by side are one string. Escapes are those
    of JSON, ``\\xNN`` and any escaped character.
    """
    t = _c(text)
    plain = F.regexp_replace(F.regexp_replace(t, f"(?s){_STRING}", "S"), r"\s+", "")
    rest = F.regexp_replace(F.regexp_replace(plain, "S+", "S"), "S,", "")
    tuple_ = plain.startswith("(") & ((rest == "()") | ((rest == "(S)") & plain.contains(",")))
    elements = F.regexp_extract_all(t, F.lit(f"(?s){_STRING}(?:\\s*{_STRING})*"), F.lit(0))
    hexed = lambda e: F.regexp_replace(e, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
    read = lambda e: F.array_join(F.from_json(F.concat(F.lit("["), F.array_join(F.regexp_extract_all(hexed(e), F.lit(f"(?s){_STRING}"), F.lit(0)), ","), F.lit("]")), "array<string>", options), "")
    return F.when(rest.isin("[]", "[S]") | tuple_, F.transform(elements, read))


def split_tags(text, sep: str, trim: bool = True, legacy_empty: bool = False) -> Column:
    """Delimited tag text as an array. ``legacy_empty`` keeps the single empty tag that ``''`` splits into."""
    parts = F.split(_c(text), re.escape(sep))
    if trim:
        parts = F.transform(parts, lambda t: F.trim(t))
    return parts if legacy_empty else F.filter(parts, lambda t: t != "")


def render_tag_literal(tags) -> Column:
    """The text Python prints for a list of strings, so that keys hashed from it stay comparable."""

    def escape(c: Column) -> Column:
        code = F.ascii(c)
        number = F.lower(F.hex(code))
        named = [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
        out = F.when(~c.rlike(UNPRINTED), c)
        for plain, name in named:
            out = out.when(c == plain, F.lit(name))
        out = out.when(code < 256, F.concat(F.lit("\\x"), F.lpad(number, 2, "0"))).when(code < 65536, F.concat(F.lit("\\u"), F.lpad(number, 4, "0")))
        return out.otherwise(F.concat(F.lit("\\U"), F.lpad(number, 8, "0")))

    def printed(t: Column) -> Column:
        return F.when(t.rlike(UNPRINTED), F.array_join(F.transform(F.split(t, ""), escape), "")).otherwise(t)

    def quoted(t: Column) -> Column:
        body = printed(F.replace(t, F.lit("\\"), F.lit("\\\\")))
        single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), body, F.lit('"'))
        return F.when(t.contains("'") & ~t.contains('"'), double).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(_c(tags), quoted), ", "), F.lit("]"))


def remove_phrase(text, phrase: str) -> Column:
    """Delete a literal phrase whatever its case."""
    return F.regexp_replace(_c(text), "(?i)" + re.escape(phrase), "")


def words(text) -> Column:
    return F.filter(F.split(_c(text), WHITESPACE), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text)).cast("bigint")


def char_count(text) -> Column:
    return F.char_length(_c(text)).cast("bigint")


def fill_template(template, **values) -> Column:
    """Fill ``{name}`` placeholders; doubled braces are braces. Text that is put in is never searched again."""
    out: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            out.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            value = values[piece[1:-1]]
            out.append((value if isinstance(value, Column) else F.lit(value)).cast("string"))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out, F.lit(""))


def check_template(template: str, placeholders: Sequence[str], delimiter: str = "") -> None:
    """ValueError before any row is read if a prompt template lacks a placeholder or the delimiter of its answer."""
    found = {p[1:-1] for p in re.split(r"(\{\{|\}\}|\{\w+\})", template) if re.fullmatch(r"\{\w+\}", p)}
    if missing := [p for p in placeholders if p not in found]:
        raise ValueError(f"template without {missing}")
    if delimiter and delimiter not in template:
        raise ValueError(f"template without the delimiter {delimiter!r}")


def strip(text) -> Column:
    """Python's ``str.strip()``."""
    edge = WHITESPACE
    return F.regexp_replace(_c(text), f"^{edge}|{edge}$", "")


def strip_prefix(output, prompt) -> Column:
    """Drop the echoed prompt from a completion and trim what is left."""
    o, p = _c(output), _c(prompt)
    rest = F.substring(o, F.char_length(p) + 1, F.char_length(o))
    return F.when(F.startswith(o, p), strip(rest)).otherwise(o)


# Spellings of a finite decimal number.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_judge_score(reply, low: float = 1.0, high: float = 10.0, default: float = 5.0) -> Column:
    """Score of the last ``Score:`` line, ``8/10`` read as 8, clamped; the default when there is none."""
    lines = F.transform(F.split(_c(reply), "\n"), strip)
    line = F.get(F.reverse(F.filter(lines, lambda l: l.startswith("Score:"))), F.lit(0))
    value = strip(F.get(F.split(F.replace(line, F.lit("Score:"), F.lit("")), "/"), F.lit(0)))
    token = F.get(F.split(value, WHITESPACE), F.lit(0))
    number = F.when(token.rlike(NUMBER), token.try_cast("double"))
    return F.when(number.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), number)))


def parse_judge_reasoning(reply, default: str = "No reasoning provided") -> Column:
    lines = F.transform(F.split(_c(reply), "\n"), strip)
    line = F.get(F.reverse(F.filter(lines, lambda l: l.startswith("Reasoning:"))), F.lit(0))
    text = strip(F.replace(line, F.lit("Reasoning:"), F.lit("")))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


# The published mteval-v13a tokenisation rules, in order.
MTEVAL_RULES = (
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
MTEVAL_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_mteval(text) -> Column:
    """Tokens for BLEU."""
    t = F.replace(_c(text), F.lit("<skipped>"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, plain in MTEVAL_ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, repl in MTEVAL_RULES:
        t = F.regexp_replace(t, pattern, repl)
    return words(t)


def tokens_rouge(text) -> Column:
    """Tokens for ROUGE: lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens, n: int) -> Column:
    if n == 1:
        return _c(tokens)

    def grams(v: Column) -> Column:
        t = v["t"]
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
        some = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(grams, t=_c(tokens))


def multiset_overlap(a, b) -> Column:
    """Size of the intersection of two arrays as multisets (the clipped match count).

    Both arrays are sorted once and merged in one linear pass, so a row is scored where it lies and no
    n-gram is ever shuffled.
    """

    def merged(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("m"))

        def step(s: Column, _: Column) -> Column:
            x, y = F.get(p["x"], s["i"]), F.get(p["y"], s["j"])
            hit = x == y
            return F.when(x.isNull() | y.isNull(), s).otherwise(
                F.struct(
                    (s["i"] + F.when(x <= y, 1).otherwise(0)).alias("i"),
                    (s["j"] + F.when(y <= x, 1).otherwise(0)).alias("j"),
                    (s["m"] + F.when(hit, 1).otherwise(0)).alias("m"),
                )
            )

        steps = F.sequence(F.lit(0), F.size(p["x"]) + F.size(p["y"]))
        return F.aggregate(steps, start, step, lambda s: s["m"].cast("bigint"))

    return let(merged, x=F.sort_array(_c(a)), y=F.sort_array(_c(b)))
