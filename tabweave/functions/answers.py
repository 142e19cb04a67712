"""Answers in one normalised line, as column expressions.

An answer is JSON or free text. Of JSON the scalars count, in the order in which they are written, wherever they are nested: they are the
tokens of its text that aren't keys, so no recursion is needed. Of free text its whole numbers count, then its ASCII words.
"""

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import printed

# Patterns that the normalised form goes by. Braces and names with a colon leave a text; what isn't part of a number leaves it before it is read as one.
BRACES_AND_NAMES = r"[{}]|[\p{L}\p{N}_-]+:"
NOT_OF_A_NUMBER = r"[^\p{Nd}.\-eE]"
NUMBER = r"^-?\p{Nd}+(\.\p{Nd}+)?([eE]-?\p{Nd}+)?$"
#: Tokens of JSON: texts (with the colon that makes one a key), numbers and names.
_TOKENS = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?|-?[0-9][0-9.eE+\-]*|true|false|null'


@cache
def _digits() -> tuple[str, str]:
    """Decimal digits of other scripts, and the ASCII ones they stand for."""
    some = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(some), "".join(str(unicodedata.decimal(c)) for c in some)


def _ascii(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_digits())).otherwise(text)


def _trimmed(text: Column) -> Column:
    """A decimal without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: it becomes a variable."""
    return F.transform(F.array(value), use)[0]


def shortest(number: Column) -> Column:
    """A double that isn't whole, as Python writes it: the fewest digits that tell it apart, with an exponent below 0.0001."""

    def written(text: Column) -> Column:
        exponent = F.regexp_replace(F.regexp_extract(text, r"E-(\d+)$", 1), r"^(\d)$", "0$1")
        small = F.concat(F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", ""), F.lit("e-"), exponent)
        return F.when(text == "NaN", "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf").when(F.abs(text.cast("double")) < 1e-4, small).otherwise(_trimmed(text.cast("decimal(38,21)").cast("string")))

    return _let(number.cast("string"), written)


def _whole(number: Column) -> Column:
    return F.when(F.abs(number) < 9.2e18, number.cast("bigint").cast("string")).otherwise(number.cast("decimal(38,0)").cast("string"))


def _is_whole(number: Column) -> Column:
    """Doubles from 2^53 on are."""
    return ~F.isnan(number) & (F.abs(number) < 1e38) & ((F.abs(number) >= 2.0**53) | (number % 1 == 0))


def text_item(text: Column) -> Column:
    """A text as a number if what is left of it reads as one (whole, or to six places), else in lower case."""

    def rounded(n: Column) -> Column:
        sign = F.when(n < 0, "-").otherwise("")
        near = F.when(F.abs(n) < 2.0**33, F.concat(sign, printed(F.abs(n), 6)).cast("double")).otherwise(n)
        return _let(near, lambda r: F.when(r == 0, F.concat(sign, F.lit("0.0"))).when(_is_whole(r), F.concat(_whole(r), F.lit(".0"))).otherwise(shortest(r)))

    def number(digits: Column) -> Column:
        bare = digits
        for sign in (r"\.", "-", "e", "E"):  # the first of each
            bare = F.regexp_replace(bare, rf"^([^{sign}]*){sign}", "$1")
        return F.when((digits != "") & (digits.rlike(NUMBER) | bare.rlike(r"^\p{Nd}+$")), _ascii(digits).try_cast("double"))

    def item(kept: Column) -> Column:
        digits = F.regexp_replace(F.trim(F.replace(kept, F.lit(","), F.lit(""))), NOT_OF_A_NUMBER, "")
        return _let(_let(digits, number), lambda n: F.when(n.isNull(), F.lower(kept)).when(_is_whole(n), _whole(n)).otherwise(rounded(n)))

    return _let(F.regexp_replace(text, BRACES_AND_NAMES, ""), item)


def _json_item(token: Column) -> Column:
    real = _let(token.try_cast("double"), lambda n: F.when(_is_whole(n), _whole(n)).otherwise(shortest(n)))
    return (
        F.when(token.startswith('"'), text_item(F.from_json(F.concat(F.lit('{"a":'), token, F.lit("}")), "a string")["a"]))
        .when(token == "null", "none")
        .when(token.isin("true", "false"), token)
        .when(~token.rlike("[.eE]"), F.regexp_replace(token, "^-0$", "0"))
        .otherwise(real)
    )


def _whole_json(raw: Column) -> Column:
    """The value of a text that is JSON from end to end; null for others, with more after the value too."""
    value = F.try_parse_json(raw)
    marks = F.filter(F.split(F.regexp_replace(F.regexp_replace(raw, _TOKENS, ""), r"[^\[\]{}]", ""), ""), lambda c: c != "")

    def step(seen: Column, c: Column) -> Column:
        depth = seen["depth"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (seen["closed"] + (depth == 0).cast("int")).alias("closed"))

    closed = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed")), step)["closed"]
    nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)") & F.trim(raw).rlike(r"[\]}]$") & (closed == 1)
    return F.when(value.isNull(), None).when(nested | raw.rlike(rf"^\s*(?:{_TOKENS})\s*$"), value)


def answer_text(raw: Column) -> Column:
    """The normalised line of an answer; `none` for null. Of an object with `data`, that counts alone. Whole numbers from 2^63 on are written to 17 digits."""
    value = _whole_json(raw)
    data = F.try_variant_get(value, "$.data", "variant")
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    scalar = F.when(F.is_variant_null(data) | F.schema_of_variant(data).rlike("^(STRING|BOOLEAN)"), F.to_json(data))
    inner = F.when(is_object & data.isNotNull(), F.coalesce(scalar, F.get_json_object(raw, "$.data"))).otherwise(raw)
    tokens = F.filter(F.regexp_extract_all(inner, F.lit(_TOKENS), F.lit(0)), lambda t: ~t.endswith(":"))
    words = F.regexp_extract_all(raw, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    numbers = F.transform(F.filter(words, lambda w: w.rlike(r"^\p{Nd}+$")), text_item)
    items = F.when(value.isNotNull(), F.transform(tokens, _json_item)).otherwise(F.concat(numbers, F.filter(words, lambda w: w.rlike("^[a-zA-Z]+$"))))
    return F.when(raw.isNull(), "none").otherwise(F.lower(F.array_join(items, " ")))
