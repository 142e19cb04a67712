"""Text columns: letters, universal content, terms, and the clean-up of model output."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that mean the same in every language.
OPERATORS = ["+", "-", "*", "/", "=", "<", ">", "≤", "≥", "^"]
SYMBOLS = ["α", "β", "γ", "δ", "σ", "λ", "θ", "μ", "Δ", "Σ", "%", "·"]
MATH_FUNCTIONS = ["sin", "cos", "tan", "log", "exp", "sqrt", "min", "max"]

# Words that are no terms (35 for extraction, 15 while tracking).
STOP_WORDS = [
    "the", "a", "an", "and", "or", "is", "are", "was", "were", "in", "of", "to", "for", "with", "by", "at", "from", "as",
    "on", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can",
    "this", "that",
]
TRACKING_STOP_WORDS = [
    "the", "a", "an", "and", "or", "is", "are", "in", "of", "to", "for", "with", "by", "at", "from",
]


def letter_count(text: Column) -> Column:
    """Number of a-z and A-Z; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, "[^a-zA-Z]", "")), F.lit(0)).cast("bigint")


def universal_count(text: Column) -> Column:
    """Runs of digits, operators, symbols and function names; overlaps count each.

    Names are counted at every place where one begins, as no two begin at the same; a look at two letters spares most places the rest.
    """
    signs = F.regexp_count(text, F.lit("[" + "".join(rf"\{s}" if s.isascii() else s for s in OPERATORS + SYMBOLS) + "]"))
    begin, follow = ("".join(sorted({n[k] for n in MATH_FUNCTIONS})) for k in (0, 1))
    names = F.regexp_count(F.lower(text), F.lit(f"(?=[{begin}][{follow}])(?={'|'.join(MATH_FUNCTIONS)})"))
    return (F.regexp_count(text, F.lit(r"\d+\.?\d*")) + signs + names).cast("bigint")


def words(text: Column) -> Column:
    """Words of a-z and _ alone, as they stand between other letters, digits and underscores."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-z_]+$"))


def phrases(text: Column) -> Column:
    """Runs of two or three words of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\b[a-z]+\s+[a-z]+(?:\s+[a-z]+)?\b)"), 1)


def is_term(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(STOP_WORDS)


def tokens(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def strip_fence(text: Column) -> Column:
    """What a Markdown code fence holds, or the text itself."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


# Fixed value: what closes a model's thoughts.
THOUGHT_END = "</think>"


def response_answer(text: Column) -> Column:
    """The `data` of a model's JSON answer, given alone or after its last thought, else the whole raw response as a single cell."""
    answers = [F.from_json(strip_fence(x), "data array<array<string>>")["data"] for x in (text, F.trim(F.substring_index(text, THOUGHT_END, -1)))]
    return F.coalesce(*answers, F.array(F.array(text)))


def safe_name(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))


def printed(number: Column, places: int) -> Column:
    """A number of at least 0 and below 2^33 with so many places, as C and Python print it: its exact binary value, rounded half to even.

    The number is an integer over a power of two, so the rest of an integer division tells which side of a half it is on.
    """
    scales = [(1.0, 62), (2.0**11, 52), (2.0**22, 41), (2.0**33, 30)]  # below the first, at this power the value fits 63 bits and what is cut off can't decide
    power = reduce(lambda rest, s: F.when(number < s[0], F.lit(1 << s[1]).cast("decimal(38,0)")).otherwise(rest), reversed(scales), F.lit(None).cast("decimal(38,0)"))
    whole = reduce(lambda rest, s: F.when(number < s[0], F.floor(number * float(1 << s[1]))).otherwise(rest), reversed(scales), F.lit(None).cast("long")).cast("decimal(38,0)")
    parts = F.struct((whole * F.lit(10**places).cast("decimal(10,0)")).cast("decimal(38,0)").alias("n"), power.alias("p"))

    def rounded(x: Column) -> Column:
        low = F.floor(x["n"] / x["p"]).cast("decimal(20,0)")  # may be one too many where the quotient is rounded up
        low = F.when(low * x["p"] > x["n"], low - 1).otherwise(low)
        rest = (x["n"] - low * x["p"]) * 2
        up = (rest > x["p"]) | ((rest == x["p"]) & (low % 2 == 1))
        value = (low + F.when(up, 1).otherwise(0)).cast("long").cast("string")
        digits = F.when(F.length(value) > places, value).otherwise(F.lpad(value, places + 1, "0"))
        return F.concat(F.substr(digits, F.lit(1), F.length(digits) - places), F.lit("."), F.right(digits, F.lit(places))) if places else digits

    return F.transform(F.array(parts), rounded)[0]  # an array of one, so that the parts are computed once
