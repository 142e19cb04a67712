"""Cells of tables: kinds, translatability, gates, coordinates."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import scanner
from .text import letter_count

# Terms that keep, or lose, their meaning in translation, before any are learnt.
TRANSLATABLE = [
    "portfolio", "strategy", "return", "risk", "price", "value", "investment", "asset", "performance", "ratio", "metric",
    "comparison", "equal", "contribution", "distance", "similarity", "probability", "distribution", "optimization",
    "minimization", "maximization", "cost", "loss", "gain", "change", "increase", "decrease", "model", "prediction",
    "forecast", "trend", "pattern", "cluster", "classification", "regression", "analysis", "method", "algorithm",
    "accuracy", "precision", "recall", "f1", "score", "rate", "time", "dataset", "evaluation", "benchmark", "result",
    "parameter", "coefficient", "variable", "feature", "input", "output", "mean", "standard", "deviation", "average",
    "median", "variance", "correlation", "relationship", "difference", "weapon", "shotgun", "smg", "knife", "handgun",
    "sniper", "sword", "grenade", "launcher", "bazooka", "rifle", "automatic", "drug", "val", "defense", "training",
    "krav", "magma", "billete",
]
UNTRANSLATABLE = [
    "logistic regression", "neural network", "support vector", "decision tree", "activation function", "neuron", "layer",
    "kernel", "backpropagation", "gradient descent", "epoch", "batch", "overfitting", "pretrained llm", "bloom", "gpt",
    "llm", "token", "finetuning", "pretraining", "embedding", "attention", "transformer", "lstm", "rnn", "cnn", "gan",
    "vae", "bert", "roberta", "xlnet", "electra", "autoencoder", "boltzmann", "hopfield", "perceptron", "convolution",
]
# Endings that mark a file.
FILE_ENDINGS = ["json", "csv", "xlsx", "jpeg", "jpg", "png", "gif", "txt"]


def typed(value: Column) -> tuple[Column, Column]:
    """Texts and kinds of rows of JSON cells (an array of arrays of VARIANT). A kind is `text`, `number` (booleans too) or, for nested values, `other`; null for null."""

    def kind(v: Column) -> Column:
        of = F.schema_of_variant(v)
        return F.when(of.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|BOOLEAN)"), "number").when(of == "STRING", "text").when(of.isNotNull() & (of != "VOID"), "other")

    each = lambda f: F.transform(value, lambda row: F.transform(row, f))
    return each(lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.when(~F.is_variant_null(v), F.to_json(v)))), each(kind)


def is_numeric(cell: Column, kind: Column | None = None) -> Column:
    """Digits alone (or one of four short forms); a cell that was a number or a boolean in its file, whatever its text."""
    text = cell.rlike(r"^\p{Nd}+$") | cell.isin("0", "1", "0.0", "1.0")
    return text if kind is None else F.coalesce(kind == "number", F.lit(False)) | text


def is_path(cell: Column) -> Column:
    return cell.contains("/") | cell.contains("\\") | cell.rlike(rf"\.({'|'.join(FILE_ENDINGS)})$")


def has_untranslatable(cell: Column, terms: list[str] = UNTRANSLATABLE) -> Column:
    """Whether any term stands anywhere in the lower-cased text, within words too."""
    low = F.lower(cell)
    return reduce(lambda a, b: a | b, (low.contains(t) for t in terms), F.lit(False))


def translatability(cell: Column, terms: list[str] = UNTRANSLATABLE, kind: Column | None = None, found: Column | None = None) -> Column:
    """(score, reason) of a cell. Numbers and booleans are numeric, null and other cells that are no text universal; without kinds every cell is a text.

    found: what terms.scanner() gives for the cell, where it is there already (as for a dictionary that is a frame, or within a lambda).
    """
    found = scanner(terms)(cell) if found is None else found
    last = F.element_at(F.split(cell, "/"), -1)

    def out(score: float, reason: str) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))

    return (
        F.when(cell.isNull() if kind is None else cell.isNull() | (kind == "other"), out(1.0, "non_string_universal"))
        .when(is_numeric(cell, kind), out(1.0, "numeric_universal"))
        .when(is_path(cell), F.when(found["last"] >= F.length(last) * 0.3, out(0.95, "file_path_mostly_universal")).otherwise(out(0.85, "file_path_with_content")))
        .when(found["hit"].isNotNull(), out(0.0, "untranslatable_label"))
        .when(found["universal"] >= F.length(cell) * 0.5, out(1.0, "mostly_universal"))
        .otherwise(out(0.9, "translatable_text"))
    )


def has_missing(data: Column, blank: bool = False) -> Column:
    """Whether any cell is null or NaN (or, if blank, empty); false where there is no data."""
    missing = lambda c: c.isNull() | (c == "NaN") | ((F.trim(c) == "") if blank else F.lit(False))
    return F.coalesce(F.exists(data, lambda r: F.exists(r, missing)), F.lit(False))


def null_count(data: Column) -> Column:
    return F.coalesce(F.aggregate(F.transform(data, lambda r: F.size(F.filter(r, lambda c: c.isNull()))), F.lit(0), lambda a, x: a + x), F.lit(0))


def table_letters(data: Column) -> Column:
    """Letters of all cells; null and NaN hold none."""
    cells = F.filter(F.flatten(data), lambda c: c.isNotNull() & (c != "NaN"))
    return letter_count(F.array_join(cells, " "))


def dimension(rows: Column) -> Column:
    return F.coalesce(F.size(rows), F.lit(0)).cast("bigint")


def quality_gate(columns: Column, data: Column, min_rows: int = 3, min_columns: int = 3, max_nulls: float = 0.8) -> Column:
    """At least so many rows and columns, and at most that share of nulls; an empty string is no null."""
    cells = dimension(data) * dimension(columns)
    return (dimension(data) >= min_rows) & (dimension(columns) >= min_columns) & (null_count(data) / F.greatest(cells, F.lit(1)) <= max_nulls)


def code_host_gate(columns: Column, data: Column) -> Column:
    """The gate of tables from code hosts: two by two, at most half of the headers unnamed, not all null."""
    unnamed = F.size(F.filter(columns, lambda c: c.startswith("Unnamed")))
    return (dimension(data) >= 2) & (dimension(columns) >= 2) & (unnamed <= F.size(columns) * 0.5) & (null_count(data) < dimension(data) * dimension(columns))


def content_digest(data: Column) -> Column:
    """A hash of the rows; headers have no part in it."""
    return F.sha2(F.to_json(data), 256)


def content_hash(data: Column) -> Column:
    """Its first ten hex digits, for names."""
    return F.substring(content_digest(data), 1, 10)


def cell_name(row: Column, col: Column) -> Column:
    """Element id of a data cell, counted from 0."""
    return F.format_string("cell-r%d-c%d", row, col)


def coordinate_column(ref: Column) -> Column:
    """Column index, from 0, of a spreadsheet reference such as AB12."""
    letters = F.split(F.regexp_extract(ref, r"^([A-Z]+)\d+$", 1), "")
    return (F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1).cast("int")


def coordinate_row(ref: Column) -> Column:
    """Data row index, from 0; the header is no data row."""
    return (F.regexp_extract(ref, r"^[A-Z]+(\d+)$", 1).cast("int") - 1).cast("int")
