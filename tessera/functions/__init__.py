"""Scalar functions of the annotated-graph engine, all built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: vocabularies of truth, separators of lists and of layer names
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on", "directed")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off", "undirected")
LIST_SEPARATORS = r"\s*[|;,]\s*"
LAYER_SEPARATOR = "×"
PLACEHOLDER = "_"


def clean(column: Column) -> Column:
    """Trimmed text; empty text is null."""
    text = F.trim(column.cast("string"))
    return F.when(text == "", F.lit(None)).otherwise(text)


def truth(column: Column) -> Column:
    """Boolean of a word, null if it is in neither vocabulary."""
    word = F.lower(F.trim(column.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def words(column: Column) -> Column:
    """Array of a list cell: a JSON array, or parts between bars, semicolons or commas."""
    text = F.trim(column.cast("string"))
    parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, LIST_SEPARATORS))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")  # trim alone would take the index for what to cut off


def layer_id(layer: Column) -> Column:
    return F.array_join(layer, LAYER_SEPARATOR)


def quoted(column: Column) -> Column:
    """Percent-quoting with nothing but letters, digits and _.-~ left as it is."""
    text = F.url_encode(column.cast("string"))
    return F.replace(F.replace(F.replace(text, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def composite_id(fields: dict[str, Column]) -> Column:
    """Identifier of a node that is known by some of its attributes."""
    return F.concat(F.lit("cid:"), F.concat_ws("|", *(F.concat(F.lit(f"{k}="), quoted(v)) for k, v in fields.items())))


def member_key(column: Column) -> Column:
    """Canonical key of a set of members."""
    return F.array_join(F.array_sort(F.array_distinct(column)), "\x01")


def known(column: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(column), column)
