"""Text and token expressions for training rows: instructions, prompts, block shuffles, truncation and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How an instruction and a query are put together, by style.
TEMPLATES = {"lines": "Instruct: %s\nQuery: %s", "joined": "%s%s", "tags": "<instruct>%s\n<query>%s"}


def instructed(style: str, instruction: Column, query: Column) -> Column:
    return F.format_string(TEMPLATES[style], instruction, query)


def first_prompt(*prompts: Column) -> Column:
    """The first prompt that is set, in order of precedence."""
    return F.coalesce(*prompts)


def shuffled_blocks(text: Column, key: Column, pieces: int = 3, least: int = 100) -> Column:
    """Texts of over least characters cut into pieces of equal length (one more than the quotient), which are put together
    with spaces in an order that follows from the key; shorter ones stay as they are."""
    n = F.floor(F.length(text) / pieces).cast("int") + 1
    cut = lambda i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"))).alias("h"), F.substring(text, i * n + 1, n).alias("p"))
    mixed = F.array_join(F.transform(F.sort_array(F.transform(F.array(*map(F.lit, range(pieces))), cut)), lambda x: x["p"]), " ")
    return F.when(F.length(text) > least, mixed).otherwise(text)


def words(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def truncated(tokens: Column, most: int, end: str) -> Column:
    """At most most tokens, the end token being the last of them."""
    return F.concat(F.slice(tokens, 1, most - 1), F.array(F.lit(end)))


def padded(length: Column, multiple: int) -> Column:
    """The length, up to the next multiple."""
    return (F.ceil(length / multiple) * multiple).cast("int")


def micro_batch(cap: int, longest: Column) -> Column:
    """Rows of the longest length that fit under the cap; one at least."""
    return F.greatest(F.floor(F.lit(cap) / longest), F.lit(1).cast("long"))


def unpadded(values: Column, mask: Column) -> Column:
    """Values from the first to the last place that the mask keeps."""
    places = F.filter(F.transform(mask, lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull())
    return F.slice(values, F.array_min(places) + 1, F.array_max(places) - F.array_min(places) + 1)
