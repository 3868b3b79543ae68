"""Quality rules by host: document rules, failure rates of each host shrunk by a beta prior, verdicts joined back.

DataFrame functions only. A document fails by its own text (base_failed); a host is rejected if its shrunk failure rate is
above a limit, and takes its documents along. The beta prior is fitted to the hosts' rates by their mean and variance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.groups import join_groups
from quern.session import materialise

SPACE = "[\\x20\\x09-\\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_HOST_RATE = 50, 50, 0.5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: windows sorted with their places, equal neighbours kept.

    Places in text order then count what each window adds, up to 3 words.
    """

    def placed(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.sort_array(hashed)

    def marked(p: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(3), i - a["last"])).alias("total")), lambda a: a["total"])

    return _let(words, lambda w: _let(placed(w), lambda p: covered(marked(p))))


def with_measures(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. Null text: no words.

    Columns of docs with one of these names are replaced; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_repeated(w)).alias("n_repeat_words"))

    out = docs.withColumn("__words", _let(_words(text), of_words)).withColumns({
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    out = out.withColumns({"n_words": F.col("__words.n_words"), "word_chars": F.col("__words.word_chars"), "n_repeat_words": F.col("__words.n_repeat_words")})
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.drop("__words")


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_kept): rates shrunk by the beta prior of the hosts' means and variance.

    With rates r, mean m and variance v between hosts, the prior's weight is m (1 - m) / v - 1, from 1 to 10,000; where
    hosts don't vary it is 10,000. A null host is a host of its own.
    """
    rates = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    prior = rates.agg(F.avg(F.col("host_failed") / F.col("host_docs")).alias("m"), F.var_pop(F.col("host_failed") / F.col("host_docs")).alias("v"))
    weight = F.when(F.col("v") > 0, F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(1e4)
    prior = prior.select("m", weight.alias("w"))
    out = rates.join(F.broadcast(prior))  # one row
    out = out.withColumn("host_rate", (F.col("host_failed") + F.col("m") * F.col("w")) / (F.col("host_docs") + F.col("w")))
    return out.select("host", "host_docs", "host_failed", "host_rate", (F.col("host_rate") <= MAX_HOST_RATE).alias("host_kept"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate) of each row.

    Null texts have no words and so fail; a null host is one of its own; rows that repeat count each; an empty table gives an
    empty result; further columns of docs are not read.
    """
    rows = docs.select("doc_id", F.col(host).alias("__host"), "text")
    rows = materialise(with_measures(rows).drop("text"), "measures")
    verdicts = materialise(host_verdicts(rows, "__host"), "hosts")
    out = join_groups(rows, verdicts, [("__host", "host")], "host_docs")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), F.round("host_rate", 6).alias("host_rate"))


def keep(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs whose text and host pass, with the columns of docs, whatever their names.

    Nulls, repeated rows and an empty table are taken as by judge: a row with a null or empty text fails. Each text is
    measured once: rows that pass by themselves are written with their host, and the hosts' verdicts joined to them.
    """
    rows = with_measures(docs.select(F.struct(*docs.columns).alias("__row"), F.col(host).alias("__host"), "text"))
    rows = materialise(rows.select(F.when(~F.col("base_failed"), F.col("__row")).alias("__row"), "__host", "base_failed"), "judged")
    verdicts = materialise(host_verdicts(rows, "__host"), "hosts")
    out = join_groups(rows.where(~F.col("base_failed")).select("__row", "__host"), verdicts, [("__host", "host")], "host_docs")
    return out.where("host_kept").select("__row.*")
