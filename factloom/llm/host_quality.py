"""Host-level quality rules with an empirical beta prior.

Each document is tested by the rules; a host's failures are then counted over
all its documents, in Spark, and its failure rate is shrunk towards the rates of
all hosts: with a beta prior fitted to them by moments, a host with few
documents stays near the mean and one with many near its own rate.  A host is bad
if its rate exceeds twice the prior's mean, or ``max_rate`` if that is less, with
a posterior chance of 0.95.  The verdicts are joined back to the documents, so good
documents of bad hosts go too.

One scan evaluates the rules inside code generation.  The flags, a few bytes a
document, are written to the shared folder; counting and joining read them
instead of the texts.  Counting combines before the shuffle, so a hot host costs
no more than others, and the host table is joined by whatever strategy its
written size suggests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialize

#: A host's rate is too high above MAX_RATE, or above TIMES the prior's mean, if the posterior is SURE standard deviations beyond it.
MAX_RATE, TIMES, SURE = 0.5, 2.0, 1.645
_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def rule_flags(text: Column) -> dict[str, Column]:
    """The rules: true where a text fails.  A short text fails none for being short."""
    size = F.octet_length(text)
    words = F.regexp_count(text, F.lit("[^ \\t\\n\\r]+"))
    letters = F.octet_length(F.regexp_replace(text, F.lit("[ -@\\[-`{-~\\t\\n\\r]+"), F.lit("")))
    capitals = size - F.octet_length(F.regexp_replace(text, F.lit("[A-Z]+"), F.lit("")))
    symbols = size - F.octet_length(F.regexp_replace(text, F.lit("[#$%&*|!<>{}\\\\^~=_]+"), F.lit("")))
    repeats = F.regexp_count(text, F.lit("(?<![^ \\n])([^ \\n]+)[ \\n]\\1(?![^ \\n])"))
    some = words > 0
    return {
        "no_words": words < 1,
        "long_words": some & (size > 20 * words),
        "few_letters": some & (letters * 10 < size * 6),
        "capitals": some & (capitals * 10 > size * 3),
        "symbols": some & (symbols * 20 > size),
        "repeats": some & (repeats * 10 > words * 2),
    }


def flag_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, host, failed): failed has bit k set where rule k fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    failed = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(rule_flags(text).values())), F.lit(0))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    url = F.regexp_extract(source, _URL, 1)
    host = F.when(url != "", F.lower(url)).otherwise(source)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), failed.cast("int").alias("failed"))


def host_verdicts(flags: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, host_docs, host_failures, host_rate, host_ok): shrunk failure rates of hosts.

    A document fails if any rule does.  With mean m and variance v of the hosts'
    rates, and w the mean sampling variance m (1 - m) / n that v holds by chance,
    the prior is Beta(m s, (1 - m) s), s = m (1 - m) / max(v - w, 1e-6) - 1, kept
    within 1 to 10,000.  A single host, or equal rates, give the strongest prior.
    host_ok is false if the posterior mean less ``SURE`` posterior standard
    deviations is above ``max_rate`` or above ``TIMES`` m, whichever is less; a
    rate that just reaches it is good enough.
    """
    hosts = flags.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum((F.col("failed") > 0).cast("long")).alias("host_failures"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("host_failures") / F.col("host_docs")
    m = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(F.lit(1.0) / F.col("host_docs")).alias("u"))
    spread = F.col("m") * (1 - F.col("m"))
    strength = F.least(F.greatest(spread / F.greatest(F.col("v") - spread * F.col("u"), F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(10000.0))
    prior = m.select("m", strength.alias("s"))
    # the prior is a single row
    shrunk = (F.col("host_failures") + F.col("m") * F.col("s")) / (F.col("host_docs") + F.col("s"))
    surely = shrunk - SURE * F.sqrt(shrunk * (1 - shrunk) / (F.col("host_docs") + F.col("s") + 1))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "host_docs", "host_failures", F.round(shrunk, 6).alias("host_rate"), (surely <= F.least(F.lit(max_rate), TIMES * F.col("m"))).alias("host_ok"))


def judge_documents(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, host, failed, host_docs, host_failures, host_rate, host_ok), a row for each document row.

    The host is that of the URL in the column ``source``, lower-cased, or the whole
    value where that is no URL; null and empty ones are one host, ''.
    Null texts count as empty and fail no_words.  Rows count as often as they
    occur, also with a null or repeated doc_id.  Texts of any length are tested
    whole; other columns are ignored; an empty table gives an empty result.
    """
    flags = materialize(flag_documents(docs), "flags")
    return flags.join(host_verdicts(flags, max_rate), "host").select("doc_id", "host", "failed", "host_docs", "host_failures", "host_rate", "host_ok")


def keep_by_rules(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``judge_documents`` that stay: of hosts that are good enough, and failing no rule themselves.

    Null, empty, repeated and very long rows are judged as in ``judge_documents``;
    null and empty texts fail a rule and go; an empty table stays empty.
    """
    return judge_documents(docs, max_rate).where("host_ok and failed = 0").drop("host_ok")
