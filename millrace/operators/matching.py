"""Fuzzy name matching and prefix joins, without cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GENERIC = r"\b(police department|sheriff.s office|sheriff department|police|sheriff|department|office)\b"


def normalize_name(name: Column) -> Column:
    """Lower case without generic department words, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), _GENERIC, ""), r"\s+", " "))


def tokens(name: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normalize_name(name), " ")), lambda t: t != "")


def fuzzy_match(targets: DataFrame, candidates: DataFrame, least: float = 0.6) -> DataFrame:
    """target_id, candidate_id and overlap: the share of the target's words that the candidate
    has, the best candidate (the first on ties), at least ``least``; ``targets`` (target_id, name),
    ``candidates`` (candidate_id, name), compared by candidate_id for order.

    Names with equal words are one set. A candidate has to have ``must`` of a target's words, so
    of the target's rarest ones (all but ``must - level``) it has ``level``: sets meet by pairs
    of words, or by single words where one is enough. The overlap is computed where they
    meet, and the best of a target is a partial maximum, so pairs aren't gathered.
    """
    t = targets.select("target_id", F.array_sort(tokens(F.col("name"))).alias("ts")).filter(F.size("ts") > 0)
    c = candidates.select("candidate_id", F.array_sort(tokens(F.col("name"))).alias("cs")).filter(F.size("cs") > 0)
    sets = c.groupBy("cs").agg(F.min("candidate_id").alias("candidate_id"))
    wanted = t.groupBy("ts").agg(F.min("target_id").alias("first_id"))
    often = sets.select(F.explode("cs").alias("w")).groupBy("w").agg(F.count("*").alias("often"))
    ranked = wanted.select("first_id", "ts", F.explode("ts").alias("w")).join(often, "w", "left").groupBy("first_id", "ts").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "w"))).alias("ws"))
    must = F.greatest(F.lit(1), F.ceil(F.lit(least) * F.size("ts") - 1e-9)).cast("int")
    level = F.least(must, F.lit(2))
    rare = F.array_sort(F.transform(F.slice("ws", 1, F.size("ts") - must + level), lambda x: x["w"]))
    probes = ranked.select("first_id", "ts", F.explode(F.when(level == 1, rare).otherwise(_word_pairs(rare))).alias("k"))
    keys = sets.select("candidate_id", "cs", F.explode(F.concat("cs", _word_pairs(F.col("cs")))).alias("k"))
    pairs = probes.join(keys, "k").withColumn("overlap", F.size(F.array_intersect("ts", "cs")) / F.size("ts")).filter(F.col("overlap") >= least)
    best = F.max_by(F.struct("candidate_id", "overlap"), F.struct("overlap", -F.col("candidate_id"))).alias("b")
    found = pairs.groupBy("first_id", "ts").agg(best).select("ts", "b.candidate_id", "b.overlap")
    return t.join(found, "ts").select("target_id", "candidate_id", "overlap")


def _word_pairs(words: Column) -> Column:
    """All pairs of the sorted words, as one text each."""
    rest = lambda i: F.slice(words, i + 2, F.size(words))
    return F.flatten(F.transform(words, lambda x, i: F.transform(rest(i), lambda y: F.concat(x, F.lit("\x1f"), y))))


def longest_prefix(name: Column, words: list[str]) -> Column:
    """The longest of ``words`` that the name equals or starts with, before a space."""
    out = F.lit(None).cast("string")
    for w in sorted(words, key=lambda w: (len(w), w)):
        out = F.when((name == w) | name.startswith(w + " "), F.lit(w)).otherwise(out)
    return out


def longest_prefixes(names: DataFrame, key: str, name: str, words: DataFrame) -> DataFrame:
    """``key`` and ``prefix``: the longest word (column ``word`` of ``words``) that a name equals or
    starts with, before a space; null without any. A name's prefixes that end before a space meet the words
    by equality, so words may be any number, and of a name's prefixes the longest is a partial maximum."""
    places = F.filter(F.sequence(F.lit(1), F.length(name) + 1), lambda i: (i > F.length(name)) | (F.col(name).substr(i, F.lit(1)) == " "))
    prefixes = names.select(key, name).distinct().select(key, name, F.explode(F.transform(places, lambda i: F.col(name).substr(F.lit(1), i - 1))).alias("word"))
    # Only prefixes that some word could equal are sent on.
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    met = prefixes.filter(F.length("word").between(1, longest)).join(words.select("word").distinct(), "word")
    best = met.groupBy(key, name).agg(F.max_by("word", F.length("word")).alias("prefix")).select(F.col(key).alias("__key"), F.col(name).alias("__name"), "prefix")
    return names.join(best, F.col(key).eqNullSafe(F.col("__key")) & F.col(name).eqNullSafe(F.col("__name")), "left").select(key, "prefix")
