"""Document classification by priors, address signals and keywords, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .detect import first_match

SIGNAL = "struct<type:string,boost:double>"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once; a plain column would be copied at each use."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def legacy_type(document_type: Column) -> Column:
    return F.coalesce(first_match([(document_type == a, b) for a, b in K.LEGACY_TYPES.items()], None), document_type)


def _signal(kind: str, boost: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), boost.cast("double").alias("boost")).cast(SIGNAL)


def url_signal(url: Column) -> Column:
    """Type and boost of the first pattern that the lower-cased address holds, or null."""
    out, u = F.lit(None).cast(SIGNAL), F.lower(url)
    for pattern, kind, boost in reversed(K.URL_SIGNALS):
        out = F.when(u.rlike(pattern), _signal(kind, F.lit(boost))).otherwise(out)
    return out


def keyword_signal(title: Column, text: Column) -> Column:
    """Type with the most distinct keywords (three at most count; the earlier on ties)."""
    t = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 300)))

    def best(n: Column) -> Column:
        most, out = F.array_max(n), F.lit(None).cast(SIGNAL)
        for i, kind in reversed(list(enumerate(K.KEYWORDS))):
            out = F.when((most > 0) & (n[i] == most), _signal(kind, n[i] * 0.1)).otherwise(out)
        return out

    def counts(t: Column) -> Column:
        return F.array(*(F.least(sum((t.contains(w).cast("int") for w in words), F.lit(0)), F.lit(3)) for words in K.KEYWORDS.values()))

    return let(let(t, counts), best)


def classify(document_type: Column, url: Column, title: Column, text: Column, platform: Column) -> Column:
    """Struct of type and confidence (rounded to six places)."""
    p = F.lower(platform)
    prior_type = first_match([(p == k, v[0]) for k, v in K.PLATFORM_PRIORS.items()], None)
    prior = F.lit(None).cast("double")
    for k, (_, confidence) in K.PLATFORM_PRIORS.items():
        prior = F.when(p == k, F.lit(confidence)).otherwise(prior)
    seen = F.struct(url_signal(url).alias("u"), keyword_signal(title, text).alias("w"), prior_type.alias("type"), prior.alias("prior"), legacy_type(document_type).alias("legacy"))

    def result(kind: Column, confidence: Column) -> Column:
        return F.struct(kind.alias("type"), F.round(F.least(confidence, F.lit(1.0)), 6).alias("confidence"))

    def decide(s: Column) -> Column:
        u, w, base = s["u"], s["w"], F.coalesce(s["prior"], F.lit(0.5))
        both = u.isNotNull() & w.isNotNull()
        return (
            F.when(s["prior"] >= 0.9, result(s["type"], s["prior"]))
            .when(both & (u["type"] == w["type"]), result(u["type"], base + u["boost"] + w["boost"]))
            .when(both & (w["boost"] < u["boost"]), result(u["type"], base + u["boost"]))
            .when(w.isNotNull(), result(w["type"], base + w["boost"]))
            .when(u.isNotNull(), result(u["type"], base + u["boost"]))
            .when(s["type"].isNotNull(), result(s["type"], s["prior"]))
            .when(s["legacy"].isin(*K.VALID_TYPES), result(s["legacy"], F.lit(0.55)))
            .otherwise(result(F.lit("press_release"), F.lit(0.4)))
        )

    return let(seen, decide)
