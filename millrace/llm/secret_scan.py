"""Secret scans by multipart credential linking, in native expressions only.

Base kinds are found on their own. Weaker candidates (identifiers such as user names, short
or oddly named secrets, endpoints) say little alone, so they are interval-joined inside a
scope around each other: a weak secret is reported when an identifier or access key lies in
its scope, an identifier when a weak or base secret does, an endpoint when both do. Scopes
never leave a document, so the join is one over a row's arrays and nothing is shuffled.

The join is a sweep: parts are sorted by start, and one fold in each direction carries the
access part and the secret that reach furthest. A part's partner is the one before it that ends
last, if that ends in its scope, else the next one after it, if that starts there. ``links`` has
a row for each reported part and partner.

Spark has no function for match positions: a match starts behind all pieces between matches
and all matches before it, and ``split`` and ``regexp_extract_all`` give both.

Defined cases: a null or empty text has no spans; rows with equal ids are scanned each, equal
rows too; parts that start together are in the order of their kinds; positions are code points,
the end exclusive; a text is scanned whole in time that grows with it (and with the square
root of its spans, where they are masked); an empty table gives no rows; other columns are kept
by ``scan`` unless they carry a name of its output (base, spans, links), which replaces them;
``redact`` keeps all columns, ``digests`` ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, pieces, running
from .shared import fresh

SCOPE = 200
ASSIGN_VALUE = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that fails its length leaves no other match inside it, so these may ask for it at once.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Names in either case, also behind an underscore (DB_USER, AWS_SECRET_ACCESS_KEY).
IDENTIFIER = r"""(?<![A-Za-z0-9])(?i:user(?:name)?|login|client_id|access_key_id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK = r"""(?:(?<![A-Za-z0-9])(?i:pwd|pass|pw|credential|auth|secret_access_key|private_key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=]))"""
ENDPOINT = r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>]{4,}"""
KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")


SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
PART = "struct<start:int,rank:int,end:int,kind:string>"
LINKS = f"array<struct<part:{PART},partner:{PART}>>"
STATE = f"struct<access:{PART},secret:{PART}>"


def _spans(text: Column, kind: str, pattern: str, value: str | None = None) -> Column:
    """Array of (start, rank, end, kind) of leftmost non-overlapping matches; ``value``: a
    pattern of which a match must have an occurrence."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    rank = KINDS.index(kind)

    def step(before: Column, pair: Column) -> Column:
        start = before["end"] + F.length(pair["p"])
        return F.struct(start.alias("start"), (start + F.length(pair["m"])).alias("end"))

    pairs = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("p"), found.alias("m"))
    bounds = running(pairs, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")), step, "struct<start:int,end:int>")
    if value:
        kept = F.filter(F.arrays_zip(bounds.alias("s"), found.alias("m")), lambda x: F.regexp_like(x["m"], F.lit(value)))
        bounds = F.transform(kept, lambda x: x["s"])
    spans = F.transform(bounds, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def _is(part: Column, *kinds: str) -> Column:
    return part["rank"].isin(*(KINDS.index(k) for k in kinds))


def _access(part: Column) -> Column:
    return _is(part, "access", "identifier")


def _secret(part: Column) -> Column:
    return _is(part, "assign", "weak")


def _linked(parts: Column, scope: int) -> Column:
    """Of sorted parts, in order: the part, and the access part and the secret near it (or null)."""
    none = F.struct(F.lit(None).cast(PART).alias("access"), F.lit(None).cast(PART).alias("secret"))

    def further(state: Column, part: Column) -> Column:
        later = lambda old, of: F.when(of(part) & (old.isNull() | (part["end"] >= old["end"])), part).otherwise(old)
        return F.struct(later(state["access"], _access).alias("access"), later(state["secret"], _secret).alias("secret"))

    def nearer(state: Column, part: Column) -> Column:
        return F.struct(F.when(_access(part), part).otherwise(state["access"]).alias("access"), F.when(_secret(part), part).otherwise(state["secret"]).alias("secret"))

    def near(x: Column, name: str) -> Column:
        before, after = x["before"][name], x["after"][name]
        return F.when(before["end"] > x["part"]["start"] - scope, before).when(after["start"] < x["part"]["end"] + scope, after).alias(name)

    before, after = running(parts, none, further, STATE), F.reverse(running(F.reverse(parts), none, nearer, STATE))
    both = F.arrays_zip(parts.alias("part"), before.alias("before"), after.alias("after"))
    return F.transform(both, lambda x: F.struct(x["part"].alias("part"), near(x, "access"), near(x, "secret")))


def _told(x: Column) -> Column:
    weak, told, end = (_is(x["part"], k) for k in ("weak", "identifier", "endpoint"))
    access, secret = x["access"].isNotNull(), x["secret"].isNotNull()
    return F.when(weak, access).when(told, secret).when(end, access & secret).otherwise(True)


def _links(x: Column) -> Column:
    """The pairs of a reported part; a base part has none of its own."""
    weak, told, end = (_is(x["part"], k) for k in ("weak", "identifier", "endpoint"))
    pair = lambda name: F.struct(x["part"].alias("part"), x[name].alias("partner"))
    return F.when(weak, F.array(pair("access"))).when(told, F.array(pair("secret"))).when(end, F.array(pair("access"), pair("secret"))).otherwise(F.array().cast(LINKS))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, end, kind) in order; and
    ``links``: an array of each reported part with a partner that it was reported for."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [n for n in docs.columns if n not in ("base", "spans", "links")]
    a, k, h, i, w, e = names = fresh(docs, "__assign", "__access", "__hex", "__identifier", "__weak", "__endpoint")
    patterns = (ASSIGN, ACCESS, HEX, IDENTIFIER, WEAK, ENDPOINT)
    values = (ASSIGN_VALUE, None, None, None, None, None)
    found = docs.select(*kept, *(_spans(text, kind, p, v).alias(n) for kind, p, v, n in zip(KINDS, patterns, values, names, strict=True)))
    base = F.array_sort(F.concat(a, k, h))
    (near,) = fresh(found, "__near")
    # Base parts of the hex kind link nothing, so they stay out of the sweep.
    linked = F.filter(_linked(F.array_sort(F.concat(a, k, i, w, e)), scope), _told)
    some = F.size(i) + F.size(w) + F.size(e) > 0
    swept = found.select(*kept, base.alias("base"), F.col(h), F.when(some, linked).alias(near))
    spans = F.when(F.col(near).isNull(), F.col("base")).otherwise(F.array_sort(F.concat(F.transform(near, lambda x: x["part"]), h)))
    links = F.when(F.col(near).isNull(), F.array().cast(LINKS)).otherwise(F.flatten(F.transform(near, _links)))
    return swept.select(*kept, "base", spans.alias("spans"), links.alias("links"))


def _named(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, _named), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with its sorted spans (one at least) replaced by ``mask``, overlapping ones as one."""

    def cut(own: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), own)  # the furthest end before each span
        gaps = F.transform(F.filter(F.arrays_zip(F.slice(starts, 1, F.size(own)).alias("a"), spans.alias("s")), lambda x: x["s"]["start"] >= x["a"]), lambda x: F.struct(x["a"].alias("a"), x["s"]["start"].alias("b")))
        return F.concat(F.array_join(pieces(text, gaps), mask), F.lit(mask), F.substring(text, F.element_at(own, -1) + 1, F.length(text)))

    return let(running(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), "int"), cut)


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mask``; overlapping spans as one."""
    found = scan(docs.select(F.struct(*docs.columns).alias("row"), "text"), scope)
    text = F.col("text")
    new = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(masked(text, F.col("spans"), mask))
    return found.select(*(new.alias(n) if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    links = F.array_join(F.transform("links", lambda x: F.concat(_named(x["part"]), F.lit(">"), _named(x["partner"]))), ",")
    told = joined(F.col("spans")).alias("spans")
    return scan(docs.select("doc_id", "text")).select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), told, links.alias("links"))
