"""Text cleaning. Rule chains and entities are native; markup and near-equal sentences need Python
and run as Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
from array import array
from difflib import SequenceMatcher
from html.entities import html5

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship_package

from . import constants as K
from .classify import let

NEAR = 0.85


def strip_html(text: Column) -> Column:
    from millrace.sources.html import plain_text

    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else plain_text(t))

    return run(text)


def _odd_characters() -> dict[str, str]:
    """Characters that numbers stand for otherwise than by their code: those of a one-byte page that browsers
    read there, and the one for what is none."""
    out = {"0": "\ufffd"}
    for n in range(0x80, 0xA0):
        try:
            out[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(n)] = chr(n)
    return out


def _table(values: dict[str, str]) -> Column:
    """A constant map; one literal, however many entries it has."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _character(n: Column) -> Column:
    """The character of a number, nothing for controls and codes that are never characters."""
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    plain = F.when(n == 0xFEFF, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    none = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.coalesce(F.try_element_at(_table(_odd_characters()), n.cast("string")), F.when(none, F.lit("\ufffd")).when(control, F.lit("")).otherwise(plain))


def unescape(text: Column) -> Column:
    """Character references as characters: numbers, names, and the old names that need no semicolon, of
    which the longest counts."""
    by_first: dict[str, dict[str, str]] = {}
    for n, c in html5.items():
        by_first.setdefault(n[0], {})[n] = c
    table = F.from_json(F.lit(json.dumps(by_first)), "map<string,map<string,string>>")

    def decoded(piece: Column) -> Column:
        """What follows an ampersand."""
        number = F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        digits = F.regexp_replace(F.regexp_replace(number, "^#[xX]?0*|;$", ""), "^$", "0")
        is_hex = number.rlike("^#[xX]")
        # More digits than any character's code has are none.
        value = F.when(is_hex, F.when(F.length(digits) <= 8, F.conv(digits, 16, 10))).otherwise(F.when(F.length(digits) <= 8, digits)).cast("long")
        name = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)

        def named(x: Column) -> Column:
            """The name and the names that begin like it."""
            name, names = x["name"], x["names"]
            prefixes = F.transform(F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1)), lambda n: name.substr(F.lit(1), n))
            prefix = F.when(F.length(name) > 2, F.get(F.filter(prefixes, lambda x: F.try_element_at(names, x).isNotNull()), F.lit(0)))
            known = F.when(F.try_element_at(names, name).isNotNull(), name).otherwise(prefix)
            return let(known, lambda k: F.when(k.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(F.try_element_at(names, k), piece.substr(F.length(k) + 1, F.length(piece)))))

        by_name = let(F.struct(name.alias("name"), F.try_element_at(table, name.substr(1, 1)).alias("names")), named)
        by_number = F.concat(let(value, _character), piece.substr(F.length(number) + 1, F.length(piece)))
        return F.when(number != "", by_number).otherwise(by_name)

    pieces = F.split(text, "&", -1)
    return F.when(text.contains("&"), F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))).otherwise(text)


#: Characters below which sentences share too few runs of three; kept sentences below which none are listed.
SHORT, FEW = 24, 64


class _Kept:
    """Sentences that were kept, and which of them may be nearly equal to a new one.

    Where 2 M of T characters match (M in blocks that are in order, of T in both sentences), the blocks are
    one more than the unmatched characters at most, so they share at least M - 2 (T - 2 M + 1) runs of three
    characters. Kept sentences are listed by those runs, and a new one counts its own in the lists. Short
    ones share too few: they lie by length. Of all these counts of characters leave those that have M in
    common at all, and the longest common subsequence those that have them in order."""

    def __init__(self, near: float):
        self.near = near
        self.places: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = array("q")
        self.counts = np.zeros((64, 64), np.int32)
        self.codes: list[np.ndarray] = []
        self.listed = 0  # sentences that the lists below hold
        self.lists: dict[int, array] = {}
        self.by_size: dict[int, array] = {}

    def add(self, text: str, codes: np.ndarray) -> None:
        n = len(self.texts)
        if n == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[n] = _counts(codes)
        self.places.setdefault(text, n)
        self.texts.append(text)
        self.sizes.append(len(text))
        self.codes.append(codes)

    def _list(self) -> None:
        for n in range(self.listed, len(self.texts)):
            codes, self.codes[n] = self.codes[n], None
            self.by_size.setdefault(len(self.texts[n]), array("q")).append(n)
            for run in _runs_of_three(codes).tolist():
                self.lists.setdefault(run, array("q")).append(n)
        self.listed = len(self.texts)

    def candidates(self, text: str, codes: np.ndarray) -> list[int]:
        n, sizes = len(text), np.frombuffer(self.sizes, np.int64)
        if len(sizes) < FEW:
            who = np.arange(len(sizes))
        elif self._list() or n < SHORT:
            low, high = int(n * self.near / (2 - self.near)), int(n * (2 - self.near) / self.near) + 1
            lists = [np.frombuffer(self.by_size[k], np.int64) for k in range(low, high + 1) if k in self.by_size]
            who = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        else:
            lists = [np.frombuffer(own, np.int64) for r in np.unique(_runs_of_three(codes)).tolist() if (own := self.lists.get(r)) is not None]
            shared = np.bincount(np.concatenate(lists), minlength=len(sizes)) if lists else np.zeros(len(sizes), np.int64)
            total = sizes + n
            matched = np.ceil(self.near * total / 2 - 1e-9)
            who = np.flatnonzero((np.minimum(sizes, n) >= matched) & (shared >= matched - 2 * (total - 2 * matched + 1)))
        who = who[2 * np.minimum(self.counts[who], _counts(codes)).sum(1) >= self.near * (sizes[who] + n) - 1e-9]
        if not len(who):
            return []
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return [i for i in who.tolist() if 2 * _common(masks, n, self.texts[i]) >= self.near * (len(self.texts[i]) + n) - 1e-9]


def _common(masks: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a text, given by its characters' places, and another."""
    full = left = (1 << n) - 1
    get = masks.get
    for c in other:
        if own := left & get(c, 0):
            left = (left + own | left - own) & full
    return n - left.bit_count()


def _runs_of_three(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def _counts(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes & 63, minlength=64)


def distinct_sentences(text: str, near: float = NEAR) -> str:
    """Keeps each sentence that is not nearly equal to one kept before; blank lines between. A ratio is
    computed only for kept sentences that have enough in common with the new one."""
    kept: list[str] = []
    held = _Kept(near)
    alike = lambda new, i: SequenceMatcher(None, new, held.texts[i]).ratio() >= near
    for part in map(str.strip, re.split(r"(?<=[.!?])\s+(?=[A-Z])|\n{2,}", text)):
        if not part:
            continue
        new = part.lower()
        if new in held.places and alike(new, held.places[new]):
            continue
        codes = np.frombuffer(new.encode("utf-32-le", "surrogatepass"), "<u4")
        if any(alike(new, i) for i in held.candidates(new, codes)):
            continue
        held.add(new, codes)
        kept.append(part)
    return "\n\n".join(kept)


def dedup_sentences(text: Column) -> Column:
    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else distinct_sentences(t))

    return run(text)


def join_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def _java(pattern: str, ignore_case: bool) -> str:
    return ("(?idsuU)" if ignore_case else "(?dsuU)") + pattern


def protected(line: Column) -> Column:
    """Lines with an identifier, address, date or phone number."""
    return line.rlike("|".join(f"(?:{_java(p, i)})" for p, i in K.PROTECTED))


def _without_rules(line: Column, rules) -> Column:
    for pattern, ignore_case in rules:
        if pattern.startswith("^"):
            line = F.regexp_replace(line, _java(pattern + ".*$", ignore_case), "")
        else:
            line = F.regexp_replace(line, _java(pattern, ignore_case), " ")
    return line


def _may_match(text: Column, name: str) -> Column:
    """Whether a rule of the set could match: none does without one of its words."""
    low = F.lower(text)
    out = F.lit(False)
    for word in K.BOILERPLATE_WORDS[name]:
        out = out | low.contains(word)
    for letter in K.ODD_LETTERS:
        out = out | text.contains(letter)
    return out


def remove_boilerplate(text: Column, platform: Column) -> Column:
    """Rules of the platform on each line that isn't protected; unknown platforms: the default's. A text is
    split, and a line looked at, only if it has a word that a rule needs."""
    p = F.lower(F.coalesce(platform, F.lit("default")))

    def of(name: str) -> Column:
        source = F.when(text.contains("-\n"), join_hyphens(text)).otherwise(text) if name == "pdf" else text
        clean_line = lambda line: F.when(~_may_match(line, name), line).when(protected(line), line).otherwise(_without_rules(line, K.BOILERPLATE[name]))
        return let(source, lambda t: F.when(_may_match(t, name), F.array_join(F.transform(F.split(t, "\n", -1), clean_line), "\n")).otherwise(t))

    out = F.when(p.isin("nixle", "rave"), of("nixle"))
    for name in ("civicplus", "crimemapping", "pdf"):
        out = out.when(p == name, of(name))
    return out.otherwise(of("default"))


def remove_page_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?dmU)^\s*[Pp]age\s+\d+\s+of\s+\d+\s*$", "")


def remove_nonprintable(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def tidy_whitespace(text: Column) -> Column:
    """Runs of blanks as one, lines trimmed, at most one empty line in a row."""
    runs = F.regexp_replace(text, r"[ \t]+", " ")
    lines = F.array_join(F.transform(F.split(runs, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def quality_score(original: Column, cleaned: Column) -> Column:
    """0 to 100: less for text that went, more for dates, identifiers and addresses."""

    def score(s: Column) -> Column:
        a, b = s["a"], s["b"]
        gone = ((F.length(a) - F.length(b)) / F.length(a) * 80).cast("int")
        bonus = F.when(b.rlike("(?iU)" + K.SCORE_DATE), 10).otherwise(0) + F.when(b.rlike("(?iU)" + K.SCORE_ID), 10).otherwise(0) + F.when(b.rlike("(?iU)" + K.SCORE_ADDRESS), 5).otherwise(0)
        total = F.least(F.lit(100), F.greatest(F.lit(0), 100 - gone) + bonus)
        short = F.length(F.regexp_replace(b, r"(?U)^\s+|\s+$", "")) < 50
        return F.when(F.length(a) == 0, 0).when(short, F.least(total, F.lit(30))).otherwise(total)

    return let(F.struct(F.coalesce(original, F.lit("")).alias("a"), F.coalesce(cleaned, F.lit("")).alias("b")), score)


def clean(text: Column, platform: Column) -> Column:
    """Struct of cleaned_text and quality_score; blank input gives ('', 0)."""
    blank = F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")
    out = unescape(dedup_sentences(remove_boilerplate(strip_html(F.coalesce(text, F.lit(""))), platform)))
    done = F.when(blank, F.lit("")).otherwise(tidy_whitespace(remove_nonprintable(remove_page_markers(out))))
    return let(done, lambda t: F.struct(t.alias("cleaned_text"), F.when(blank, 0).otherwise(quality_score(text, t)).alias("quality_score")))
