"""License scans by ordered signature rules.

A text's words are the maximal runs of characters outside the ASCII separators, with A-Z
lower-cased; null counts as empty. Rules are regular expressions over the words joined by
single spaces, so a match is a range of words. They are ordered: sentences of license
texts first, then names with a version, then bare names, the longer before the shorter.
The first 290 are written one by one (license_rules), names and versions of families are
multiplied out. A rule is tried only if its keyword occurs in the text. Of detections that
overlap, the rule with the higher priority wins: a detection inside the range of a better
one is suppressed. A text costs time in proportion to its length and its detections. The four base phrases are counted wherever their words stand consecutively,
before any suppression, and their labels always stay.

The score is the confidence of the best detection kept: 0 without any. Repeated rows each
get their result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkindex.llm.common import map_batches
from sparkindex.llm.license_rules import IDENTIFIERS, SENTENCES, rows
from sparkindex.llm.positional import words_of

#: Base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: bytes
    keyword: bytes
    confidence: float


#: Reserved rights are a weak sign: many pages say so whatever their license.
RESERVED = ("proprietary", "all rights reserved", 0.5)
#: Families: label, names (spellings of the name as words), versions.
FAMILIES = [
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1.0", "3.0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lgpl", "lgpl"), ("2.0", "2.1", "3.0")),
    ("gpl", ("gnu general public license", "gnu public license", "gnu gpl", "gpl"), ("1.0", "2.0", "3.0")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1.1", "1.2", "1.3")),
    ("apache", ("apache software license", "apache license", "apache"), ("1.0", "1.1", "2.0")),
    ("mpl", ("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public license", "epl"), ("1.0", "2.0")),
    ("eupl", ("european union public licence", "eupl"), ("1.0", "1.1", "1.2")),
    ("cddl", ("common development and distribution license", "cddl"), ("1.0", "1.1")),
    ("osl", ("open software license", "osl"), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("afl", ("academic free license", "afl"), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic license",), ("1.0", "2.0")),
    ("ecl", ("educational community license",), ("1.0", "2.0")),
    ("zpl", ("zope public license", "zpl"), ("1.1", "2.0", "2.1")),
    ("php", ("php license",), ("3.0", "3.01")),
    ("python", ("python software foundation license", "python license", "psf license"), ("2.0", "2.1")),
    ("cecill", ("cecill free software license", "cecill license", "cecill"), ("1.0", "1.1", "2.0", "2.1")),
    ("ofl", ("sil open font license", "open font license"), ("1.0", "1.1")),
    ("bsl", ("boost software license",), ("1.0",)),
    ("lppl", ("latex project public license", "lppl"), ("1.0", "1.1", "1.2", "1.3")),
    ("sspl", ("server side public license", "sspl"), ("1.0",)),
    ("busl", ("business source license",), ("1.0", "1.1")),
    ("elastic", ("elastic license",), ("1.0", "2.0")),
    ("odbl", ("open database license", "odbl"), ("1.0",)),
    ("odc-by", ("open data commons attribution license",), ("1.0",)),
    ("pddl", ("public domain dedication and license", "pddl"), ("1.0",)),
    ("rpl", ("reciprocal public license",), ("1.1", "1.5")),
    ("upl", ("universal permissive license",), ("1.0",)),
    ("cpl", ("common public license",), ("0.5", "1.0")),
    ("ipl", ("ibm public license",), ("1.0",)),
    ("npl", ("netscape public license",), ("1.0", "1.1")),
    ("qpl", ("q public license",), ("1.0",)),
    ("apsl", ("apple public source license",), ("1.0", "1.1", "1.2", "2.0")),
    ("openldap", ("openldap public license",), ("2.7", "2.8")),
    ("wtfpl", ("wtfpl",), ("1.0", "2.0")),
    ("mulan-psl", ("mulan permissive software license", "mulan psl"), ("1.0", "2.0")),
]
#: Names that have no versions.
PLAIN = [
    ("mit", ("mit license", "expat license", "x11 license", "mit licence")),
    ("isc", ("isc license",)),
    ("bsd-2-clause", ("bsd 2 clause", "simplified bsd license", "freebsd license", "2 clause bsd")),
    ("bsd-3-clause", ("bsd 3 clause", "new bsd license", "revised bsd license", "modified bsd license", "3 clause bsd")),
    ("bsd-4-clause", ("bsd 4 clause", "original bsd license", "4 clause bsd")),
    ("0bsd", ("0bsd", "zero clause bsd")),
    ("bsd", ("bsd license", "bsd style license")),
    ("zlib", ("zlib license", "zlib libpng license")),
    ("unlicense", ("the unlicense",)),
    ("ms-pl", ("microsoft public license", "ms pl")),
    ("ms-rl", ("microsoft reciprocal license", "ms rl")),
    ("beerware", ("beer ware license", "beerware license")),
    ("json", ("json license",)),
    ("curl", ("curl license",)),
    ("libpng", ("libpng license",)),
    ("vim", ("vim license",)),
    ("ruby", ("ruby license",)),
    ("w3c", ("w3c software license", "w3c software notice and license")),
    ("cc0-1.0", ("cc0", "creative commons zero")),
]
#: Creative Commons: parts of the name, short and long, and versions.
CC_PARTS = [("nc-nd", "nc nd", "non ?commercial no ?deriv(?:ative)?s?(?: works)?"), ("nc-sa", "nc sa", "non ?commercial share ?alike"), ("sa", "sa", "share ?alike"), ("nd", "nd", "no ?deriv(?:ative)?s?(?: works)?"), ("nc", "nc", "non ?commercial"), ("", "", "")]
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _version(text: str) -> str:
    """A version as words, with or without a word for it before: 2.0 is `2 0` or `2`."""
    number = text.removesuffix(".0").replace(".", " ")
    return f"(?:version |v )?{number}(?: 0)?(?! [0-9])" if text.endswith(".0") else f"(?:version |v )?{number}"


def _glued(text: str) -> str:
    """A version written without a space, as in gplv3."""
    return f"v?{text.removesuffix('.0').replace('.', ' ')}"


def build_rules() -> list[Rule]:
    """All rules, the best first."""
    rules = [Rule(label, pattern.encode(), keyword.encode(), confidence) for table, confidence in ((SENTENCES, 0.99), (IDENTIFIERS, 0.97)) for label, keyword, pattern in rows(table)]
    named: list[tuple[int, Rule]] = []

    def add(label: str, pattern: str, keyword: str, confidence: float) -> None:
        named.append((-len(pattern), Rule(label, pattern.encode(), keyword.encode(), confidence)))

    for part, short, long in CC_PARTS:
        for version in CC_VERSIONS:
            label = "-".join(x for x in ("cc-by", part, version) if x)
            add(label, " ".join(x for x in ("cc by", short, _version(version)) if x), "cc by", 0.95)
            add(label, " ".join(x for x in ("creative commons attribution", long, "(?:international |unported |generic )?(?:public )?(?:license )?" + _version(version)) if x), "creative commons", 0.95)
        if part:
            add(f"cc-by-{part}", f"cc by {short}", "cc by", 0.8)
    for label, names, versions in FAMILIES:
        for name in names:
            for version in versions:
                add(f"{label}-{version}", f"{name} {_version(version)}", name, 0.95)
                if label in ("gpl", "lgpl", "agpl", "gfdl"):
                    add(f"{label}-{version}-or-later", f"{name} {_version(version)} (?:or|and) (?:at your option )?any later(?: version)?", name, 0.95)
                    add(f"{label}-{version}-or-later", f"{name} {_version(version)} or later", name, 0.95)
                if " " not in name:
                    add(f"{label}-{version}", name + _glued(version), name, 0.9)
                    add(f"{label}-{version}-or-later", name + _glued(version) + " or later", name, 0.9)
            if "licen" in name or name.startswith("gnu"):
                add(label, name, name, 0.7)
    for label, names in PLAIN:
        for name in names:
            add(label, name, name, 0.85)
    add(RESERVED[0], RESERVED[1], RESERVED[1], RESERVED[2])
    return rules + [rule for _, rule in sorted(named, key=lambda x: x[0])]


def word_numbers(joined: bytes):
    """A function from where a word starts, or where the blank after it stands, to how many
    words are before."""
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return lambda at: np.searchsorted(blanks, at) - (joined[at] != 32)


def uncontained(found: list[tuple[int, int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Of (priority, start, end, rule) those that no detection of better priority contains,
    by start. What is contained in a suppressed one is contained in what suppressed it, so
    one sweep over the starts, with the detections that are still open, decides all."""
    kept: list[tuple[int, int, Rule]] = []
    open_: list[tuple[int, int]] = []
    for priority, a, b, rule in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        open_ = [x for x in open_ if x[0] > a]
        if not any(end >= b and better < priority for end, better in open_):
            kept.append((a, b, rule))
        open_.append((b, priority))
    return kept


class Scanner:
    def __init__(self) -> None:
        by_keyword: dict[bytes, list[tuple[int, Rule, re.Pattern[bytes]]]] = {}
        for priority, rule in enumerate(build_rules()):
            by_keyword.setdefault(rule.keyword, []).append((priority, rule, re.compile(b"(?<= )(?:" + rule.pattern + b")(?= )")))
        self.by_keyword = list(by_keyword.items())
        self.base = [(re.compile(b"(?= " + phrase.encode() + b" )"), label) for phrase, label in BASE.items()]

    def detections(self, joined: bytes) -> list[tuple[int, int, Rule]]:
        """(first word, word after the last, rule) of what is left after suppression."""
        found = []
        for keyword, rules in self.by_keyword:
            if keyword in joined:
                for priority, rule, pattern in rules:
                    for m in pattern.finditer(joined):
                        found.append((priority, m.start(), m.end(), rule))
        words = word_numbers(joined)
        return [(int(words(a)), int(words(b)), rule) for a, b, rule in uncontained(found)]

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        """n_words, n_base, first_word, last_word, base labels, labels, score."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        at, base = [], set()
        for phrase, label in self.base:
            found = [m.start() + 1 for m in phrase.finditer(joined)]
            if found:
                at += found
                base.add(label)
        number = word_numbers(joined) if at else None
        n_base, first, last = (len(at), int(number(min(at))), int(number(max(at)))) if at else (0, None, None)
        kept = self.detections(joined) if words else []
        score = max((rule.confidence for _, _, rule in kept), default=0.0)
        if base:
            score = max(score, 0.7)
        return len(words), n_base, first, last, sorted(base), sorted(base | {rule.label for _, _, rule in kept}), score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        strings = pa.list_(pa.string())
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 4 + [strings, strings, pa.float64()]
        for batch in batches:
            rows = [scanner.scan(x.as_py()) for x in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *names])

    strings = T.ArrayType(T.StringType())
    fields = [("id", kind), ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", strings), ("labels", strings), ("score", T.DoubleType())]
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, T.StructType([T.StructField(n, k) for n, k in fields]))


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan_licenses with the labels comma-joined."""
    return scan_licenses(docs, id_col, text_col).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
