"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its words (A-Z lower-cased; runs of letters, digits and non-ASCII), joined by single
blanks, so a rule is a regular expression over words and punctuation doesn't matter. Most rules are the
several hundred signatures written by hand in `license_signatures`; others are made of the names and
versions of licenses and of SPDX identifiers. A rule is filed under one of the words that any match has,
its keyword. A text asks for the rules of the keywords that it has, and of those only the ones run all of
whose words are there, so most texts run none. Of the detections of a text, those inside the interval of another of higher priority
are suppressed (equal priority: the longer, then the earlier rule wins); base phrases are never.

Texts are handled in Arrow batches inside tasks; rows never move, so the plan is a scan and one map.

Defined results: null and empty texts have no words and no labels, score 0. Repeated rows are scanned
one by one, null ids stay null, an empty table gives no rows, further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.license_signatures import SIGNATURES, SPDX, WEAK

# Phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label -> the names under which a license goes, in words; versions after "|".
LICENSES = {
    "afl": "academic free license|1 1,1 2,2 0,2 1,3 0",
    "agpl": "gnu affero general public license,affero general public license,agpl|1 0,3 0,3",
    "apache": "apache license,apache software license,asl|1 0,1 1,2 0",
    "artistic": "artistic license,perl artistic license|1 0,2 0",
    "beerware": "beerware license,beer ware license|",
    "bsd": "bsd license,berkeley software distribution license,bsd 2 clause,bsd 3 clause,bsd 4 clause,simplified bsd license,new bsd license,modified bsd license|",
    "bsl": "boost software license,business source license|1 0,1 1",
    "cc-by": "cc by,creative commons attribution|1 0,2 0,2 5,3 0,4 0",
    "cc-by-nc": "cc by nc,creative commons attribution noncommercial,creative commons attribution non commercial|1 0,2 0,2 5,3 0,4 0",
    "cc-by-nd": "cc by nd,creative commons attribution noderivatives,creative commons attribution no derivatives|1 0,2 0,2 5,3 0,4 0",
    "cc-by-sa": "cc by sa,creative commons attribution sharealike,creative commons attribution share alike|1 0,2 0,2 5,3 0,4 0",
    "cc0": "cc0,creative commons zero|1 0",
    "cddl": "common development and distribution license,cddl|1 0,1 1",
    "cecill": "cecill license,cecill free software license|1 0,2 0,2 1",
    "cpl": "common public license|1 0",
    "ecl": "educational community license|1 0,2 0",
    "epl": "eclipse public license,epl|1 0,2 0",
    "eupl": "european union public licence,eupl|1 0,1 1,1 2",
    "fdl": "gnu free documentation license,gfdl|1 1,1 2,1 3",
    "gpl": "gnu general public license,gnu gpl,general public license,gpl|1 0,2 0,3 0,2,3",
    "isc": "isc license,internet systems consortium license|",
    "lgpl": "gnu lesser general public license,gnu library general public license,lesser general public license,lgpl|2 0,2 1,3 0",
    "lppl": "latex project public license,lppl|1 0,1 2,1 3c",
    "mit": "mit license,expat license,x11 license|",
    "mpl": "mozilla public license,mpl|1 0,1 1,2 0",
    "ms-pl": "microsoft public license,ms pl|",
    "ms-rl": "microsoft reciprocal license,ms rl|",
    "ncsa": "university of illinois ncsa open source license,ncsa license|",
    "odbl": "open database license,odbl|1 0",
    "ofl": "sil open font license,open font license|1 0,1 1",
    "osl": "open software license|1 0,2 0,2 1,3 0",
    "pddl": "public domain dedication and license,pddl|1 0",
    "php": "php license|3 0,3 01",
    "postgresql": "postgresql license|",
    "psf": "python software foundation license,psf license|2",
    "public-domain": "public domain|",
    "unlicense": "unlicense|",
    "upl": "universal permissive license|1 0",
    "vim": "vim license|",
    "w3c": "w3c license,w3c software notice and license|",
    "wtfpl": "do what the fuck you want to public license,wtfpl|2",
    "zlib": "zlib license,zlib libpng license|",
    "zpl": "zope public license,zpl|1 1,2 0,2 1",
}

#: From a license's name and versions: template, priority, weight of the evidence.
TEMPLATES = [
    ("{name}", 1, 0.6),
    ("{name} (?:version |v ?)?(?:{versions})", 2, 0.8),
    ("(?:released|licensed|distributed|available|published|provided) under (?:the |a |an )?(?:terms of )?(?:the )?{name}(?: (?:version |v ?)?(?:{versions}))?", 3, 0.95),
]
#: Names that mean other things too, and so say nothing by themselves: acronyms, and what isn't a license's own name. They count with "license" next to them.
AMBIGUOUS = re.compile("[a-z]{2,5}|public domain|ms pl|ms rl")
BESIDE = "{name} licen[cs]e"
#: The same from an SPDX identifier, in words, and what may follow it.
TAGS = [
    ("(?:spdx )?license identifier {id}{rest}", 4, 1.0),
    ("license {id}{rest}", 2, 0.8),
    ("licence {id}{rest}", 2, 0.8),
    ("licensed under (?:the )?{id}{rest}", 3, 0.95),
]
REST = "(?: v?[0-9]+[a-z]?(?: [0-9]+){0,2})?(?: clause)?(?: only| or later)?"
#: Priority of hand-written signatures.
SIGNED = 3

#: What joins the words of a text, A-Z lower-cased, all else blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Rule(NamedTuple):
    """needs: words that every match has; order: which rule wins among equals."""

    order: int
    label: str
    priority: int
    weight: float
    needs: frozenset[bytes]
    pattern: re.Pattern


def literals(pattern: str) -> list[str]:
    """The words that every match of the pattern has whole: those outside groups that hold nothing but letters and digits."""
    depth, flat = 0, []
    for c in pattern:
        depth += c == "("
        if depth == 0:
            flat.append(c)
        elif c == ")":
            flat.append("(")  # the group touches what is next to it
        depth -= c == ")"
    return [w for w in "".join(flat).split() if re.fullmatch(r"\w+", w)]


@lru_cache(1)
def rules() -> list[Rule]:
    """In the order in which they win ties."""
    made: list[tuple[str, int, float, str]] = []
    for label, text in LICENSES.items():
        names, versions = text.split("|")
        versions = "|".join(sorted(filter(None, versions.split(",")), key=len, reverse=True))
        for name in names.split(","):
            for template, priority, weight in TEMPLATES:
                template = BESIDE if priority == 1 and AMBIGUOUS.fullmatch(name) else template
                if versions or "{versions}" not in template:
                    made.append((label, priority, weight, template.format(name=name, versions=versions)))
                elif priority == SIGNED:  # a license without versions
                    made.append((label, priority, weight, template.replace("(?: (?:version |v ?)?(?:{versions}))?", "").format(name=name)))
    for label, text in SIGNATURES.items():
        made += [(label, SIGNED, WEAK.get(x, 1.0), re.sub(r"\bW\b", r"\\S+", x)) for x in text.strip().split("\n")]
    for name in sorted(SPDX, key=len, reverse=True):
        made += [(SPDX[name], priority, weight, template.format(id=name, rest=REST)) for template, priority, weight in TAGS]
    made.sort(key=lambda r: -r[1])
    return [Rule(i, label, p, w, frozenset(x.encode() for x in literals(text)), re.compile(rf"(?<= )(?:{text})(?= )".encode())) for i, (label, p, w, text) in enumerate(made)]


@lru_cache(1)
def by_keyword() -> dict[bytes, list[Rule]]:
    """Rules by their keyword: of the words that they need, the one that fewest rules need (ties: the longest, then the first)."""
    needed = Counter(w for r in rules() for w in r.needs)
    out: dict[bytes, list[Rule]] = {}
    for r in rules():
        out.setdefault(min(r.needs, key=lambda w: (needed[w], -len(w), w)), []).append(r)
    return out


def scan(text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, int, float]]]:
    """Of one text: its number of words; base places and kept detections as (first word, past the last word, label, ...)."""
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
    have = set(words)
    phrases = [x for x in BASE.items() if have.issuperset(x[0].encode().split())]
    asked = [r for k in by_keyword().keys() & have for r in by_keyword()[k] if r.needs <= have]
    if not phrases and not asked:
        return len(words), [], []
    joined = b" " + b" ".join(words) + b" "
    starts = list(accumulate((len(w) + 1 for w in words), initial=1))
    at = lambda byte: bisect_left(starts, byte)  # noqa: E731  the word that begins at this byte
    base = []
    for phrase, label in phrases:
        look, p = f" {phrase} ".encode(), -1
        while (p := joined.find(look, p + 1)) >= 0:
            first = at(p + 1)
            base.append((first, first + phrase.count(" ") + 1, label))
    found = []
    for r in asked:
        for m in r.pattern.finditer(joined):
            first = at(m.start())
            found.append((first, first + m.group().count(b" ") + 1, r.label, r.priority, r.weight, r.order))
    # by priority, length and order; what lies inside one that is kept goes. lo, hi: the kept ones that no other contains,
    # both rising, so the last that begins no later also reaches farthest
    kept: list[tuple] = []
    lo: list[int] = []
    hi: list[int] = []
    for x in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[5], x[0])):
        i = bisect_right(lo, x[0])
        if i and hi[i - 1] >= x[1]:
            continue
        kept.append(x[:5])
        k = bisect_left(lo, x[0])
        end = bisect_right(hi, x[1], k)
        lo[k:end], hi[k:end] = [x[0]], [x[1]]
    return len(words), base, sorted(kept)


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<first:long,last:long,label:string,priority:int>>"
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, base places and labels, all labels, the strongest evidence as score, and the kept detections."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["_id"], pdf["_t"], strict=True):
                n, base, found = scan(text)
                starts = [b[0] for b in base]
                mine = {b[2] for b in base}
                labels = mine | {x[2] for x in found}
                score = max([x[4] for x in found] + [0.6] * bool(base), default=0.0)
                rows.append((
                    doc, n, len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(mine)), ",".join(sorted(labels)), score,
                    [{"first": a, "last": b - 1, "label": label, "priority": p} for a, b, label, p, _ in found],
                ))
            out = pd.DataFrame(rows, columns=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            for c in ("_id", "first_word", "last_word"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInPandas(run, f"_id {id_type}, {SCHEMA}")
    return df.withColumnRenamed("_id", id_col)
