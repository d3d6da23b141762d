"""Licence notices in texts: ordered signature rules behind keyword tests."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equispark.llm.license_rules import IDENTIFIERS, RULES
from equispark.llm.text import filled, word_starts

WORD, GAP = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
SCORES = {1: 0.2, 2: 0.5, 3: 0.7, 4: 0.9, 5: 1.0}
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, spans array<struct<label: string, priority: int, start: long, end: long>>"
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    gates: tuple[bytes, ...]  # words that any match contains
    pattern: re.Pattern[bytes]


def phrase_pattern(phrase: str) -> re.Pattern[bytes]:
    """A phrase between word bounds; each blank matches what parts two words.

    A blank before an optional sign stays optional. Dots in `.{1,80}?` match
    any byte but a line end.
    """
    body = phrase.encode().replace(b" ?", b"(?:" + GAP + b")?").replace(b" ", GAP)
    return re.compile(rb"(?<!" + WORD + rb")(?:" + body + rb")(?!" + WORD + rb")")


def gates(keyword: str, phrase: str) -> tuple[bytes, ...]:
    """The keyword's words and the plain words of the phrase outside of groups, the keyword first."""
    outside, before = phrase, ""
    while outside != before:
        outside, before = re.sub(r"\([^()]*\)\??", "", outside), outside
    plain = [w for w in outside.replace("licen[cs]e", "licen").split(" ") if re.fullmatch("[a-z0-9]{2,}", w)]
    return tuple(w.encode() for w in dict.fromkeys([*keyword.split(" "), *sorted(plain, key=len, reverse=True)]))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: by priority, then as written."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, phrase = (part.strip() for part in line.split(" | ", 3))
        out.append(Rule(label, int(priority), gates(keyword, phrase), phrase_pattern(phrase)))
    for name in IDENTIFIERS:
        words = " ".join(re.findall("[0-9a-z]+", name.lower()))
        out.append(Rule(name.lower(), 5, (b"identifier",), phrase_pattern(f"spdx license identifier {words}")))
    return tuple(sorted(out, key=lambda r: -r.priority))


def detections(lowered: bytes) -> list[tuple[int, int, Rule]]:
    """Kept (start, end, rule) in bytes, in order of place.

    Rules go in order, each only where its gate words occur; a detection inside an earlier kept one
    is dropped, whatever its label, as is a second one over the same bytes.
    """
    kept: list[tuple[int, int, Rule]] = []
    present: dict[bytes, bool] = {}
    level: list[tuple[int, int, Rule]] = []

    def settle():
        """One sweep by start, longer first: what ends no later than an earlier one lies inside it."""
        reach, both = -1, [(*d, False) for d in kept] + [(*d, True) for d in level]
        for start, end, rule, new in sorted(both, key=lambda d: (d[0], -d[1], d[3])):
            if new and end > reach:
                kept.append((start, end, rule))
            reach = max(reach, end)
        level.clear()

    for rule in rules():
        for gate in rule.gates:
            if gate not in present:
                present[gate] = gate in lowered
            if not present[gate]:
                break
        else:
            if level and level[0][2].priority != rule.priority:
                settle()
            level += [(*m.span(), rule) for m in rule.pattern.finditer(lowered)]
    settle()
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def scan(text: bytes, phrases: Mapping[str, str]) -> tuple:
    """Words, places of the phrases by word number, labels, score and spans of one text."""
    lowered = text.lower()
    starts = word_starts(lowered)
    at, base = [], set()
    for phrase, label in phrases.items():
        if all(word.encode() in lowered for word in phrase.split(" ")):
            found = [m.start() for m in phrase_pattern(phrase).finditer(lowered)]
            at += found
            base |= {label} if found else set()
    words = np.searchsorted(starts, sorted(at)).tolist()
    kept = detections(lowered)
    labels = base | {rule.label for _, _, rule in kept}
    score = max([SCORES[rule.priority] for _, _, rule in kept] + [SCORES[2]] * bool(base), default=0.0)
    spans, place, points = [], 0, 0
    for start, end, rule in kept:
        points += len(text[place:start].decode("utf-8"))
        place = start
        spans.append({"label": rule.label, "priority": rule.priority, "start": points, "end": points + len(text[start:end].decode("utf-8"))})
    return (len(starts), len(words), words[0] if words else None, words[-1] if words else None, sorted(base), sorted(labels), score, spans)


def license_scan(documents: DataFrame, phrases: Mapping[str, str]) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    `phrases` are the base phrases with their labels; their places are counted
    whatever the rules suppress. Narrow, one row for each row; null texts are
    empty and score 0; repeated rows repeat; further columns are not read.
    Spans count code points of the text as it is.
    """
    fixed = dict(phrases)

    @F.arrow_udf(RESULT)
    def found(column: pa.Array) -> pa.Array:
        rows = [scan(t.as_buffer().to_pybytes(), fixed) for t in filled(column)]
        span = pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(span)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return documents.select("doc_id", found(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")
