"""Personal data in texts: fixed patterns, and a tagger that learns from them."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equispark.llm.sampling import smallest
from equispark.llm.tagger import Tagger, codes
from equispark.llm.text import filled
from equispark.llm.worker import alone

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, BLOCK = 64, 32, 256
FOUND = "array<struct<kind: string, start: long, end: long, base: boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so later digits are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]\x20?[Aa][Tt]\x20?[)\]]")
_AT = re.compile(r"\s*[(\[]\s?(?:at|@)\s?[)\]]\s*|\s+@\s+", re.I)
_DOT = re.compile(r"\s*[(\[]\s?(?:dot|\.)\s?[)\]]\s*|\s+\.\s+", re.I)

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.tld: each @ takes the local characters before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All spans of the fixed patterns, by kind as listed, then start."""
    out: list[Span] = [("email", *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def plausible(kind: str, found: str) -> bool:
    """Whether a span has the form of the patterns."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "email":
        local, _, domain = found.partition("@")
        return bool(local) and "." in domain.strip(".")
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return found.startswith("+") and 9 <= len(digits) <= 15


def fitted(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """A tagged span with the rest of the word or number at each end, and no signs around it."""
    signs = "._%+-" if kind == "email" else "-./_"
    if kind == "email" and (word := re.search(r"\S+@\S+", text[a:b])):
        a, b = a + word.start(), a + word.end()
    while a < b and not text[a].isalnum() and not (kind == "phone" and text[a] in "(+") and text[a : a + 2] != "::":
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while 0 < a < b and text[a].isalnum() and (text[a - 1].isalnum() or a > 1 and text[a - 1] in signs and text[a - 2].isalnum()):
        a -= 1 if text[a - 1].isalnum() else 2
    while a < b < len(text) and (text[b].isalnum() or b + 1 < len(text) and text[b] in signs and text[b + 1].isalnum()):
        b += 1
    if kind == "phone" and a and (text[a - 1] == "+" or text[a - 1] == "(" and text.find(")", a, b) > 0):
        a -= 1
    return a, b


def varied(kind: str, found: str) -> bool:
    """Whether a whole token can be of its kind, whatever parts it: what the kind needs, not one way of writing it."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "email":
        local, at, domain = _DOT.sub(".", _AT.sub("@", found)).partition("@")
        return bool(at and local and domain) and not re.search(r"[\s@]", local + domain)
    if kind == "ip":
        plain = _DOT.sub(".", found)
        try:
            return bool(ipaddress.ip_address(plain))
        except ValueError:
            parts = re.split(r"[-_.,\x20]{1,3}", plain)
            return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if re.search(r"[^0-9\s()+./_,–-]", found):
        return False
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    book = len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(d) * (1 + i % 2 * 2) for i, d in enumerate(digits)) % 10 == 0
    return 9 <= len(digits) <= 15 and not book


def tags_of(spans: list[Span], start: int, length: int = WINDOW) -> np.ndarray:
    """Tags of a window: 0 outside, 1 + 2 k where a span of kind k begins, 2 + 2 k inside it."""
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if a < start + length and b > start:
            k = KINDS.index(kind)
            tags[max(a - start, 0) : b - start] = 2 + 2 * k
            if a >= start:
                tags[a - start] = 1 + 2 * k
    return tags


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an @.

    An @ may be written `(at)`. Every span that the tagger learns from holds
    one, so the other windows have no span to find.
    """
    starts: dict[int, None] = {}
    at = _TRIGGER.search(text)
    while at:
        last = at.start() // STRIDE * STRIDE
        for start in range(max(0, last - WINDOW + STRIDE), last + 1, STRIDE):
            starts[start] = None
        at = _TRIGGER.search(text, last + STRIDE)
    return list(starts)


def window_codes(text: str, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([codes(text), np.zeros(WINDOW, np.int64)])
    return padded[np.asarray(starts, np.int64)[:, None] + np.arange(WINDOW)]


def reconciled(text: str, starts: list[int], tags: np.ndarray) -> list[Span]:
    """Spans of a text from its windows' tags.

    A span counts in each window that sees it; pieces of one kind that overlap
    are one span, and where kinds overlap the longer span stays (then the
    first kind). Spans without a digit or @ are none.
    """
    pieces = []
    for start, row in zip(starts, tags):
        at = 0
        for edge in [*(np.flatnonzero(np.diff(row)) + 1).tolist(), WINDOW]:
            tag = row[at]
            if tag and tag % 2 == 0 and pieces and pieces[-1][2] == start + at and pieces[-1][0] == (tag - 1) // 2 and at and row[at - 1] == tag - 1:
                pieces[-1] = (pieces[-1][0], pieces[-1][1], start + edge)
            elif tag:
                pieces.append((int(tag - 1) // 2, start + at, start + edge))
            at = edge
    merged: list[list[int]] = []
    for kind, a, b in sorted(pieces):
        if merged and merged[-1][0] == kind and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    return apart([(KINDS[k], a, min(b, len(text))) for k, a, b in merged if _TRIGGER.search(text, a, b)])


def apart(spans: list[Span]) -> list[Span]:
    """Spans that do not overlap: in each run of overlapping ones the longest first."""
    out, run, reach = [], [], -1
    for span in [*sorted(spans, key=lambda s: s[1]), None]:
        if span is None or span[1] >= reach:
            taken: list[Span] = []
            for s in sorted(run, key=lambda s: (s[1] - s[2], KINDS.index(s[0]))):
                if all(s[2] <= t[1] or s[1] >= t[2] for t in taken):
                    taken.append(s)
            out += taken
            run = []
        if span:
            run.append(span)
            reach = max(reach, span[2])
    return out


def written(kind: str, draw: np.random.Generator) -> str:
    """A made-up span of a kind, in the patterns' form or one of the ways that they do not hold."""
    pick = lambda *of: of[int(draw.integers(len(of)))]
    some = lambda signs, n: "".join(draw.choice(list(signs), n))
    number = lambda n: some("0123456789", n)
    if kind == "phone":
        a, b, c, z = some("23456789", 1) + number(2), number(3), number(4), number(2)
        part = pick("-", "-", ".", " ", "/")
        return pick(f"+1 ({a}) {b}-{c}", f"+{z} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"({a}) {b} {c}", f"{a}{part}{b}{part}{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"1{part}{a}{part}{b}{part}{c}", f"00{z} {a} {b} {c}", f"0{a}/{b}{c}", f"0{a} {b} {c}")
    if kind == "ip":
        parts = [str(int(draw.integers(256))) for _ in range(4)]
        six = ":".join(some("0123456789abcdef", 4) for _ in range(8))
        return pick(*(sep.join(parts) for sep in ("[.]", "(.)", " . ", "-", "_", "[.]")), six, f"{six[:9]}::{six[-4:]}", ".".join(parts), ".".join(parts))
    if kind == "card":
        digits = pick("4", "51", "37") + number(13)
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        digits = digits if len(digits) == 16 else (d := digits[:14] + number(1)) + next(str(x) for x in range(10) if luhn(d + str(x)))
        return pick("", "", " ", "-", ".", ".", "/", "_", "  ", " - ", "–").join(digits[i : i + 4] for i in range(0, 16, 4))
    local = some("abcdefghijklmnoprstuvwyz", int(draw.integers(3, 8))) + pick("", ".", "_") + some("abcdefghijklmnoprstuvwyz", int(draw.integers(2, 6))) + pick("", number(2))
    domain = some("abcdefghijklmnoprstuvwyz", int(draw.integers(3, 9))) + pick("", number(1))
    at, end = pick(" (at) ", " [at] ", "(at)", "[at]", " @ ", "@", "@"), pick("com", "org", "net", "de", "example.com")
    dot = pick(".", ".", " (dot) ", "[dot]", "(dot)") if at != "@" else "."
    return local + at + domain + (dot + end.replace(".", dot) if at != "@" or pick(True, False) else "")


def lookalike(draw: np.random.Generator) -> str:
    """Digits and @ that are no personal data."""
    pick = lambda *of: of[int(draw.integers(len(of)))]
    some = lambda signs, n: "".join(draw.choice(list(signs), n))
    number = lambda n: some("0123456789", n)
    day = f"20{number(2)}-{pick('01', '07', '10', '12')}-{pick('03', '14', '25', '30')}"
    clock = f"{pick('08', '12', '17', '23')}:{number(2)}"
    wrong = next(d for d in iter(lambda: number(16), None) if not luhn(d))
    return pick(day, f"{day} {clock}", f"{day}T{clock}:00", clock, f"{number(1)}.{number(1)}.{number(2)}", f"v{number(1)}.{number(2)}", f"{number(3)},{number(3)}.{number(2)}", f"{number(4)}-{number(4)}", number(int(draw.integers(1, 13))), wrong, " ".join(wrong[i : i + 4] for i in range(0, 16, 4)), "@" + some("abcdefghilmnoprstu", 7), f"{number(2)} @ {number(2)}", "0x" + some("0123456789abcdef", 8), f"{number(3)} {number(3)}", f"({number(4)})", f"p. {number(2)}-{number(3)}", some("0123456789abcdef", 32))


def copies(x: np.ndarray, y: np.ndarray, each: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the sample with a planted token: `each` of every kind and as many look-alikes."""
    draw = np.random.default_rng(seed)
    free = x[~y.any(axis=1)]
    free = free if len(free) else np.full((1, WINDOW), ord(" "), np.int64)
    made: list[tuple[Callable[[], str], int]] = [(lambda kind=kind: written(kind, draw), k) for k, kind in enumerate(KINDS)] * each + [(lambda: lookalike(draw), -1)] * each
    out_x, out_y = np.empty((len(made), WINDOW), np.int64), np.zeros((len(made), WINDOW), np.int64)
    for row, (make, k) in enumerate(made):
        token, around = codes(make())[:WINDOW], free[int(draw.integers(len(free)))]
        before, after = draw.choice([" ", " ", " ", "\n", '"', ": "]), draw.choice([" ", " ", " ", ". ", ", ", '"', "\n"])
        at = int(draw.integers(max(WINDOW - len(token) - len(before), 0) + 1))
        rest = np.concatenate([codes(str(after)), around[at:] if draw.random() < 0.7 else around[at : at + 4], np.zeros(WINDOW, np.int64)])
        out_x[row] = np.concatenate([around[:at], codes(str(before)), token, rest])[:WINDOW]
        if k >= 0:
            start = at + len(before)
            out_y[row, start : start + len(token)] = 2 + 2 * k
            out_y[row, start] = 1 + 2 * k
    return np.concatenate([x, out_x]), np.concatenate([y, out_y])


def fit(documents: DataFrame, sample_rows: int = 500, sample_windows: int = 2000, rounds: int = 9, each: int = 300) -> Tagger | None:
    """A tagger learnt from the fixed patterns' spans in a bounded sample and planted spans in other ways of writing.

    The sample: of the documents with a digit or @ the `sample_rows` with the
    smallest hash of id and text (copies count once), of their windows the `sample_windows` with the smallest
    hash. `each` planted spans of every kind and as many look-alikes come
    on top. None where no such document exists.
    """
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").rlike("[0-9@]")).withColumn("draw", F.xxhash64("doc_id", "text"))
    rows = smallest(rows, sample_rows)

    def labelled(batches):
        for batch in batches:
            for draw, text in zip(batch["draw"].to_pylist(), batch["text"].to_pylist()):
                starts, spans = window_starts(text), base_spans(text)
                x, inside = window_codes(text, starts), sorted(spans, key=lambda s: s[1])
                y = [tags_of([s for s in inside if s[1] < at + WINDOW and s[2] > at], at) for at in starts]
                keys = [(draw ^ (at * 0x9E3779B97F4A7C15)) % (1 << 62) for at in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([r.astype(np.uint8).tobytes() for r in x], pa.binary()), pa.array([r.astype(np.uint8).tobytes() for r in y], pa.binary())],
                    names=["key", "x", "y"],
                )

    found = rows.select("draw", "text").mapInArrow(labelled, "key long, x binary, y binary")
    found = found.orderBy("key", "x").limit(sample_windows).collect()
    if not found:
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    x, y = (np.frombuffer(b"".join(r[c] for r in found), np.uint8).reshape(-1, WINDOW).astype(np.int64) for c in ("x", "y"))
    tagger.train(*copies(x, y, each), rounds)
    return tagger


def beyond(text: str, tagged: list[Span], base: list[tuple[str, int, int, bool]]) -> list[Span]:
    """What tagged spans hold besides the base spans, as far as their kind allows it.

    Each rest is tried with its whole words and numbers, in any way of writing,
    then as it was tagged, in the form of the patterns. Rests of one kind that only signs part
    are tried as one before.
    """
    holes = np.array(sorted((s[1], s[2]) for s in base)).reshape(-1, 2)
    reach = np.maximum.accumulate(holes[:, 1]) if len(holes) else holes[:, 1]
    free = lambda a, b: not (before := int(np.searchsorted(holes[:, 0], b))) or reach[before - 1] <= a
    rests: list[Span] = []
    for kind, a, b in sorted(tagged, key=lambda s: s[1]):
        first, last = int(np.searchsorted(reach, a, side="right")), int(np.searchsorted(holes[:, 0], b))
        for low, high in holes[first:last].tolist():
            rests += [(kind, a, low)] * (a < low)
            a = max(a, high)
        rests += [(kind, a, b)] * (a < b)
    joined = [(k, a, d) for (k, a, b), (n, c, d) in zip(rests, rests[1:]) if k == n and c - b <= 3 and not any(x.isalnum() for x in text[b:c])]
    out = []
    for kind, a, b in [*joined, *rests]:
        low, high = fitted(kind, text, a, b)
        if low < high and free(low, high) and varied(kind, text[low:high]):
            out.append((kind, low, high))
        elif free(a, b) and plausible(kind, text[a:b]):
            out.append((kind, a, b))
    return apart(list(dict.fromkeys(out)))


def spans_in(texts: list[str], tagger: Tagger | None) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each text by kind, then start: the patterns' spans, and what the tagger's hold besides them that its kind allows."""
    out, work = [[] for _ in texts], []
    for i, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        out[i] = [(*s, True) for s in base_spans(text)]
        work += [(i, start) for start in window_starts(text)] if tagger else []
    by_text: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for at in range(0, len(work), BLOCK):
        part = work[at : at + BLOCK]
        rows = [window_codes(texts[i][start : start + WINDOW], [0])[0] for i, start in part]
        for (i, start), tags in zip(part, tagger.decode(np.array(rows))):
            if tags.any():
                starts, held = by_text.setdefault(i, ([], []))
                starts.append(start)
                held.append(tags)
    for i, (starts, held) in by_text.items():
        out[i] += [(*s, False) for s in beyond(texts[i], reconciled(texts[i], starts, np.array(held)), out[i])]
        out[i].sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


def finder(documents: DataFrame, tagger: Tagger | None):
    """A function from a text column to the array of its spans."""
    shared = documents.sparkSession.sparkContext.broadcast(tagger)

    @F.arrow_udf(FOUND)
    def find(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        alone("tagger")
        texts, rows = filled(column), []
        for at in range(0, len(texts), 512):
            found = spans_in(texts.slice(at, 512).to_pylist(), shared.value)
            rows += [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in own] for own in found]
        return pa.array(rows, kind)

    return lambda text="text": find((F.col(text) if isinstance(text, str) else text).cast("string"))


def personal_data(documents: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, spans) of every row: spans by kind, then start, in code points, end exclusive.

    `base` marks those of the fixed patterns. Null texts are empty; a text of
    any length is read whole, in windows; repeated rows repeat; an empty table
    gives no rows; further columns are not read.
    """
    tagger = tagger or fit(documents)
    return documents.select("doc_id", finder(documents, tagger)("text").alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one hole."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        alone("tagger")
        out = []
        for text, own in zip(texts.to_pylist(), found.to_pylist()):
            parts, at = [], 0
            for span in sorted(own or [], key=lambda s: (s["start"], -s["end"])):
                if span["start"] >= at:
                    parts += [text[at : span["start"]], f"[{span['kind'].upper()}]"]
                at = max(at, span["end"])
            out.append(text if text is None or not parts else "".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return cut(text, spans)
