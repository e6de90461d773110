"""Personal data in texts: rules, and a character tagger that finds what is written in other ways.

The tagger learns from the spans that the rules find in a bounded sample of documents, and from copies of them
rewritten as people disguise such data. Texts are read in overlapping windows; a span that every window
cuts is read again in a window around it, wide enough to hold it; the spans of all windows of a text are reconciled at
once. A span of the tagger only counts with the digits, parts or checksum of its kind.
"""

from __future__ import annotations

import dataclasses
import heapq
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import ship, text_or_empty
from shelflight.llm.tagger import Tagger
from shelflight.llm.token_ids import slices

KINDS = ("email", "ip", "card", "phone")
SPANS = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,share:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("share", pa.float64())]))

# The rules of each kind. A digit is never tried inside a run of digits, where no match can begin that
# does not begin at the run's start; an email is looked for around its @. Both keep the time linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = "[0-9@]"  # every span of every kind holds one of these

WINDOW, STRIDE = 128, 80
OTHER = 0
SYMBOLS = {c: i for i, c in enumerate("@.+-() _%\n/:,[]", start=5)}  # 1 digit, 2 lower, 3 upper, 4 letters beyond ASCII

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether the digits are a number up to 255; int() refuses thousands of digits, zeros included."""
    rest = part.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield 0, start, done
        at = text.find("@", max(at + 1, done))


def rule_spans(text: str) -> list[Span]:
    """(kind, start, end) that the rules find: of each kind leftmost first, without overlap; failed matches go."""
    out = list(_emails(text))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def codes_of(text: str) -> np.ndarray:
    """A symbol for each character."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    table = np.full(128, OTHER, dtype=np.int64)
    table[48:58], table[97:123], table[65:91] = 1, 2, 3
    for c, i in SYMBOLS.items():
        table[ord(c)] = i
    return np.where(points < 128, table[np.minimum(points, 127)], 4)


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a trigger; windows overlap by WINDOW - STRIDE characters."""
    hits = np.array([m.start() for m in re.finditer(TRIGGER, text)])
    if not len(hits):
        return []
    last = np.minimum(hits // STRIDE, max(0, -(-(len(text) - WINDOW) // STRIDE)))
    first = np.maximum(0, (hits - WINDOW) // STRIDE + 1)
    return sorted({w * STRIDE for a, b in zip(first, last, strict=True) for w in range(a, b + 1)})


def window_codes(codes: np.ndarray, start: int, size: int = WINDOW) -> np.ndarray:
    part = codes[start : start + size]
    return np.concatenate([part, np.full(size - len(part), OTHER)])


def allowed_steps() -> np.ndarray:
    """Tags are 0 outside, 2k + 1 first and 2k + 2 further characters of kind k; further ones follow their kind."""
    tags = 2 * len(KINDS) + 1
    out = np.zeros((tags, tags))
    for k in range(len(KINDS)):
        out[:, 2 * k + 2] = -1e4
        out[2 * k + 1, 2 * k + 2] = out[2 * k + 2, 2 * k + 2] = 0
    return out


def rewritten(kind: int, text: str) -> list[str]:
    """The same data as it is written to escape rules."""
    if kind == 0:
        name, _, domain = text.partition("@")
        return [f"{name} @ {domain}", f"{name}[@]{domain}"]
    if kind == 1:
        return [text.replace(".", "[.]"), text.replace(".", " . ")]
    if kind == 2:
        digits = _digits(text)
        return [sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sep in (".", "/", " - ")]
    digits = _digits(text)
    return [text.removeprefix("+"), f"({digits[:-7]}) {digits[-7:-4]}-{digits[-4:]}"]


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the tagger has what its kind must have."""
    digits = _digits(text)
    if kind == 0:
        name, _, domain = text.partition("@")
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+[ \[(]*", name) and re.fullmatch(r"[ \])]*[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search("[A-Za-z@+]", text)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9 ./-]+", text))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9(][0-9 ().-]+[0-9]", text)) and len(re.findall(r"[ ().-]+", text)) >= 2


_EMAIL_PIECE = re.compile(r"(?:[A-Za-z0-9._%+-]*[ \[(]*@)?[ \])]*[A-Za-z0-9.-]*|[A-Za-z0-9._%+-]*[ \[(]*")


def may_grow(kind: int, piece: str) -> bool:
    """Whether any text around this piece can make a plausible span of it."""
    digits = _digits(piece)
    if kind == 0:
        return bool(_EMAIL_PIECE.fullmatch(piece))
    if kind == 1:
        parts = re.findall("[0-9]+", piece)
        return len(parts) <= 4 and all(len(p) <= 3 for p in parts) and not re.search("[A-Za-z@+]", piece)
    if kind == 2:
        return len(digits) <= 19 and bool(re.fullmatch(r"[0-9 ./-]*", piece))
    return len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9 ().-]*", piece))


Region = tuple[int, int, int, int]


def merged(regions: list[Region]) -> list[Region]:
    """(text, start, end, size of the window to read) with regions that meet or touch taken together."""
    out: list[Region] = []
    for i, start, end, size in sorted(regions):
        if out and out[-1][0] == i and start <= out[-1][2]:
            _, start, before, wide = out.pop()
            end, size = max(before, end), max(wide, size)
        while size < end - start + WINDOW:
            size *= 2
        out.append((i, start, end, size))
    return out


@dataclasses.dataclass
class Detector:
    """The rules, with a trained tagger or without one (no labelled spans to learn from)."""

    tagger: Tagger | None
    least: float = 0.9  # probability that every character of an added span needs

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, bool, float]]]:
        """All spans of each whole text by kind and start, with whether a rule found it and its probability."""
        base = [rule_spans(t) for t in texts]
        more: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if self.tagger is not None:
            places = [(i, w, WINDOW) for i, t in enumerate(texts) for w in windows_of(t)]
            codes = {i: codes_of(texts[i]) for i in {i for i, *_ in places}}
            whole: dict[int, list[tuple[int, int]]] = {}
            cut: dict[int, list[tuple[int, int]]] = {}
            for (i, *_), spans in self._read(codes, places):
                for kind, start, end, sure, torn in spans:
                    if torn:
                        if may_grow(kind, texts[i][start:end]):
                            cut.setdefault(i, []).append((start, end))
                        continue
                    if sure >= self.least:  # a span next to a window's edge may look less sure than it is
                        whole.setdefault(i, []).append((start, end))
                        if plausible(kind, texts[i][start:end]):
                            more[i].append((kind, start, end, sure))
            regions = [(i, *p, 2 * WINDOW) for i, pieces in cut.items() for p in unseen(pieces, whole.get(i, []), base[i], len(texts[i]))]
            for i, spans in self._mend(texts, codes, regions).items():
                held = covered(len(texts[i]), [s[1:3] for s in spans])
                more[i] = [s for s in more[i] if not held[s[1] : s[2]].any()] + spans
        return [reconcile(b, m) for b, m in zip(base, more, strict=True)]

    def _read(self, codes: dict[int, np.ndarray], places: list[tuple[int, int, int]]) -> Iterator[tuple[tuple[int, int, int], list]]:
        """Each window (text, start, size) with its tagged spans: kind, start, end, probability, whether an edge cuts it."""
        for size, group in itertools.groupby(sorted(places, key=lambda p: p[2]), key=lambda p: p[2]):
            same, rows = list(group), max(1, 512 * WINDOW // size)
            for at in range(0, len(same), rows):
                some = same[at : at + rows]
                tags, share = self.tagger.decode(np.stack([window_codes(codes[i], w, size) for i, w, _ in some]))
                for place, row, sure in zip(some, tags, share, strict=True):
                    i, start, _ = place
                    length = min(size, len(codes[i]) - start)
                    row = row[:length]
                    # A window that begins inside a span begins with a further character of its kind.
                    first = np.flatnonzero((row % 2 == 1) | (row == 0) | (np.arange(length) == 0))
                    last = np.append(first[1:], length)
                    spans = []
                    for a, b in zip(first[row[first] > 0].tolist(), last[row[first] > 0].tolist(), strict=True):
                        torn = (a == 0 and start > 0) or (b == size and start + size < len(codes[i]))
                        spans.append(((int(row[a]) - 1) // 2, start + a, start + b, float(sure[a:b].min()), torn))
                    yield place, spans

    def _mend(self, texts: list[str], codes: dict[int, np.ndarray], regions: list[Region]) -> dict[int, list[tuple[int, int, int, float]]]:
        """The spans in regions where windows cut them, read in windows around them that widen until none is cut."""
        found: dict[int, list[tuple[int, int, int, float]]] = {}
        while regions:
            asked: dict[tuple[int, int, int], list[Region]] = {}
            for i, lo, hi, size in merged(regions):
                asked.setdefault((i, max(0, min((lo + hi - size) // 2, len(codes[i]) - size)), size), []).append((i, lo, hi, size))
            regions = []
            for place, spans in self._read(codes, list(asked)):
                for i, lo, hi, size in asked[place]:
                    here = [s for s in spans if s[1] < hi and lo < s[2]]
                    torn = [s for s in here if s[4] and may_grow(s[0], texts[i][s[1] : s[2]])]
                    if torn:
                        regions.append((i, min(lo, *(s[1] for s in torn)), max(hi, *(s[2] for s in torn)), 2 * size))
                        continue
                    found.setdefault(i, []).extend(
                        (kind, s, e, sure) for kind, s, e, sure, at_edge in here if not at_edge and sure >= self.least and plausible(kind, texts[i][s:e])
                    )
        return found


def covered(length: int, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    """For each position, whether one of the spans holds it."""
    out = np.zeros(length, dtype=bool)
    for start, end in spans:
        out[start:end] = True
    return out


def unseen(pieces: list[tuple[int, int]], whole: list[tuple[int, int]], base: list[Span], length: int) -> list[tuple[int, int]]:
    """The cut pieces that meet no base span and that no window shows as part of a whole, sure span."""
    held = covered(length, [s[1:] for s in base])
    ordered = sorted(whole)
    starts = np.array([s for s, _ in ordered])
    reach = np.maximum.accumulate([e for _, e in ordered]) if ordered else np.zeros(0)
    out = []
    for start, end in pieces:
        at = int(np.searchsorted(starts, start, side="right"))
        if not held[start:end].any() and not (at and reach[at - 1] >= end):
            out.append((start, end))
    return out


def reconcile(base: list[Span], found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, bool, float]]:
    """Base spans, and the disjoint spans of all windows with the largest sum of probabilities that meet none of them."""
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
    best: dict[Span, float] = {}
    for kind, start, end, sure in found:
        at = int(np.searchsorted(starts, end))
        if at == 0 or reach[at - 1] <= start:
            best[kind, start, end] = max(sure, best.get((kind, start, end), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    value, pick = [0.0], [None]
    for i, span in enumerate(spans):
        before = int(np.searchsorted(ends[:i], span[1], side="right"))
        gain = value[before] + best[span]
        value.append(max(value[i], gain))
        pick.append(before if gain > value[i] else None)
    added, i = [], len(spans)
    while i:
        if pick[i] is None:
            i -= 1
        else:
            added.append(spans[i - 1])
            i = pick[i]
    return sorted([(*s, True, 1.0) for s in base] + [(*s, False, best[s]) for s in added])


# What may be data of a kind, however it is written: wider than the rules and than what the tagger may add.
_LOOSE = (
    re.compile(r"[A-Za-z0-9._%+-]+[ \[(]{0,2}@[ \])]{0,2}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"(?<![0-9])[0-9]{1,3}(?:[ \[(]{0,2}\.[ \])]{0,2}[0-9]{1,3}){3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[ ./-]{0,3}[0-9]){12,18}(?![0-9])"),
    re.compile(r"\+?[0-9(][0-9 ().-]{7,}[0-9]"),
)


def unlabelled(text: str, spans: list[Span]) -> np.ndarray:
    """For each character, whether it may belong to data that no span names: it teaches nothing."""
    out = covered(len(text), [m.span() for loose in _LOOSE for m in loose.finditer(text)])
    for _, start, end in spans:
        out[start:end] = False
    return out


def _lesson(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of a window's text; what may be data without a label is masked."""
    codes, tags = window_codes(codes_of(text[:WINDOW]), 0), np.zeros(WINDOW, dtype=np.int64)
    masked = unlabelled(text, spans)[:WINDOW]
    codes[: len(masked)][masked] = OTHER
    for kind, s, e in spans:
        a, b = s, min(WINDOW, e)
        if a < b:
            tags[a:b] = 2 * kind + 2
            tags[a] = 2 * kind + 1
    return codes, tags


def _replaced(text: str, spans: list[Span], which: Span, other: str, more: list[Span]) -> tuple[str, list[Span]]:
    """`text` with `other` in the place of one span; `more` are the spans inside it, from its start on."""
    kind, start, end = which
    shift = len(other) - (end - start)
    kept = [(k, s + shift * (s >= end), e + shift * (s >= end)) for k, s, e in spans if (k, s, e) != which]
    return text[:start] + other + text[end:], [*[(k, s + start, e + start) for k, s, e in more], *kept]


def lessons_of(windows: list[str]) -> list[tuple[str, list[Span]]]:
    """Texts with their spans: as the rules find them, rewritten, and with other data right behind or before."""
    known = []
    for text in sorted(windows):
        spans = rule_spans(text)
        known.append((text, [s for s in spans if not any(o != s and o[1] < s[2] and s[1] < o[2] for o in spans)]))
    pool = [(kind, text[start:end]) for text, spans in known for kind, start, end in spans]
    lessons, turn = [], 0
    for text, spans in known:
        lessons.append((text, spans))
        for span in spans:
            kind, start, end = span
            own = text[start:end]
            forms = [own, *rewritten(kind, own)]
            for other in forms[1:]:
                lessons.append(_replaced(text, spans, span, other, [(kind, 0, len(other))]))
            for behind in (True, False):
                # Any form of this one beside any other data of the sample, turn by turn.
                turn += 1
                form, (next_kind, beside) = forms[turn % len(forms)], pool[turn * 7919 % len(pool)]
                first, second = ((kind, form), (next_kind, beside)) if behind else ((next_kind, beside), (kind, form))
                gap = (" ", ", ", " / ", "\n")[turn // 2 % 4]
                both = [(first[0], 0, len(first[1])), (second[0], len(first[1]) + len(gap), len(first[1]) + len(gap) + len(second[1]))]
                lessons.append(_replaced(text, spans, span, first[1] + gap + second[1], both))
    return lessons


def learn(windows: list[str], batches: int = 500, hidden: int = 16, seed: int = 5) -> Detector:
    """Train a tagger on the rules' spans in these texts of about a window, and on copies with rewritten and added data."""
    lessons = [_lesson(*lesson) for lesson in lessons_of(windows)]
    if not any(tags.any() for _, tags in lessons):
        return Detector(None)
    tagger = Tagger.fresh(5 + len(SYMBOLS), hidden, allowed_steps(), seed)
    codes, tags = np.stack([c for c, _ in lessons]), np.stack([t for _, t in lessons])
    tagger.train(codes, tags, batches, 48, 0.02, seed)
    return Detector(tagger)


def train(docs: DataFrame, documents: int = 20_000, windows: int = 8, seed: int = 5) -> Detector:
    """Learn from windows with a trigger in about `documents` documents, chosen by a hash of doc_id.

    Both bounds are on the sample for training alone: of each of these documents `windows` windows, from anywhere in
    the text, go to the driver, those with the smallest hash.
    """
    ship(docs.sparkSession)
    rate = min(1.0, documents / max(1, docs.count()))
    chosen = docs.where(F.coalesce(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)), F.lit(False)))

    def some(text: str) -> list[str]:
        parts = {text[w : w + WINDOW] for w in windows_of(text)}
        return heapq.nsmallest(windows, parts, key=lambda part: (zlib.crc32(part.encode(), seed), part))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").filter(pc.match_substring_regex(batch.column("text"), TRIGGER)).to_pylist()
            parts = [part for text in texts for part in some(text)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["part"])

    rows = chosen.select(text_or_empty().alias("text")).mapInArrow(cut, "part string").distinct().toArrow()
    return learn(rows["part"].to_pylist(), seed=seed)


def find_spans(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id and all spans of each whole text, by kind (as in KINDS) and start; positions count code points.

    `base` tells whether a rule found the span, `share` is the tagger's least probability of its characters (1 for a rule's).
    Null and empty texts have no spans. Repeated rows have the same spans. An empty table gives no rows. Other columns
    are not looked at.
    """
    ship(docs.sparkSession)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count in slices(batch.column("text"), 4 << 20):
                part = batch.slice(first, count)
                hit = pc.match_substring_regex(part.column("text"), TRIGGER)
                found = iter(detector.find(part.column("text").filter(hit).to_pylist()))
                rows = [
                    [{"kind": KINDS[k], "start": s, "end": e, "base": b, "share": p} for k, s, e, b, p in next(found)] if some else []
                    for some in hit.to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, _SPAN_TYPE)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(find, SPANS)
