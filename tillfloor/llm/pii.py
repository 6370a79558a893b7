"""Personal data: a semi-Markov conditional random field over whole candidate spans.

Base spans come from four fixed patterns. A semi-Markov CRF then reads the stretches of text
around digits, at-signs and spelled-out ones ('(at)', '[at]', ' at ' before a dotted word): a stretch is cut into units (digit runs, letter runs,
single other characters), every run of up to `MAX_UNITS` units that could be an entity is scored
as a whole by its features and type, and dynamic programming picks boundaries and types
together. Decoded spans that touch no base span are added; base spans always stay.

The weights are learned here, by gradient ascent on the conditional likelihood, from a
sample of `sample` documents that hold a trigger (the smallest text hashes; the bound is
that parameter). The base spans of the sample are the segments to find; written in other ways
(no plus sign, other separators, a spelled at-sign) they teach forms that the patterns miss.

A null or empty text has no spans. Repeated rows each get their row. Whole texts are read;
work is linear in their length. Spans are code points, end exclusive. Columns other than
id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillfloor.llm.common import by_document, spans_text, text_rows

# Kinds in their listed order, and what their spans consist of.
KINDS = ("email", "ip", "card", "phone")
RANK = {k: i for i, k in enumerate(KINDS)}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every ip, card or phone lies in one such stretch.
_STRETCH = re.compile(r"[0-9+][0-9\x20().+-]*")
_TRIGGER = re.compile(r"[0-9@]")
#: What a spelled-at address has instead of '@': a bracketed at, or an at that a dotted word follows. Triggers of the field alone.
_OPENS = re.compile(r"[0-9@]|[(\[]\x20?(?i:at)\x20?[)\]]|(?<=\x20)(?i:at)(?=\x20[A-Za-z0-9-]+\.[A-Za-z0-9])")
_SPELLED_AT = re.compile(r"\x20?[(\[]\x20?at\x20?[)\]]\x20?|\x20at\x20", re.I)

MAX_UNITS = 16
AROUND = 48
_SPACE = re.compile(r"\s")
_UNIT = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the four patterns, leftmost and non-overlapping by kind."""
    out = []
    last, at = 0, text.find("@")
    while at != -1:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, "email", m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for stretch in _STRETCH.finditer(text):
        if stretch.end() - stretch.start() < 7:
            continue
        off, part = stretch.start(), stretch.group()
        for m in _IP.finditer(part):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                out.append((off + m.start(), 1, "ip", off + m.end()))
        for m in _CARD.finditer(part):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((off + m.start(), 2, "card", off + m.end()))
        for m in _PHONE.finditer(part):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((off + m.start(), 3, "phone", off + m.end()))
    return sorted(out)


# --- the model

FEATURES = (
    "bias", "has_at", "spelled_at", "one_at", "dot_after_at", "letters", "only_digits", "plus", "parens", "luhn",
    "four_groups", "octets", "dots_only", "dashes", "spaces", "mixed_marks", "digits_7_8", "digits_9_11",
    "digits_12_15", "digits_16", "digits_17_19", "groups_1", "groups_2_3", "groups_4", "groups_5", "group_of_4_last",
    "equal_groups", "left_open", "right_open", "left_glued", "right_glued", "long_tail", "cue_phone", "cue_mail",
    "cue_card", "cue_ip", "unbroken_parts", "runs_on",
)
_AT = {name: i for i, name in enumerate(FEATURES)}
# Words that announce a kind.
CUES = {
    "cue_phone": ("tel", "phone", "call", "fax", "mobile", "mobil", "telefon"), "cue_mail": ("mail", "email", "contact"),
    "cue_card": ("card", "visa", "carte", "karte", "tarjeta"), "cue_ip": ("ip", "host", "addr", "server"),
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
_MARKS = set(".-() +")


def units_of(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    out = []
    for m in _UNIT.finditer(text, start, end):
        c = m.group()[0]
        out.append((m.start(), m.end(), "d" if c in "0123456789" else "a" if c.isalpha() else "s" if c.isspace() else c))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches from `AROUND` characters before a trigger to as many behind it, out to white space; none overlap.

    What has spaces inside has a trigger near its end, which takes the stretch beyond it.
    """
    out: list[list[int]] = []
    for m in _OPENS.finditer(text):
        at = m.start()
        if out and at < out[-1][1] - AROUND // 2:
            continue
        low, high = max(0, at - AROUND), min(len(text), at + AROUND)
        known = out[-1][1] if out else 0
        while low > known and not text[low - 1].isspace():
            low -= 1
        if high < len(text) and (gap := _SPACE.search(text, high)):
            high = gap.start()
        elif high < len(text):
            high = len(text)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def candidates(text: str, units: list[tuple[int, int, str]]) -> list[tuple[int, int, list[int]]]:
    """(first unit, unit after the last, features) of every run of units that could be an entity."""
    out = []
    n = len(units)
    cue = None
    for i, (a, b, c) in enumerate(units):
        if c == "a" and b - a <= 8:
            cue = _CUE_OF.get(text[a:b].lower(), cue)
        if c == "s" and text[a] == "\n":
            cue = None
        if c not in "da+(":
            continue
        digits = groups = ats = marks = letters = 0
        for j in range(i, min(n, i + MAX_UNITS)):
            s, e, k = units[j]
            if k == "d":
                digits, groups = digits + e - s, groups + 1
                if digits > 24:
                    break
            elif k == "a":
                letters += 1
            elif k == "@":
                ats += 1
            elif k == "s":
                marks += 1
                # a spelled at-sign has spaces and brackets of its own
                if text[s] == "\n" or (letters and ats == 0 and marks > 2 and not _SPELLED_AT.search(text, a, e + 5)):
                    break
            elif k in _MARKS or k in "_%[]":
                marks += 1
            else:
                break
            if k not in "da":
                continue
            if ats == 0 and letters and "at" not in text[units[i][0] : e].lower():
                continue
            if ats == 0 and not letters and not 7 <= digits <= 19:
                continue
            out.append((i, j + 1, _features(text, units, i, j + 1, cue, digits, groups, ats, letters)))
    return out


def _features(text, units, i, j, cue, digits, groups, ats, letters) -> list[int]:
    span = text[units[i][0] : units[j - 1][1]]
    parts = [text[a:b] for a, b, c in units[i:j] if c == "d"]
    marks = {c for _, _, c in units[i:j] if c not in "da"}
    on = ["bias"]
    add = on.append
    if ats:
        add("has_at")
        if ats == 1:
            add("one_at")
        if "." in span[span.rfind("@") :]:
            add("dot_after_at")
    elif letters:
        if m := _SPELLED_AT.search(span):
            add("spelled_at")
            local, domain = span[: m.start()], span[m.end() :]
            if "." in domain:
                add("dot_after_at")
            if local and domain and not re.search(r"[\s(\[\])]", local + domain):
                add("unbroken_parts")
    if letters:
        add("letters")
    else:
        if not marks:
            add("only_digits")
        if span[0] == "+":
            add("plus")
        if "(" in marks and ")" in marks:
            add("parens")
        if 12 <= digits <= 19 and luhn("".join(parts)):
            add("luhn")
        if groups == 4 and marks == {"."}:
            add("four_groups")
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                add("octets")
        kinds = marks - {"+", "(", ")"}
        if len(kinds) > 1:
            add("mixed_marks")
        elif kinds:
            add({".": "dots_only", "-": "dashes", "s": "spaces"}.get(next(iter(kinds)), "mixed_marks"))
        add("digits_7_8" if digits <= 8 else "digits_9_11" if digits <= 11 else "digits_12_15" if digits <= 15
            else "digits_16" if digits == 16 else "digits_17_19")
        add("groups_1" if groups == 1 else "groups_2_3" if groups <= 3 else "groups_4" if groups == 4 else "groups_5")
        if parts and len(parts[-1]) == 4:
            add("group_of_4_last")
        if groups > 1 and len({len(p) for p in parts}) == 1:
            add("equal_groups")
        if span.count("(") != span.count(")"):
            add("long_tail")
    before = units[i - 1][2] if i else "s"
    after = units[j][2] if j < len(units) else "s"
    add("left_open" if before == "s" else "left_glued")
    add("right_open" if after in "s,.;:!?" else "right_glued")
    if letters and j + 1 < len(units) and units[j][2] in ".-" and units[j + 1][2] in "da":
        add("runs_on")
    if cue:
        add(cue)
    return sorted({_AT[x] for x in on})


def _forward(n, segs, scores):
    """Log sums over all segmentations of the first i units; a unit outside a span scores 0."""
    ending = [[] for _ in range(n + 1)]
    for x, (_, j, _) in enumerate(segs):
        ending[j].append(x)
    alpha = [0.0] * (n + 1)
    for t in range(1, n + 1):
        terms = [alpha[t - 1]]
        for x in ending[t]:
            terms += [alpha[segs[x][0]] + s for s in scores[x]]
        top = max(terms)
        alpha[t] = top + math.log(sum(math.exp(v - top) for v in terms)) if len(terms) > 1 else top
    return alpha


def _gradient(weights, n, segs, gold):
    scores = [weights[:, f].sum(axis=1) for _, _, f in segs]
    lists = [s.tolist() for s in scores]
    alpha = _forward(n, segs, lists)
    mirrored = [(n - j, n - i, f) for i, j, f in segs]
    beta = _forward(n, mirrored, lists)
    total = alpha[n]
    grad = np.zeros_like(weights)
    for x, (i, j, f) in enumerate(segs):
        p = np.exp(np.minimum(0, alpha[i] + scores[x] + beta[n - j] - total))
        grad[:, f] -= p[:, None]
        if (kind := gold.get((i, j))) is not None:
            grad[kind, f] += 1
    return grad


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], passes: int = 12) -> np.ndarray:
    """Weights by kind and feature, from stretches of text with their (start, end, kind)."""
    weights = np.zeros((len(KINDS), len(FEATURES)))
    square = np.full_like(weights, 1e-6)
    prepared = []
    for text, spans in examples:
        units = units_of(text, 0, len(text))
        segs = candidates(text, units)
        first, last = {a: i for i, (a, _, _) in enumerate(units)}, {b: i + 1 for i, (_, b, _) in enumerate(units)}
        gold = {(first[a], last[b]): k for a, b, k in spans if a in first and b in last}
        if segs:
            prepared.append((len(units), segs, gold))
    for _ in range(passes):
        for n, segs, gold in prepared:
            grad = _gradient(weights, n, segs, gold) - 1e-3 * weights
            square += grad * grad
            weights += 0.5 * grad / np.sqrt(square)
    return weights


def decode(weights: np.ndarray, text: str, units, segs) -> list[tuple[int, int, str, int]]:
    n = len(units)
    ending = [[] for _ in range(n + 1)]
    for i, j, f in segs:
        score = weights[:, f].sum(axis=1)
        k = int(score.argmax())
        if score[k] > 0:
            ending[j].append((i, k, float(score[k])))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for i, k, s in ending[t]:
            if best[i] + s > best[t]:
                best[t], back[t] = best[i] + s, (i, k)
    out, t = [], n
    while t:
        if back[t] is None:
            t -= 1
        else:
            i, k = back[t]
            out.append((units[i][0], k, KINDS[k], units[t - 1][1]))
            t = i
    return out


def written_otherwise(text: str, kind: str, turn: int) -> str:
    """The same entity in a form that its pattern misses."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        return text.replace("@", (" at ", " (at) ", "[at]")[turn % 3])
    if kind == "phone":
        tail = digits[-10:]
        return (
            f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}",
            f"{tail[:3]} {tail[3:6]} {tail[6:]}", f"00{digits[:2]} {digits[2:5]} {digits[5:]}",
        )[turn % 5]
    if kind == "card":
        return (".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), text)[turn % 2]
    return text


def examples_of(text: str, most: int = 4) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled stretches of one text, as written and written otherwise."""
    spans = base_spans(text)
    out = []
    for low, high in regions(text)[:most]:
        high = min(high, low + 400)
        own = [s for s in spans if s[0] >= low and s[3] <= high]
        if any(s[0] < high and s[3] > low for s in spans if s not in own):
            continue
        part = text[low:high]
        out.append((part, [(a - low, b - low, r) for a, r, _, b in own]))
        for a, rank, kind, b in own[:1]:
            new = written_otherwise(text[a:b], kind, a)
            if new != text[a:b] and len(own) == 1:
                out.append((text[low:a] + new + text[b:high], [(a - low, a - low + len(new), rank)]))
            if len(own) == 1:
                # a time of day is no entity
                out.append((f"{text[low:a]}20{a % 30:02d}-{a % 12 + 1:02d}-{a % 28 + 1:02d} {a % 24:02d}:41:22{text[b:high]}", []))
    return out


def learn(docs: DataFrame, sample: int = 600) -> np.ndarray:
    """Weights from at most `sample` documents: those with a trigger and the smallest text hash.

    Of each, the first four stretches around triggers are examples, at most 400 characters of each.
    A table without any trigger gives zero weights, which add no span.
    """
    held = docs.filter(F.col("text").rlike("@|[0-9]{3}")).select(
        "doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h")
    )
    # an even draw of about twice the sample, so that what is sorted doesn't grow with the corpus
    n = max(1, held.count())
    few = (
        held.filter(F.col("h") * F.lit(float(n)) < F.lit(float(2 * sample << 30)))
        .orderBy("h", "doc_id")
        .limit(sample)
        .select("doc_id", "text")
    )

    def of():
        def each(text: bytes) -> tuple:
            import json

            return (json.dumps(examples_of(text.decode("utf-8", "replace"))),)

        return each

    import json

    rows = by_document(few, of, "examples string").collect()
    return train([(t, [tuple(s) for s in spans]) for r in sorted(rows) for t, spans in json.loads(r.examples)])


def find(weights: np.ndarray):
    def of(text: bytes) -> tuple:
        text = text.decode("utf-8", "replace")
        base = base_spans(text) if _TRIGGER.search(text) else []
        extra = []
        if weights.any():
            for low, high in regions(text):
                units = units_of(text, low, high)
                segs = candidates(text, units)
                if segs:
                    extra += decode(weights, text, units, segs)
        taken = sorted((s[0], s[3]) for s in base)
        ends = np.maximum.accumulate([e for _, e in taken]) if taken else None
        starts = [s for s, _ in taken]
        spans = list(base)
        for s in extra:
            # the last base span that begins before this one ends; spans up to it may still reach in
            at = np.searchsorted(starts, s[3]) if taken else 0
            if at == 0 or ends[at - 1] <= s[0]:
                spans.append(s)
        counts = [sum(s[2] == k for s in base) for k in KINDS]
        return (*counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(spans))

    return of


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 600) -> DataFrame:
    """Base counts, the digest of the base spans, and all spans of every text."""
    rows = text_rows(docs, id_col, text_col)
    weights = learn(rows, sample)
    return by_document(
        rows, lambda: find(weights),
        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )
