"""Personal data: base patterns plus a semi-Markov conditional random field over whole candidate spans.

Base spans are exact patterns (KINDS in order; leftmost, non-overlapping within a kind; a match that fails its check is
dropped without another try). The semi-Markov CRF looks for what they miss: numbers and addresses written another way,
as (555) 010-7788, 10[.]0[.]0[.]7 or jo [at] example [dot] com. Text around digits and bracketed ats is cut into
groups; a candidate is any run of at most MOST_GROUPS groups, scored for each kind by features of the whole span (digit
counts, group shape, separators, Luhn, octets, cue words, neighbours). Dynamic programming over these bounded
candidates chooses boundaries and kinds together. Its weights are fitted by maximum likelihood on generated lines.
Added spans never overlap base spans, which always stay.

Offsets count code points; ends are exclusive. Defined results: a null or empty text has no span; equal texts get
equal results; spans that start together are listed in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepframe.llm.arrow_text import chunks

KINDS = ("email", "ip", "card", "phone")
MOST_GROUPS = 8

DIGIT = re.compile("[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start behind a digit can only match what the start of that run matches, so the look-behind changes no result
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind. Every search is linear in the text."""
    out: list[Span] = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            m = DOMAIN.match(text, at + 1)
            if m:
                start = at
                while start > done and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    out.append((start, m.end(), 0))
                    done = m.end()
            at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) < 4 and int(p or "0") < 256 for p in (x.lstrip("0") for x in m.group().split("."))):
                out.append((*m.span(), 1))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- candidates of the CRF

NUMBERS = re.compile(r"(?:\+|\()?[0-9]++(?:[\x20().\-/\[\]_]{1,3}\+?[0-9]++)*+")
GROUP, OTHER = re.compile("[0-9]+"), re.compile("[^0-9]+")
VEILED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)*+")
CUES = {
    "phone": 1, "tel": 1, "call": 1, "mobile": 1, "fax": 1, "cell": 1,
    "card": 2, "visa": 2, "credit": 2, "debit": 2, "pan": 2,
    "ip": 3, "host": 3, "server": 3, "address": 3,
    "order": 4, "invoice": 4, "id": 4, "no": 4, "version": 4, "page": 4, "isbn": 4, "token": 4, "license": 4,
}
WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*$")
FEATURES = 1 << 12


def _feature(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=4).digest(), "little") % FEATURES


_KNOWN: dict = {}


def signature(text: str, start: int, end: int, region: tuple[int, int]) -> tuple:
    """What the features of a whole candidate span see of it: (name, value, ...) for each feature."""
    body = text[start:end]
    groups = GROUP.findall(body)
    digits = "".join(groups)
    gaps = OTHER.findall(body)
    letters = any(c.isalpha() for c in body)
    before, after = text[start - 1 : start], text[end : end + 1]
    m = WORD_BEFORE.search(text, max(0, start - 16), start)
    cue = CUES.get(m.group(1).lower(), 0) if m else 0
    out = [
        ("bias",),
        ("digits", min(len(digits), 20)),
        ("shape", "-".join(str(min(len(g), 5)) for g in groups[:5]) if len(groups) <= 5 else "many"),
        ("seps", "".join(sorted({c for g in gaps for c in g if not (c.isascii() and c.isalpha())}))[:6]),
        ("cue", cue),
        ("edge", before.isalnum(), after.isalnum()),
        ("open", body[:1] in "+(", before in ("+", "(")),
        ("whole", (start, end) == region),
        ("letters", letters),
    ]
    if 13 <= len(digits) <= 19:
        out.append(("luhn", luhn(digits)))
    if len(groups) == 4:
        out.append(("octets", all(len(g) < 4 and int(g) < 256 for g in groups), len(set(gaps)) == 1))
    if letters and "at" in body.lower():
        out.append(("veiled", "dot" in body.lower() or "." in body))
    return tuple(out)


def span_features(kind: int, seen: tuple) -> list[int]:
    """Numbers of the features of a candidate span of a kind, from its signature."""
    got = _KNOWN.get((kind, seen))
    if got is None:
        if len(_KNOWN) > 100_000:
            _KNOWN.clear()
        got = _KNOWN[kind, seen] = [_feature(name, kind, *values) for name, *values in seen]
    return got


def regions(text: str) -> Iterator[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """((start, end), groups): stretches of text that may hold spans."""
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            groups = [g.span() for g in GROUP.finditer(text, m.start(), m.end())]
            if sum(e - s for s, e in groups) < 4:
                continue
            first = groups[0]
            groups[0] = (m.start(), first[1])
            yield m.span(), groups
    low = text.lower()
    if "at]" in low or "at)" in low or "at}" in low or "at ]" in low or "at )" in low or "at }" in low:
        for m in VEILED.finditer(text):
            yield m.span(), [m.span()]


def candidates(text: str, region: tuple[int, int], groups: list[tuple[int, int]]) -> list[tuple[int, int, int, list[int]]]:
    """(first group, group behind the last, kind, features) of every candidate span."""
    out = []
    for i in range(len(groups)):
        for j in range(i + 1, min(len(groups), i + MOST_GROUPS) + 1):
            start, end = groups[i][0], groups[j - 1][1]
            if i and text[start - 1] in "+(":
                start -= 1
            body = text[start:end]
            n = sum(map(str.isdigit, body))
            veiled = any(map(str.isalpha, body))
            if n > 19 and not veiled:
                break  # more groups hold more digits
            if n > 19 or (n < 4 and not veiled):
                continue
            seen = signature(text, start, end, region)
            out += [(i, j, kind, span_features(kind, seen)) for kind in range(len(KINDS)) if veiled == (kind == 0)]
    return out


class SemiMarkov:
    """P(segmentation) proportional to exp(sum of its spans' scores); groups outside any span score 0."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros(FEATURES) if weights is None else weights

    def scores(self, cands: list) -> list[float]:
        w = self.weights.tolist() if len(cands) > 50 else self.weights
        return [float(sum(w[f] for f in c[3])) for c in cands]

    def best(self, n: int, cands: list) -> list[tuple[int, int, int]]:
        """The likeliest segmentation, as (first group, group behind the last, kind)."""
        ends: list[list] = [[] for _ in range(n + 1)]
        for c, s in zip(cands, self.scores(cands), strict=True):
            ends[c[1]].append((s, c))
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for s, c in ends[j]:
                if top[c[0]] + s > top[j]:
                    top[j], back[j] = top[c[0]] + s, c
        out, j = [], n
        while j:
            c = back[j]
            if c is None:
                j -= 1
            else:
                out.append(c[:3])
                j = c[0]
        return out[::-1]

    def gradient(self, n: int, cands: list, truth: set[tuple[int, int, int]], into: dict[int, float]) -> None:
        """Adds the gradient of the log-likelihood: features of true spans less their expectation."""
        scores = self.scores(cands)
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        by_end: list[list] = [[] for _ in range(n + 1)]
        by_start: list[list] = [[] for _ in range(n + 1)]
        for k, c in enumerate(cands):
            by_end[c[1]].append(k)
            by_start[c[0]].append(k)

        def total(terms: list[float]) -> float:
            m = max(terms)
            return m + math.log(sum(math.exp(t - m) for t in terms))

        for j in range(1, n + 1):
            alpha[j] = total([alpha[j - 1], *(alpha[cands[k][0]] + scores[k] for k in by_end[j])])
        for i in range(n - 1, -1, -1):
            beta[i] = total([beta[i + 1], *(scores[k] + beta[cands[k][1]] for k in by_start[i])])
        for k, (i, j, kind, features) in enumerate(cands):
            delta = float((i, j, kind) in truth) - math.exp(alpha[i] + scores[k] + beta[j] - alpha[n])
            for f in features:
                into[f] = into.get(f, 0.0) + delta


def training_lines(rng: np.random.Generator, n: int = 420) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated lines with their true spans (start, end, kind)."""
    words = "the of and ren tion lor vas mi der la que est onde tar bel".split()

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def card() -> str:
        body = digits(15)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def phone() -> str:
        a, b, c = str(rng.integers(200, 999)), str(rng.integers(200, 999)), digits(4)
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}"][rng.integers(6)]

    def octets() -> str:
        sep = ["[.]", "(.)", " . ", "."][rng.integers(4)]
        return sep.join(str(x) for x in rng.integers(0, 256, 4))

    def mail() -> str:
        a, d = (["[at]", "(at)", "{at}", "[ at ]"][rng.integers(4)], ["[dot]", "(dot)", "."][rng.integers(3)])
        gap = "" if d == "." else [" ", ""][rng.integers(2)]
        return f"{words[rng.integers(len(words))]}.{digits(2)}{gap}{a}{gap}mail{digits(1)}{gap}{d}{gap}example"

    def spaced_card() -> str:
        x = card()
        return [" ", "-", ".", "  "][rng.integers(4)].join(x[k : k + 4] for k in range(0, 16, 4))

    def nothing() -> str:
        return [digits(rng.integers(4, 13)), f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(10, 99)}", digits(16) + "0", f"{digits(4)}/{digits(4)}", f"{digits(6)} {digits(6)}", f"{rng.integers(300, 999)}.{rng.integers(300, 999)}.{digits(1)}.{digits(1)}", digits(rng.integers(20, 40)), f"1{digits(3)}, 2{digits(3)}", digits(16)][rng.integers(10)]

    cue = {0: ["mail", "write"], 1: ["ip", "host"], 2: ["card", "visa"], 3: ["phone", "call", "tel"], 4: ["order", "id", "invoice", "page", "token"]}
    makers = [mail, octets, spaced_card, phone, nothing]
    out = []
    for _ in range(n):
        kind = int(rng.choice(5, p=[0.12, 0.14, 0.14, 0.2, 0.4]))
        lead = " ".join(rng.choice(words, 3)) + (" " + str(rng.choice(cue[kind])) + [":", "", " is"][rng.integers(3)] if rng.random() < 0.5 else "") + " "
        body = makers[kind]()
        out.append((f"{lead}{body} {' '.join(rng.choice(words, 2))}", [(len(lead), len(lead) + len(body), kind)] if kind < 4 else []))
    return out


def train(seed: int = 5, epochs: int = 30, rate: float = 0.3, l2: float = 0.002) -> SemiMarkov:
    """Maximum likelihood with an L2 penalty, by AdaGrad over the generated lines."""
    data = []
    for text, truth in training_lines(np.random.default_rng(seed)):
        for region, groups in regions(text):
            cands = candidates(text, region, groups)
            edges = {(groups[i][0] - (1 if i and text[groups[i][0] - 1] in "+(" else 0), groups[j - 1][1], k): (i, j, k) for i, j, k, _ in cands}
            data.append((len(groups), cands, {edges[t] for t in truth if t in edges}))
    model, squares = SemiMarkov(), np.full(FEATURES, 1e-6)
    for _ in range(epochs):
        grad: dict[int, float] = {}
        for n, cands, truth in data:
            if cands:
                model.gradient(n, cands, truth, grad)
        g = np.zeros(FEATURES)
        g[list(grad)] = list(grad.values())
        g -= l2 * len(data) * model.weights
        squares += g * g
        model.weights += rate * g / np.sqrt(squares)
    return model


def added_spans(text: str, model: SemiMarkov, base: list[Span]) -> list[Span]:
    """Spans of the CRF that overlap no base span."""
    out: list[Span] = []
    taken = _merged(base)
    for region, groups in regions(text):
        if len(groups) < 2 and region[1] - region[0] < 4:
            continue
        # groups left and right of a base span must not meet in one span
        run: list[tuple[int, int]] = []
        for g in [*groups, None]:
            if g is not None and not _meets(taken, *g):
                run.append(g)
                continue
            if run:
                for i, j, kind in model.best(len(run), candidates(text, region, run)):
                    start = run[i][0] - (1 if i and text[run[i][0] - 1] in "+(" else 0)
                    out.append((start, run[j - 1][1], kind))
            run = []
    return [s for s in out if not _meets(taken, s[0], s[1])]


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans (by start) cover."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in spans:
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _meets(stretches: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether [start, end) overlaps a stretch: the last one that begins before `end` decides."""
    k = bisect_left(stretches[0], end) - 1
    return k >= 0 and stretches[1][k] > start


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find(text: str | None, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text, by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted([*base, *added_spans(text, model, base)], key=lambda s: (s[0], s[2], s[1]))


def personal_data(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, counts and hash of the base spans, all spans, and how many the CRF added."""
    model = model or train()
    weights = model.weights  # FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiMarkov(weights)
        for b in chunks(batches):
            rows = []
            for text in b.column(1).to_pylist():
                base, spans = find(text, crf)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)))
            cols = list(zip(*rows, strict=True))
            kind = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kind, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """docs with all spans of personal data masked in text; n_chars, where there is one, follows the text."""
    model = model or train()
    weights = model.weights
    names = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiMarkov(weights)
        for b in chunks(batches):
            at = names.index("text")
            texts = [t if t is None else masked(t, find(t, crf)[1]) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([n if t is None or n is None else len(t) for t, n in zip(texts, cols[k].to_pylist(), strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
