"""Personal data: base patterns, and a linear-chain CRF that adds spans to them.

The CRF labels white-space tokens O, B-kind or I-kind from word-shape features.  It is
trained by maximum likelihood from a small labelled table (``labelled_rows`` makes one
from templates and a seed) and decoded by Viterbi over batches of sequences in numpy.
Tokens further than ``CONTEXT`` from any token with a digit, an ``@`` or a spelled-out
"dot" are O by the label set's definition, so sequences are the stretches near those.
A decoded span is added if it touches no base span and each of its tokens is labelled
with a probability of ``SURE`` or more; base spans always stay.

Defined results: null and empty texts have no spans; offsets are code points, end
exclusive; spans are ordered by kind (email, ip, card, phone), then start; repeated or
null doc_ids keep a row each; other columns are passed through by ``find`` unless they
bear the names of its results.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import memory, wordhash

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CONTEXT = 3
SURE = 0.9
BITS = 13

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails from its start fails from any later place in it, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches, leftmost and non-overlapping by kind, that pass their kind's test."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---- the labelled table ----------------------------------------------------


def labelled_rows(n: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Short texts with their spans: spelled-out mail addresses and national phone numbers, and look-alikes that are none."""
    rng = random.Random(seed)
    syllables = "an ber co der en for gen ha in jo ka lo men nor on per qui ra sen tor un ver wo za".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def digits(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card(k, valid=True):
        """Digits that pass the card numbers' checksum, or just do not."""
        body = digits(k - 1)
        return body + rng.choice([d for d in "0123456789" if luhn(body + d) == valid])

    def fours(number, sep=" "):
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def cards():
        """Two or three card numbers side by side, or one beside another number: base patterns join these."""
        if rng.random() < 0.5:
            return [card(rng.randint(13, 19)) for _ in range(rng.randint(2, 3))]
        return [rng.choice([fours, str])(card(16)) for _ in range(2)]

    def phrase(k):
        return " ".join(word() for _ in range(k))

    def positive():
        kind = rng.choice(("email", "email", "phone", "phone", "ip", "card"))
        if kind == "email":
            if rng.random() < 0.4:
                return kind, f"{word()}.{word()}@{word()}.{rng.choice(['com', 'org', 'net'])}"
            at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
            return kind, f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net'])}"
        if kind == "phone":
            return kind, rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return kind, rng.choice([fours(card(16)), fours(card(16), "-"), card(rng.randint(13, 19)), card(16)])

    def negative():
        return rng.choice([f"{digits(1)}.{digits(1)}.{digits(1)}", digits(rng.randint(1, 12)), card(rng.randint(13, 19), False), digits(20), f"{digits(4)}-{digits(2)}-{digits(2)}", fours(card(16, False)), f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(3)},{digits(3)}", f"{word()}{digits(2)}{word()}", f"| {digits(2)} | {digits(3)} | {digits(2)} |", f"{digits(3)} {digits(3)} {digits(4)}", "the dot is at the end", ".".join(str(rng.randint(200, 999)) for _ in range(4))])

    rows = []
    for i in range(n):
        text = phrase(rng.randint(1, 5)) + " "
        spans = []
        if i % 8 == 1:
            body = ""
            if rng.random() < 0.4:
                body = digits(rng.randint(1, 6)) + " "
                numbers = [card(rng.randint(13, 19))]
            else:
                numbers = cards()
            for number in numbers:
                spans.append(("card", len(text) + len(body), len(text) + len(body) + len(number)))
                body += number + " "
            body = body[:-1]
        elif i % 2:
            kind, body = positive()
            spans.append((kind, len(text), len(text) + len(body)))
        else:
            body = negative()
        rows.append((text + body + rng.choice(["", ".", ","]) + " " + phrase(rng.randint(1, 5)), spans))
    return rows


# ---- sequences and features -------------------------------------------------

_TOKEN = re.compile(r"\S+")
_SIGNAL = re.compile(r"[0-9@]|^\W*dot\W*$")
_CUES = frozenset("at dot call tel phone fax mobile mail email e-mail card ip address com org net".split())


def _shape(token: str) -> str:
    out, last, run = [], "", 0
    for c in token[:64]:
        k = "d" if c.isdigit() else "a" if c.isalpha() else c
        if k == last:
            run += 1
            continue
        if last == "d":
            out.append(str(min(run, 9)))
        out.append(k)
        last, run = k, 1
    if last == "d":
        out.append(str(min(run, 9)))
    return "".join(out)


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of tokens (start, end) near a signal token."""
    if not _SIGNAL_ANY.search(text):
        return []
    spans = [m.span() for m in _TOKEN.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    reach = -1
    for i, (a, b) in enumerate(spans):
        if _SIGNAL.search(text[a:b]):
            low = max(reach + 1, i - CONTEXT)
            if low > reach + 1 or not out:
                out.append([])
            high = min(len(spans) - 1, i + CONTEXT)
            out[-1].extend(spans[low : high + 1])
            reach = high
    return out


_SIGNAL_ANY = re.compile(r"[0-9@]|\bdot\b")


_EDGE = "\"'<>[]{},;:.!?()"


def card_marks(words: list[str]) -> list[str]:
    """For each word whether it begins ("B") or goes on ("I") a number of 13 to 19 digits that passes the cards' checksum, is one that fails it ("n"), or none.

    Words of four digits count where a run of them is cut into valid fours of words without a rest.
    """
    out = [""] * len(words)
    bare = [w.strip(_EDGE) if w[:1].isascii() and any(c.isdigit() for c in w) else "" for w in words]
    i = 0
    while i < len(bare):
        number = bare[i].replace("-", "")
        if not (number.isascii() and number.isdigit()):
            i += 1
            continue
        if 13 <= len(number) <= 19:
            out[i] = "B" if luhn(number) else "n"
        to = i
        while to < len(bare) and len(bare[to]) == 4 and bare[to].isascii() and bare[to].isdigit():
            to += 1
        if to > i and (to - i) % 4 == 0:
            valid = all(luhn("".join(bare[k : k + 4])) for k in range(i, to, 4))
            out[i:to] = ["n"] * (to - i) if not valid else ["B", "I", "I", "I"] * ((to - i) // 4)
        i = max(to, i + 1)
    return out


def features(text: str, seq: list[tuple[int, int]]) -> list[list[int]]:
    words = [text[a:b] for a, b in seq]
    marks = card_marks(words)
    shapes = ["^", *(_shape(w) for w in words), "$"]
    cues = ["", *(c if (c := w.strip(".,;:[]()").lower()) in _CUES else "" for w in words), ""]
    out = []
    for i in range(1, len(words) + 1):
        s, p, n = shapes[i], shapes[i - 1], shapes[i + 1]
        out.append([_hash(f) for f in (f"s{s}", f"p{p}", f"n{n}", f"ps{p} {s}", f"sn{s} {n}", f"c{cues[i]}", f"cp{cues[i - 1]}", f"cn{cues[i + 1]}", f"m{marks[i - 1]}", f"ms{marks[i - 1]}{s}")])
    return out


# ---- the model ---------------------------------------------------------------


@dataclass
class Crf:
    """Weights: feature by label, label by label, and the first label's."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def scores(self, feats: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(f) for f in feats])
        flat = np.array([t for f in feats for t in f])
        owner, pos = wordhash.ragged(size)
        out = np.zeros((len(feats), int(size.max()), len(LABELS)))
        out[owner, pos] = self.emit[flat].sum(1)
        return out, size

    def _sweep(self, e: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log-sums, and each sequence's log-partition."""
        n, t, k = e.shape
        f, b = np.zeros((n, t, k)), np.zeros((n, t, k))
        f[:, 0] = e[:, 0] + self.first
        for i in range(1, t):
            f[:, i] = e[:, i] + _lse(f[:, i - 1, :, None] + self.move, 1)
        for i in range(t - 2, -1, -1):
            step = _lse(self.move[None] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where((i + 1 < size)[:, None], step, 0.0)
        return f, b, _lse(f[np.arange(n), size - 1], 1)

    def viterbi(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        n, t, k = e.shape
        best, back = e[:, 0] + self.first, np.zeros((n, t, k), np.int8)
        tails = np.zeros((n, k))
        tails[size == 1] = best[size == 1]
        for i in range(1, t):
            step = best[:, :, None] + self.move
            back[:, i] = step.argmax(1)
            best = step.max(1) + e[:, i]
            tails[size == i + 1] = best[size == i + 1]
        path = np.zeros((n, t), np.int8)
        state = tails.argmax(1)
        for i in range(t - 1, -1, -1):
            state = np.where(i == size - 1, tails.argmax(1), state)
            path[:, i] = np.where(i < size, state, 0)
            if i:
                state = np.where(i < size, back[np.arange(n), i, state], state)
        return path

    def decode(self, feats: list[list[list[int]]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each sequence its Viterbi labels and their marginal probabilities."""
        order = sorted(range(len(feats)), key=lambda i: len(feats[i]))
        out: list = [None] * len(feats)
        at = 0
        while at < len(order):
            some = order[at : at + max(1, 20_000 // len(feats[order[min(at + 2000, len(order)) - 1]]))]
            e, size = self.scores([feats[i] for i in some])
            path = self.viterbi(e, size)
            f, b, z = self._sweep(e, size)
            sure = np.exp(np.take_along_axis(f + b, path[:, :, None].astype(int), 2)[:, :, 0] - z[:, None])
            for r, i in enumerate(some):
                out[i] = path[r, : size[r]], sure[r, : size[r]]
            at += len(some)
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 120, rate: float = 0.1, l2: float = 1e-3) -> Crf:
    """Fit by Adam on the penalised log-likelihood of ``(text, spans)`` rows.  Rows without a sequence teach nothing."""
    feats, gold = [], []
    for text, spans in rows:
        for seq in sequences(text):
            labels = []
            for a, b in seq:
                hit = next((s for s in spans if s[1] < b and a < s[2]), None)
                labels.append(0 if hit is None else LABELS.index(("B-" if a <= hit[1] else "I-") + hit[0]))
            feats.append(features(text, seq))
            gold.append(labels)
    k = len(LABELS)
    crf = Crf(np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k))
    if not feats:
        return crf
    size = np.array([len(f) for f in feats])
    n, t = len(feats), int(size.max())
    owner, pos = wordhash.ragged(size)
    flat = np.array([x for f in feats for x in f])
    y = np.concatenate([np.array(g) for g in gold])
    want_emit = np.zeros_like(crf.emit)
    np.add.at(want_emit, flat, np.eye(k)[y][:, None, :])
    want_move, want_first = np.zeros((k, k)), np.bincount(y[pos == 0], minlength=k)
    inner = np.flatnonzero(pos > 0)
    np.add.at(want_move, (y[inner - 1], y[inner]), 1)
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (crf.emit, crf.move, crf.first)]
    for step in range(1, epochs + 1):
        e, _ = crf.scores(feats)
        f, b, z = crf._sweep(e, size)
        here = np.exp(f + b - z[:, None, None])[owner, pos]
        got_emit = np.zeros_like(crf.emit)
        for c in range(flat.shape[1]):
            for lab in range(k):
                got_emit[:, lab] += np.bincount(flat[:, c], here[:, lab], 1 << BITS)
        pair = np.exp(f[:, :-1, :, None] + crf.move + (e + b)[:, 1:, None, :] - z[:, None, None, None])
        pair *= (np.arange(1, t)[None] < size[:, None])[:, :, None, None]
        grads = (want_emit - got_emit, want_move - pair.sum((0, 1)), want_first - here[pos == 0].sum(0))
        for w, g, m in zip((crf.emit, crf.move, crf.first), grads, state, strict=True):
            g = g / n - l2 * w
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            w += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return crf


def added_spans(crf: Crf, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the CRF finds beside the base spans of each text."""
    where, feats = [], []
    for i, text in enumerate(texts):
        for seq in sequences(text):
            where.append((i, seq))
            feats.append(features(text, seq))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, seq), (path, sure) in zip(where, crf.decode(feats), strict=True):
        j = 0
        while j < len(seq):
            label = LABELS[path[j]]
            if not label.startswith("B-"):
                j += 1
                continue
            kind, to = label[2:], j + 1
            while to < len(seq) and LABELS[path[to]] == f"I-{kind}":
                to += 1
            start, end = seq[j][0], seq[to - 1][1]
            body = texts[i][start:end]
            start += len(body) - len(body.lstrip("\"'<[{,;:"))
            end -= len(body) - len(body.rstrip("\"'>]},;:.!?"))
            if end > start and sure[j:to].min() >= SURE and not any(a < end and start < b for _, a, b in bases[i]):
                out[i].append((kind, start, end))
            j = to
    return out


def all_spans(crf: Crf, texts: list[str]) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text, each by kind as listed, then start."""
    bases = [base_spans(t) for t in texts]
    more = added_spans(crf, texts, bases)
    rank = KINDS.index
    return bases, [sorted(b + m, key=lambda s: (rank(s[0]), s[1])) if m else b for b, m in zip(bases, more, strict=True)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def _model(docs: DataFrame, crf: Crf | None):
    crf = crf or train(labelled_rows())
    return docs.sparkSession.sparkContext.broadcast((crf.emit.astype(np.float32), crf.move, crf.first))  # 0.3 MB, fixed


def _texts(part: pa.RecordBatch) -> list[str]:
    return [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]


def find(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """``doc_id`` with counts of base spans by kind, their digest, and all spans."""
    shared = _model(docs, crf)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    @memory.task("pii")
    def run(batches):
        crf = Crf(*shared.value)
        for batch in batches:
            for part in wordhash.slices(batch):
                bases, every = all_spans(crf, _texts(part))
                counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digests, pa.array([joined(s) for s in every])], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` masked; a null text stays null; other columns are untouched."""
    shared = _model(docs, crf)
    schema = T.StructType(docs.schema.fields)

    @memory.task("pii")
    def run(batches):
        crf = Crf(*shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in wordhash.slices(batch):
                texts = part.column(at).to_pylist()
                _, every = all_spans(crf, [t or "" for t in texts])
                masked = pa.array([t if t is None else mask(t, s) for t, s in zip(texts, every, strict=True)], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([masked if i == at else c for i, c in enumerate(part.columns)], part.schema.names)

    return docs.mapInArrow(run, schema)
