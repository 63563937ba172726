"""Personal data: patterns with checks, and a linear-chain conditional random field over word shapes.

The patterns find what has a fixed form. The field adds what only its form and its
neighbours give away (numbers with a misprint behind "card", phone numbers without a plus
sign, addresses spelt with "[at]", account and person numbers). Its features are the shapes
of a word, of the one before and of the one after; it is trained on a small labelled table
by gradient ascent on the conditional likelihood and decoded by Viterbi in numpy batches.

Decoding is exact. A word whose margin for "outside" exceeds all that transitions could gain
must be outside on the best path, so texts are cut there; the stretches between, of one
length at a time, are decoded together.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerwatch.llm.common import ids_and_texts, send, text_blocks, worker_value

#: Kinds of the patterns, in the order that sorts equal starts, and those only the field knows.
KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("person_id", "iban")
ALL_KINDS = KINDS + MORE_KINDS
OUTSIDE = 0
LABELS = 1 + 2 * len(ALL_KINDS)  # outside, then begin and inside of each kind

#: Bounds of the labelled table that a model takes.
MOST_ROWS, MOST_WORDS = 2000, 64

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").finditer
_local = re.compile(r"[A-Za-z0-9._%+-]").match
_ip = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_not_digits = re.compile(r"[^0-9]+")
_words = re.compile(r"\S+").finditer

Span = tuple[int, int, int]  # start, kind number, end


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """Matches of the four patterns that pass their checks; each pattern takes linear time.

    Equal to the leftmost matches of the plain patterns: a run of digits or local-part
    characters that fails from its first place fails from the others too.
    """
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _domain(text):
            start = m.start()
            while start > last and _local(text, start - 1):
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                last = m.end()
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _ip(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in _card(text):
        if m.end() - m.start() >= 12:
            digits = _not_digits.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _phone(text) if 9 <= len(_not_digits.sub("", m[0])) <= 15]
    return sorted(out)


# The word shapes.

_OPEN, _CLOSE = "([{<\"'«", ".,;:!?)]}>\"'»#$%&*|"
#: Spelt-out signs of an address, whose brackets matter.
_SPELT = frozenset(("[at]", "(at)", "{at}", "[dot]", "(dot)"))
_runs = re.compile(r"[0-9]+|[^\W\d_]+|[\W_]").findall
_address = re.compile(r"[^@]+@[^@]+\.[^@.]+\Z").match
_hex = re.compile(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{12,}\Z").match
_dotted = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3})+\Z").match
_has_digit = re.compile(r"[0-9]").search


def core(word: str) -> tuple[int, int]:
    """Start and end of a word without surrounding punctuation; all of it if nothing else is there."""
    start, end = len(word) - len(word.lstrip(_OPEN)), len(word.rstrip(_CLOSE))
    if start >= end or word.lower() in _SPELT:
        return 0, len(word)
    if word[start:end].isdigit() and word[start - 1 : start] == "(" and word[end : end + 1] == ")":
        return start - 1, end + 1  # an area code keeps its brackets
    return start, end


def _size(n: int) -> str:
    return str(n) if n < 5 else "5-8" if n < 9 else "9-11" if n < 12 else "12-19" if n < 20 else "20"


def shape(word: str) -> str:
    """Runs of letters and digits by kind and length; digits as long as a card's tell if they check.

    Addresses are one shape, and so are runs of up to three digits between points.
    """
    if word.isalpha():
        return "Ab" if word[0].isupper() else "ab"
    start, end = core(word)
    inner = word[start:end]
    if inner.lower() in _SPELT:
        return "spelt"
    if inner.isalpha():
        return "Ab" if inner[0].isupper() else "ab"
    if inner.isdigit() and inner.isascii() and 12 <= len(inner) <= 19:
        return "card" if luhn(inner) else "long"
    if "@" in inner:
        return "mail" if _address(inner) else "@"
    if _hex(inner):
        return "hex"
    if _dotted(inner):
        return f"9 . {inner.count('.')}"
    parts = ["9" + _size(len(r)) if r[0].isdigit() else ("X" if r.isupper() else "x") if r[0].isalpha() else r for r in _runs(inner)]
    return " ".join(parts)


def coarse(word: str) -> int:
    """A class for shapes that the training rows lack: letters, digits, both, address signs, other."""
    if word.isalpha():
        return 0
    if not _has_digit(word):
        return 1 if "@" not in word else 2
    return 3 if "@" in word else 4 if any(c.isalpha() for c in word) else 5


CLASSES = 6


class Field:
    """Weights of the field; word types are numbered ``shape * CLASSES + class``, 0 is beyond a text's ends."""

    def __init__(self, shapes: dict[str, int], cues: set[str]):
        self.shapes, self.cues = shapes, cues
        n = (len(shapes) + 2) * CLASSES
        self.weights = np.zeros((3, n, LABELS))  # by this word, the one before, the one after
        self.trans = np.zeros((LABELS, LABELS))

    def type_of(self, word: str) -> int:
        """Number of a word's type; 1 * CLASSES + class stands for an unknown shape."""
        inner = word[slice(*core(word))].lower()
        name = f"={inner}" if inner in self.cues else shape(word)
        return self.shapes.get(name, 1) * CLASSES + coarse(word)

    def finish(self) -> Field:
        """Tables for decoding: per type, the least margin for outside, less what transitions can gain."""
        t = self.trans
        gain = (t[:, :, None] + t[None, :, :]) - (t[:, OUTSIDE][:, None, None] + t[OUTSIDE][None, None, :])
        self.gain = gain.max(axis=(0, 2))  # by the label in the middle
        margins = self.weights[:, :, OUTSIDE : OUTSIDE + 1] - self.weights
        margins[0] -= self.gain
        self.margin = np.delete(margins, OUTSIDE, axis=2).min(axis=2)
        return self


def _encode(field: Field, rows: list[tuple[str, list[Span]]], most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Types and labels of labelled texts, padded to one length on the right and by one word on the left."""
    types, labels = [], []
    for text, spans in rows:
        words, labelled = list(_words(text))[:most_words], []
        for m in words:
            a, b = core(m[0])
            a, b = a + m.start(), b + m.start()
            kind = next((k for s, k, e in spans if s < b and a < e), None)
            first = kind is not None and next(s for s, k, e in spans if s < b and a < e and k == kind) >= m.start()
            labelled.append(OUTSIDE if kind is None else 1 + 2 * kind + (0 if first else 1))
        types.append([field.type_of(m[0]) for m in words])
        labels.append(labelled)
    width = max(map(len, types)) + 1
    pad = lambda xs: np.array([x + [0] * (width - len(x)) for x in xs], np.int64)
    return pad(types), pad(labels)


def train(rows: list[tuple[str, list[Span]]], steps: int = 160, rate: float = 0.2, shrink: float = 1e-5,
          shrink_trans: float = 0.01, most_words: int = MOST_WORDS) -> Field:
    """Fit the field to labelled texts (at most ``MOST_ROWS``, each of up to ``most_words`` words).

    A row is a text and its spans ``(start, kind number, end)``. Words that stand next to a
    span three times at least, and mostly there, count as cues and are shapes of their own.
    """
    rows = rows[:MOST_ROWS]
    near, there = defaultdict(int), defaultdict(int)
    names: dict[str, int] = {}
    for text, spans in rows:
        words = list(_words(text))
        for i, m in enumerate(words):
            there[m[0][slice(*core(m[0]))].lower()] += 1
            if any(s < m.end() and m.start() < e for s, _, e in spans):
                for j in (i - 1, i + 1):
                    if 0 <= j < len(words):
                        near[words[j][0][slice(*core(words[j][0]))].lower()] += 1
            names.setdefault(shape(m[0]), len(names) + 2)
    cues = {w for w, n in near.items() if n >= 3 and 2 * n > there[w] and w.isalpha()}
    for w in sorted(cues):
        names.setdefault(f"={w}", len(names) + 2)
    field = Field(names, cues)
    if not rows:
        return field.finish()
    types, labels = _encode(field, rows, most_words)
    before, after = np.pad(types, ((0, 0), (1, 0)))[:, :-1], np.pad(types, ((0, 0), (0, 1)))[:, 1:]
    # Forget the shape of every seventh word now and then, so that classes alone are learned too.
    unknown = np.where((np.arange(types.size).reshape(types.shape) % 7 == 3) & (types > 0), CLASSES + types % CLASSES, types)
    n, width = types.shape
    eye = np.eye(LABELS)
    target = eye[labels]
    pairs = np.einsum("nti,ntj->ij", target[:, :-1], target[:, 1:])
    pairs[OUTSIDE] += target[:, 0].sum(axis=0)
    slopes = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.trans)]
    for step in range(steps):
        here = unknown if step % 3 == 2 else types
        w = field.weights
        emit = w[0][here] + w[1][before] + w[2][after]
        e, t = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(field.trans)
        ahead, back = np.zeros((width, n, LABELS)), np.ones((width, n, LABELS))
        state = np.repeat(eye[OUTSIDE][None], n, axis=0)
        for i in range(width):
            state = (state @ t) * e[:, i]
            state /= state.sum(axis=1, keepdims=True)
            ahead[i] = state
        for i in range(width - 2, -1, -1):
            b = (back[i + 1] * e[:, i + 1]) @ t.T
            back[i] = b / b.sum(axis=1, keepdims=True)
        chance = ahead * back
        chance = (chance / chance.sum(axis=2, keepdims=True)).transpose(1, 0, 2)
        left = np.concatenate([np.repeat(eye[OUTSIDE][None, None], n, axis=1), ahead[:-1]])
        joint = left[:, :, :, None] * t * (e.transpose(1, 0, 2) * back)[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        up = np.zeros_like(w)
        for k, ids in enumerate((here, before, after)):
            np.add.at(up[k], ids.reshape(-1), (target - chance).reshape(-1, LABELS))
        for x, g, (one, two) in zip((w, field.trans), (up / n - shrink * w, (pairs - joint.sum(axis=(0, 1))) / n - shrink_trans * field.trans), slopes):
            one += 0.1 * (g - one)
            two += 0.01 * (g**2 - two)
            x += rate * min(1, 2 - 2 * step / steps) * (one / (1 - 0.9 ** (step + 1))) / (np.sqrt(two / (1 - 0.99 ** (step + 1))) + 1e-6)
    return field.finish()


def decode(field: Field, types: np.ndarray) -> np.ndarray:
    """The best labels of a row of word types; type 0 parts texts and is always outside.

    Every 0 must be there twice or at the ends, so that no stretch runs across two texts.
    """
    labels = np.zeros(len(types), np.int64)
    before, after = np.concatenate(([0], types[:-1])), np.concatenate((types[1:], [0]))
    m = field.margin
    open_ = (m[0][types] + m[1][before] + m[2][after] <= 0) & (types > 0)
    places = np.flatnonzero(open_)
    if not len(places):
        return labels
    firsts = np.flatnonzero(np.diff(places, prepend=-2) > 1)
    lengths = np.diff(np.append(firsts, len(places)))
    w, t = field.weights, field.trans
    for length in np.unique(lengths):
        at = places[firsts[lengths == length]][:, None] + np.arange(length)
        for rows in np.array_split(at, 1 + at.size // 65536):
            emit = w[0][types[rows]] + w[1][before[rows]] + w[2][after[rows]]
            best, came = t[OUTSIDE] + emit[:, 0], []
            for i in range(1, length):
                options = best[:, :, None] + t
                came.append(options.argmax(axis=1))
                best = options.max(axis=1) + emit[:, i]
            label = (best + t[:, OUTSIDE]).argmax(axis=1)
            labels[rows[:, -1]] = label
            for i in range(length - 2, -1, -1):
                label = came[i][np.arange(len(rows)), label]
                labels[rows[:, i]] = label
    return labels


class _Types(dict):
    """Types of words met so far."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> int:
        kind = self.field.type_of(word)
        if len(word) <= 64:
            self[word] = kind
        return kind


def field_spans(field: Field, texts: list[str], types: _Types | None = None) -> list[list[Span]]:
    """Spans that the field finds in each whole text."""
    types = _Types(field) if types is None else types
    if len(types) > 400_000:
        types.clear()
    words = [t.split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words])
    flat = np.zeros(int(sizes.sum()) + 1, np.int64)
    at = 1
    for w in words:
        flat[at : at + len(w)] = np.fromiter(map(types.__getitem__, w), np.int64, len(w))
        at += len(w) + 1
    labels = decode(field, flat)[1:]
    out: list[list[Span]] = [[] for _ in texts]
    hit = np.flatnonzero(labels)
    starts = np.cumsum(sizes) - sizes
    by_text = np.searchsorted(starts, hit, "right") - 1
    for i in np.unique(by_text).tolist():
        places = [m.span() for m in _words(texts[i])]
        previous = -2
        for p in (hit[by_text == i] - starts[i]).tolist():
            label = int(labels[starts[i] + p])
            kind, inside = (label - 1) // 2, label % 2 == 0
            a, b = places[p]
            x, y = core(texts[i][a:b])
            if inside and previous == p - 1 and out[i] and out[i][-1][1] == kind:
                out[i][-1] = (out[i][-1][0], kind, a + y)
            else:
                out[i].append((a + x, kind, a + y))
            previous = p
    return out


def all_spans(base: list[Span], added: list[Span]) -> list[Span]:
    """The spans of the patterns, and those of the field that touch none of them."""
    return sorted(base + [s for s in added if not any(s[0] < e and b < s[2] for b, _, e in base)]) if added else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(df: DataFrame, id_col: str, text_col: str, field: Field) -> DataFrame:
    """Personal data of every whole text: ``id, n_email, n_ip, n_card, n_phone, base, spans``.

    ``base`` and ``spans`` are arrays of ``(kind, start, end)`` in code points, end exclusive,
    by start and kind: those of the patterns, and all. Null and empty texts have none; null
    ids stay; repeated rows each give a row; other columns are ignored.
    """
    get, kind = send(df.sparkSession, field), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows_of(spans):
        return pa.array([[{"kind": ALL_KINDS[k], "start": s, "end": e} for s, k, e in x] for x in spans], kind)

    def run(batches):
        field = get()
        types = _Types(field)
        for ids, texts in text_blocks(batches):
            base = [pattern_spans(t) for t in texts]
            every = [all_spans(b, a) for b, a in zip(base, field_spans(field, texts, types))]
            counts = [pa.array([sum(k == n for _, k, _ in b) for b in base], pa.int64()) for n in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, rows_of(base), rows_of(every)],
                                             ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    span = "array<struct<kind string, start long, end long>>"
    return ids_and_texts(df, id_col, text_col).mapInArrow(
        run, f"id long, n_email long, n_ip long, n_card long, n_phone long, base {span}, spans {span}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, last = [], 0
    for s, k, e in spans:
        if s >= last:
            out += [text[last:s], f"<{ALL_KINDS[k].upper()}>"]
        last = max(last, e)
    return "".join(out) + text[last:]


def mask(df: DataFrame, text_col: str, field: Field, chars_col: str | None = None) -> DataFrame:
    """All rows and columns of ``df``, personal data of the text masked; null texts stay null.

    ``chars_col``, if given, gets the new text's length.
    """
    get = send(df.sparkSession, field)

    def run(batches):
        field = get()
        types = _Types(field)
        for batch in batches:
            n, at = batch.num_rows, batch.schema.get_field_index(text_col)
            step = max(1, min(n, (4 << 20) * n // max(1, batch.column(at).nbytes)))
            for i in range(0, n, step):
                part = batch.slice(i, step)
                texts = part.column(at).to_pylist()
                added = field_spans(field, [t or "" for t in texts], types)
                new = [t if t is None else masked(t, all_spans(pattern_spans(t), a)) for t, a in zip(texts, added)]
                part = part.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
                if chars_col is not None and (c := batch.schema.get_field_index(chars_col)) >= 0:
                    old = part.column(c).to_pylist()
                    sizes = [o if x == t else len(x) for o, x, t in zip(old, new, texts)]
                    part = part.set_column(c, batch.schema.field(c), pa.array(sizes, batch.schema.field(c).type))
                yield part

    return df.mapInArrow(run, df.schema)


# The labelled table that comes with the operator: sentences from templates, values by rule.

_PLAIN = ("the report of was sent to in on for with our new list and price order page der die und mit le la les de el los para "
          "See Total Invoice Version Chapter thand erenth oution enblesh").split()
_SYLLABLES = "an ba de er fo gi ha in ka lo mé nu on pä re si tion ü ver wo".split()
_CUES = {"card": ("card", "visa", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "fax"), "person_id": ("ssn", "passport"),
         "iban": ("iban", "account"), "email": ("mail", "contact"), "ip": ("host", "server")}


def labelled_rows(rows: int = 900, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Labelled sentences: plain words, one or two values of a kind, and values of no kind."""
    rnd = random.Random(seed)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            x = digits(rnd.choice((13, 15, 16, 16, 16, 19)))
            if luhn(x) == valid:
                return x

    def word() -> str:
        x = rnd.choice(_PLAIN) if rnd.random() < 0.4 else "".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randrange(1, 6)))
        return (x.capitalize() if rnd.random() < 0.25 else x) + rnd.choice(("", "", "", "", ",", "."))

    def value(kind: str) -> str:
        host = f"{rnd.choice(_PLAIN).lower()}.{rnd.choice(('com', 'org', 'net'))}"
        who = rnd.choice(_PLAIN).lower() + rnd.choice(("", "." + digits(2), digits(1)))
        number = f"{digits(3)}-{digits(3)}-{digits(4)}"
        return {
            "email": lambda: rnd.choice((f"{who}@{host}", f"{who}@mail{digits(1)}.{host}", f"{who} [at] {host}", f"{who} (at) {host}")),
            "ip": lambda: ".".join(str(rnd.randrange(1, 256)) for _ in range(4)),
            "card": lambda: card(True),
            "phone": lambda: rnd.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", number, number, f"+{digits(11)}")),
            "person_id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
            "iban": lambda: rnd.choice(("DE", "FR", "ES")) + digits(20),
        }[kind]()

    def nothing() -> str:
        return rnd.choice((
            lambda: card(False), lambda: card(False), lambda: card(False), lambda: digits(rnd.randrange(1, 11)), lambda: f"{digits(2)}.{digits(2)}", lambda: f"${digits(3)}.{digits(2)}",
            lambda: f"20{digits(2)}-0{rnd.randrange(1, 10)}-{rnd.randrange(10, 29)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}",
            lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: "%032x" % rnd.getrandbits(128), lambda: f'"{rnd.getrandbits(64):016x}"',
            lambda: f"https://{rnd.choice(_PLAIN)}.com/{digits(3)}", lambda: f"#{digits(5)}", lambda: f"{digits(2)}%", lambda: f"{rnd.choice(_PLAIN)}###",
            lambda: f"{rnd.choice(_PLAIN)}$$$", lambda: "|", lambda: "=", lambda: f"{rnd.choice(_PLAIN)}-{rnd.choice(_PLAIN)}", lambda: "@", lambda: f"@{rnd.choice(_PLAIN)}",
            lambda: f"{rnd.choice(_PLAIN)}!!", lambda: f"{digits(3)}-{digits(3)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(3)},{digits(3)}"))()

    out = []
    for i in range(rows):
        kind = rnd.choice(ALL_KINDS)
        parts: list[tuple[str, int | None]] = [(word(), None) for _ in range(rnd.randrange(1, 6))]
        if i % 5 == 0:
            parts += [(nothing(), None), (word(), None)]
        if i % 5 < 2:
            cue = rnd.random() < 0.5
            if cue:
                parts.append((rnd.choice(_CUES[kind]) + rnd.choice(("", ":")), None))
            misprint = cue and kind == "card" and rnd.random() < 0.5
            parts.append((card(False) if misprint else value(kind), ALL_KINDS.index(kind)))
        elif i % 5 == 2:
            parts += [(nothing(), None), (word(), None), (nothing(), None)]
        else:
            parts += [(word(), None) for _ in range(12)]
        parts += [(word(), None) for _ in range(rnd.randrange(0, 5))]
        text, spans = "", []
        for x, k in parts:
            text += " " if text else ""
            if k is not None:
                spans.append((len(text), k, len(text) + len(x)))
            text += x
        out.append((text, spans))
    return out


def standard_field() -> Field:
    """The field trained on the labelled table that comes with the operator, once a process."""
    return worker_value("standard pii field", lambda: train(labelled_rows()))
