"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: those that the fixed patterns give on a bounded sample of texts, and
planted ones, in forms that the patterns can't read (an address spelled out, a number set apart by other signs, a
phone number without its country), beside numbers that are none of these. It reads every character of every text. Texts
are cut into overlapping windows; where two overlap, their emissions are blended into one lattice for the whole
text, and the Viterbi algorithm finds the best labelling of that. Runs of a label that touch no span of a pattern, and
aren't refuted by an exact check, are added to the spans; those of patterns stay.

The network learns a number's form; check digits and the sizes of parts are verified exactly afterwards.

The cells use piecewise linear activations (hard sigmoid and hard tangent): the same
recurrences with no exponentials. Only the runs of characters at which an excursion from "none" and back can pay are
searched; the result is that of the whole lattice.

Defined cases: a null text is an empty one, without spans; equal rows each get a row; with no
labelled span in the sample the network adds none; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written

KINDS = ("email", "ip", "card", "phone")
#: The most texts whose spans the network is trained on, half of them with digits or at signs.
SAMPLE = 1200
#: Training windows: their characters, the most of each sort (with spans, with other digits, with none), and planted ones.
SIZE, WINDOWS, PLANTED = 80, 1200, 5000
#: Windows of texts: their size, and by how much each begins after the one before.
WINDOW, STRIDE = 448, 400
#: A run of labels that no pattern covers is added only from this many characters.
SHORTEST = 7
HIDDEN = 10
#: Characters that are labelled at once.
TOGETHER = 800_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SOME_DIGIT = re.compile(r"[0-9]")
_SOME_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"[\[({]\s*at\s*[\])}]|\bat\b.*\bdot\b", re.IGNORECASE | re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the at signs: time is linear in any text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((s, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind as listed, then by start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _SOME_DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# --- characters

#: Classes of characters: digits are one, ASCII letters by case, others in ASCII their own, all else one, and padding.
_CLASS = np.arange(128, dtype=np.int16)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 48, 65, 97
OTHER, PAD, CLASSES = 128, 129, 130


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], OTHER).astype(np.int16)


# --- network


@dataclass
class Tagger:
    """Input rows by class and recurrent matrices of both directions, emissions, and transitions.

    Gates are rows 0 to 3 * HIDDEN (in, forget, out), then the candidate.
    """

    x: list[np.ndarray]  # two of (4 H, CLASSES)
    u: list[np.ndarray]  # two of (4 H, H)
    v: list[np.ndarray]  # two of (labels, H)
    b: np.ndarray  # labels
    move: np.ndarray  # [from, to]


def new_tagger(rng: np.random.Generator, hidden: int = HIDDEN) -> Tagger:
    k = len(KINDS) + 1
    x = [rng.normal(0, 0.4, (4 * hidden, CLASSES)).astype(np.float32) for _ in range(2)]
    for a in x:
        a[hidden : 2 * hidden] += 1.0
    u = [rng.normal(0, 0.5 / np.sqrt(hidden), (4 * hidden, hidden)).astype(np.float32) for _ in range(2)]
    v = [rng.normal(0, 0.3, (k, hidden)).astype(np.float32) for _ in range(2)]
    b = np.zeros(k, np.float32)
    b[0] = 1.0
    move = np.full((k, k), -1.0, np.float32)
    np.fill_diagonal(move, 1.0)
    return Tagger(x, u, v, b, move)


def _forward(m: Tagger, c: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Emissions (time, labels, windows) of classes (time, windows); with ``keep``, what the gradients need."""
    steps, n = c.shape
    hid = m.u[0].shape[1]
    out = np.empty((steps, len(m.b), n), np.float32)
    out[:] = m.b[:, None]
    kept: list = [[None] * steps, [None] * steps]
    for way in range(2):
        x, u, v = m.x[way], m.u[way], m.v[way]
        h = np.zeros((hid, n), np.float32)
        s = np.zeros((hid, n), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            g = x[:, c[t]] + u @ h
            gate = np.clip(0.25 * g[: 3 * hid] + 0.5, 0, 1)
            cand = np.clip(g[3 * hid :], -1, 1)
            new = gate[hid : 2 * hid] * s + gate[:hid] * cand
            flat = np.clip(new, -1, 1)
            if keep:
                kept[way][t] = (gate, cand, g[3 * hid :], s, new, flat, h)
            h, s = gate[2 * hid :] * flat, new
            out[t] += v @ h
    return out, kept


def _crf(em: np.ndarray, y: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood by window and its gradients by emissions and transitions."""
    steps, k, n = em.shape
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0]
    e = np.exp(move)
    for t in range(1, steps):
        top = alpha[t - 1].max(0)
        alpha[t] = em[t] + top + np.log(e.T @ np.exp(alpha[t - 1] - top))
    for t in range(steps - 2, -1, -1):
        z = em[t + 1] + beta[t + 1]
        top = z.max(0)
        beta[t] = top + np.log(e @ np.exp(z - top))
    top = alpha[-1].max(0)
    total = top + np.log(np.exp(alpha[-1] - top).sum(0))
    grad = np.exp(alpha + beta - total)
    moves = np.zeros((k, k))
    for t in range(1, steps):
        z = em[t] + beta[t]
        top, high = alpha[t - 1].max(0), z.max(0)
        moves += (np.exp(alpha[t - 1] - top) @ (np.exp(z - high) * np.exp(np.minimum(top + high - total, 60))).T) * e
    cols = np.arange(n)
    gold = em[np.arange(steps)[:, None], y, cols].sum() + move[y[:-1], y[1:]].sum()
    grad[np.arange(steps)[:, None], y, cols] -= 1
    np.add.at(moves, (y[:-1].ravel(), y[1:].ravel()), -1)
    return float((total.sum() - gold) / n), (grad / n).astype(np.float32), (moves / n).astype(np.float32)


def _gradients(m: Tagger, c: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    em, kept = _forward(m, c, True)
    loss, de, dmove = _crf(em, y, m.move)
    hid = m.u[0].shape[1]
    grads: list[list[np.ndarray]] = [[], [], []]
    for way in range(2):
        dx, du, dv = np.zeros_like(m.x[way]), np.zeros_like(m.u[way]), np.zeros_like(m.v[way])
        dh, ds = np.zeros((hid, c.shape[1]), np.float32), np.zeros((hid, c.shape[1]), np.float32)
        for t in range(c.shape[0] - 1, -1, -1) if way == 0 else range(c.shape[0]):
            gate, cand, raw, s, new, flat, before = kept[way][t]
            i, f, o = gate[:hid], gate[hid : 2 * hid], gate[2 * hid :]
            h = o * flat
            dv += de[t] @ h.T
            dh = dh + m.v[way].T @ de[t]
            ds = ds + dh * o * (np.abs(new) < 1)
            dg = np.concatenate([ds * cand, ds * s, dh * flat, ds * i])
            dg[: 3 * hid] *= 0.25 * ((gate > 0) & (gate < 1))
            dg[3 * hid :] *= np.abs(raw) < 1
            du += dg @ before.T
            one = np.zeros((c.shape[1], CLASSES), np.float32)
            one[np.arange(c.shape[1]), c[t]] = 1
            dx += dg @ one
            dh, ds = m.u[way].T @ dg, ds * f
        grads[0].append(dx)
        grads[1].append(du)
        grads[2].append(dv)
    return loss, [*grads[0], *grads[1], *grads[2], de.sum((0, 2)), dmove]


def _luhn_number(rng: np.random.Generator, n: int) -> str:
    digits = "".join(map(str, [rng.integers(3, 7), *rng.integers(0, 10, n - 2)]))
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def _number(rng: np.random.Generator, n: int) -> str:
    return str(rng.integers(1, 10)) + "".join(map(str, rng.integers(0, 10, n - 1)))


def _name(rng: np.random.Generator, least: int = 2, most: int = 9) -> str:
    name = "".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(least, most))))
    return name.capitalize() if rng.random() < 0.15 else name


def planted(rng: np.random.Generator) -> tuple[str, int]:
    """A string and its label: personal data, mostly in forms beyond the patterns, or (0) something that looks like it."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    group = lambda text, sizes, gap: gap.join(text[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    kind = int(rng.choice(5, p=[0.36, 0.16, 0.16, 0.16, 0.16]))
    if kind == 1:
        local, host, top = _name(rng) + pick("", "", "." + _name(rng), "_" + _name(rng), _number(rng, 2)), _name(rng, 3), pick("com", "org", "net", "example", "de", "fr", "co.uk", "io")
        at = pick(" (at) ", " [at] ", "(at)", "[at]", " {at} ", " @ ", " at ", " AT ", "@", "@")
        dot = pick(" (dot) ", " [dot] ", "(dot)", "[dot]", "[.]", "(.)", " . ") if at == "@" else pick(" dot ", " DOT ") if at.strip().lower() == "at" else pick(" (dot) ", " [dot] ", " dot ", ".", ".", "[.]")
        return f"{local}{at}{host}" + ("" if at == "@" and rng.random() < 0.15 else dot + top), 1
    if kind == 2:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return pick("[.]", "(.)", " . ", "[dot]", " dot ", ". ", "{.}", "[.]", ".").join(parts), 2
    if kind == 3:
        gap = pick(".", "/", "  ", "\t", "\u00a0", "_", " - ", "\u2013", ", ", "--", "- ", " ", "-", "")
        return (group(_luhn_number(rng, 15), [4, 6, 5], gap or " ") if rng.random() < 0.15 and gap.strip(" -") else group(_luhn_number(rng, 16), [4, 4, 4, 4], gap)), 3
    if kind == 4:
        a, b, c, cc = _number(rng, 3), _number(rng, 3), _number(rng, 4), _number(rng, int(rng.integers(1, 4)))
        return pick(f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{cc} {a} {b} {c}", f"00{cc}-{a}-{b}-{c}", f"+{cc}/{a}/{b}{c}", f"+{cc} ({a}) {b}/{c}", f"+{cc}_{a}_{b}{c}", f"0{a}/{b}{c}", f"0{a} / {b}{c}", f"(0{a}) {b}{c}", f"+ {cc} {a} {b} {c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}"), 4
    y, m, d = rng.integers(1900, 2100), rng.integers(1, 13), rng.integers(1, 29)
    hour, minute, n = rng.integers(0, 24), rng.integers(0, 60), int(rng.integers(1, 30))
    hexes = "".join(pick(*"0123456789abcdef") for _ in range(int(pick(8, 16, 32, 40))))
    return pick(
        f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{hour:02}:{minute:02}:{n % 60:02}", f"{y}-{m:02}-{d:02}T{hour:02}:{minute:02}:00Z", f"{d}.{m}.", f"v{m}.{d}.{hour}", f"{m}.{d}.{n}", f"{y}-{y + n}",
        f"{m},{_number(rng, 3)}.{minute:02}", f"${_number(rng, 2)}.50", f"{_number(rng, 3)}-{_number(rng, 3)}", f"ISBN 978-{m}-{_number(rng, 2)}-{_number(rng, 6)}-{n % 10}", f"{pick('A', 'No', 'ID')}-{_number(rng, 5)}", f"0.{_number(rng, n % 12 + 1)}",
        _number(rng, n), _number(rng, n), f"{_number(rng, 3)} {_number(rng, 3)}", f"{_number(rng, 2)}.{_number(rng, 4)}, {m}.{_number(rng, 4)}", f'"{hexes}"', hexes, hexes.upper() + "!!", f"{hexes[:8]}-{hexes[:4]}-{hexes[:4]}", f"@{_name(rng)}", f"{_name(rng)} @ {n}", f"at {_name(rng)}",
        f"look at {_name(rng)} dot {_name(rng)}", f"({n}) {m}", f"{n}%", f"+{n}", f"{n} + {m} = {n + m}", f"{m}/{d}", f"#{n}", f"{_name(rng)}.{_name(rng)}", f"{_name(rng)}_{n}", f"{hour}:{minute:02}-{hour}:{minute:02}", f"1,000,{_number(rng, 3)},{_number(rng, 3)}",
    ), 0


def form_labels(text: str) -> np.ndarray:
    """A label for each character by the patterns' forms; the exact checks of card digits and parts come later."""
    y = np.zeros(len(text), np.int8)
    for m in _CARD.finditer(text):
        if 16 <= len(_digits(m[0])) <= 19:
            y[m.start() : m.end()] = 3
    for m in _IP.finditer(text):
        y[m.start() : m.end()] = 2
    for kind, s, e in base_spans(text):
        y[s:e] = KINDS.index(kind) + 1
    return y


def windows_of(text: str, rng: np.random.Generator, size: int = SIZE) -> Iterator[tuple[int, str, bytes]]:
    """(sort, characters, labels): windows with spans (0), one at each other run of digits (1), and one for about every 500 characters (2)."""
    y = form_labels(text)

    def cut(at: int) -> tuple[str, bytes]:
        s = max(0, min(at, len(text) - size))
        return text[s : s + size], y[s : s + size].tobytes()

    edge = np.flatnonzero((y != 0) & (np.concatenate([[0], y[:-1]]) != y))
    for s in edge.tolist():
        yield 0, *cut(s - int(rng.integers(5, size - 30)))
    for m in re.finditer("[0-9]+", text):
        if not y[m.start()]:
            yield 1, *cut(m.start() - size // 2)
    for _ in range(1 + len(text) // 500 if text else 0):
        yield 2, *cut(int(rng.integers(0, len(text))))


def fit(texts: list[str], epochs: int = 24, size: int = SIZE, batch: int = 192, seed: int = 11) -> Tagger | None:
    """From all windows of a few texts, without planted spans."""
    rng = np.random.default_rng(seed)
    return fit_windows([w[1:] for text in texts for w in windows_of(text, rng, size)], 0, epochs, size, batch, seed)


def fit_windows(real: list[tuple[str, bytes]], plant: int = PLANTED, epochs: int = 16, size: int = SIZE, batch: int = 192, seed: int = 11) -> Tagger | None:
    """From labelled windows, and as many more with a planted string put between two words as ``plant`` says."""
    if not any(any(y) for _, y in real):
        return None
    rng = np.random.default_rng(seed)
    pool = [text for text, y in real if not any(y)] or [text for text, _ in real]
    rows, tags = [], []

    def add(text: str, y: np.ndarray) -> None:
        c = classes(text)[:size]
        rows.append(np.pad(c, (0, size - len(c)), constant_values=PAD))
        tags.append(np.pad(y[:size].astype(np.int64), (0, size - len(y[:size]))))

    for text, y in real:
        add(text, np.frombuffer(y, np.int8))
    for _ in range(plant):
        text, (what, label) = pool[int(rng.integers(len(pool)))], planted(rng)
        gaps = [m.start() for m in re.finditer(" ", text)] or [0]
        at = gaps[int(rng.integers(len(gaps)))]
        before, after = text[:at], text[at:]
        before = before[max(0, len(before) - int(rng.integers(0, max(1, size - len(what) - 8)))) :]
        end = "" if rng.random() < 0.75 else [".", ",", ")", ";"][int(rng.integers(4))]
        y = np.zeros(len(before) + 1 + len(what) + len(end) + len(after), np.int8)
        y[len(before) + 1 : len(before) + 1 + len(what)] = label
        add(f"{before} {what}{end}{after}", y)
    c, y = np.stack(rows), np.stack(tags)
    m = new_tagger(rng)
    params = [*m.x, *m.u, *m.v, m.b, m.move]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    total = epochs * -(-len(c) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(c))
        for a in range(0, len(c), batch):
            pick = order[a : a + batch]
            _, grads = _gradients(m, c[pick].T, y[pick].T)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total)
            for p, g, f, s in zip(params, grads, first, second):
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                f *= 0.9
                f += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                p -= (rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


# --- decoding


class Decoder:
    """Runs the network over many windows at once, and keeps its buffers."""

    def __init__(self, m: Tagger, group: int = 1536):
        self.hid = hid = m.u[0].shape[1]
        scale = np.full((4 * hid, 1), 0.25, np.float32)
        scale[3 * hid :] = 1
        shift = np.full((4 * hid, 1), 0.5, np.float32)
        shift[3 * hid :] = 0
        self.x = [np.ascontiguousarray(x * scale + shift) for x in m.x]  # gates come out ready to be clipped
        self.u = [np.ascontiguousarray(u * scale) for u in m.u]
        self.m, self.group = m, group
        # bounds of what transitions add to an excursion from "none" and back over staying there: into it, out of it, and inside
        gain = (m.move - m.move[0, 0]).astype(np.float64)
        self.into, self.out, self.inside = float(gain[0, 1:].max()), float(gain[1:, 0].max()), float(gain[1:, 1:].max())
        self.margin = 0.0  # excursions that lose more than this aren't searched

    def emissions(self, c: np.ndarray, active: np.ndarray) -> np.ndarray:
        """(time, labels, windows); windows come longest first, ``active[t]`` of them reach t."""
        hid, (steps, n) = self.hid, c.shape
        out = np.empty((steps, len(self.m.b), n), np.float32)
        out[:] = self.m.b[:, None]
        for way in range(2):
            x, u, v = self.x[way], self.u[way], self.m.v[way]
            h, s = np.zeros((hid, n), np.float32), np.zeros((hid, n), np.float32)
            buffers: dict[int, tuple] = {}
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                k = int(active[t])
                if k not in buffers:
                    buffers = {k: (np.empty((4 * hid, k), np.float32), np.empty((4 * hid, k), np.float32), np.empty((hid, k), np.float32))}
                g, r, w = buffers[k]
                np.take(x, c[t, :k], axis=1, out=g, mode="wrap")
                np.dot(u, np.ascontiguousarray(h[:, :k]) if k < n else h, out=r)
                g += r
                np.clip(g[: 3 * hid], 0, 1, out=g[: 3 * hid])
                np.clip(g[3 * hid :], -1, 1, out=g[3 * hid :])
                sk = s[:, :k]
                sk *= g[hid : 2 * hid]
                np.multiply(g[:hid], g[3 * hid :], out=w)
                sk += w
                np.clip(sk, -1, 1, out=w)
                np.multiply(g[2 * hid : 3 * hid], w, out=w)
                h[:, :k] = w
                out[t, :, :k] += v @ w
        return out

    def lattice(self, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Emissions (character, label) of whole texts; text i is ``c[starts[i]:starts[i + 1]]``.

        Windows of even number don't overlap one another; those of odd number lie over their edges, and their weight falls
        to nothing at their own.
        """
        n = np.diff(starts)
        windows = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(n)), windows)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = starts[doc] + number * STRIDE
        end = np.minimum(begin + WINDOW, starts[doc + 1])
        last = number == windows[doc] - 1
        both = WINDOW - STRIDE + 1
        out = np.zeros((len(c), len(self.m.b)), np.float32)
        span = np.arange(WINDOW)
        padded = np.concatenate([c, np.full(WINDOW, PAD, np.int16)])
        for odd in (0, 1):
            turn = np.flatnonzero(number % 2 == odd)
            order = turn[np.argsort((begin - end)[turn], kind="stable")]
            for a in range(0, len(order), self.group):
                pick = order[a : a + self.group]
                size = end[pick] - begin[pick]
                steps = int(size[0])
                at = begin[pick] + span[:steps, None]
                active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
                e = self.emissions(padded[at].astype(np.intp), active).transpose(0, 2, 1)
                real = np.arange(len(pick)) < active[:, None]
                if odd:
                    here = span[:steps, None]
                    weight = np.minimum(1.0, (here + 1) / both)
                    weight = np.where(last[pick], weight, np.minimum(weight, 1 - np.clip((here - STRIDE + 1) / both, 0, 1)))
                    w = weight[real].astype(np.float32)[:, None]
                    out[at[real]] = w * e[real] + (1 - w) * out[at[real]]
                else:
                    out[at[real]] = e[real]
        return out

    def doubtful(self, em: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Characters at which some excursion from "none" may pay; some best path has no label at all others.

        An excursion's gain is at most that of its characters' best labels and of its transitions. The greatest sum over stretches that
        hold a character comes from running sums and their extremes before and after it.
        """
        n = len(em)
        gain = np.zeros(n + len(starts))  # a wall lies before each text and after the last one
        place = np.arange(n) + np.repeat(np.arange(1, len(starts)), np.diff(starts))
        gain[place] = reduce(np.maximum, em.T[1:]) - em[:, 0] + self.inside
        wall = np.ones(len(gain), bool)
        wall[place] = False
        gain[wall] = -1e6
        # transitions: one fewer inside than characters; none into a text's first character, nor out of its last
        total = np.concatenate([[0.0], np.cumsum(gain)])
        left = total[:-1] - self.into
        left[1:][wall[:-1]] += min(0.0, self.into)
        right = total[1:] + self.out
        right[:-1][wall[1:]] -= min(0.0, self.out)
        low = np.minimum.accumulate(left)
        high = np.maximum.accumulate(right[::-1])[::-1]
        return (high - low - self.inside)[place] > -self.margin

    def best(self, em: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best labelling of each text, from its lattice."""
        y = np.zeros(len(em), np.int8)
        where = np.flatnonzero(self.doubtful(em, starts)) if len(em) else []
        if not len(where):
            return y
        doc = np.searchsorted(starts, where, "right") - 1
        # each run with the settled character on either side of it, where the text has one
        opens = np.ones(len(where), bool)
        opens[1:] = (where[1:] > where[:-1] + 1) | (doc[1:] != doc[:-1])
        closes = np.append(opens[1:], True)
        s, e = where[opens], where[closes] + 1
        before, after = s > starts[doc[opens]], e < starts[doc[closes] + 1]
        s, e = s - before, e + after
        order = np.argsort(s - e, kind="stable")
        s, size, before, after = s[order], (e - s)[order], before[order], after[order]
        a = 0
        while a < len(s):
            b = min(len(s), a + max(1, 400_000 // int(size[a])))
            self._viterbi(em, s[a:b], size[a:b], before[a:b], after[a:b], y)
            a = b
        return y

    def _viterbi(self, em: np.ndarray, s: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray, y: np.ndarray) -> None:
        """Runs, longest first; their first (``before``) and last (``after``) characters have no label."""
        steps, k = int(size[0]), em.shape[1]
        active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
        move = self.m.move[:, :, None]
        total = em[s].T.copy()
        total[1:, before] = -1e30
        back = np.zeros((steps, k, len(s)), np.int8)
        for t in range(1, steps):
            n = active[t]
            z = total[:, None, :n] + move
            back[t, :, :n] = z.argmax(0)
            total[:, :n] = z.max(0) + em[s[:n] + t].T
        total[1:, after] = -1e30
        state = total.argmax(0)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            y[s[:n] + t] = state[:n]
            if t:
                state[:n] = back[t, state[:n], np.arange(n)]

    def tag(self, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A label for each character of each text. A text of more than TOGETHER characters is done in parts that meet where no label can be."""
        if len(starts) != 2 or len(c) <= TOGETHER:
            return self.best(self.lattice(c, starts), starts)
        out, at = np.zeros(len(c), np.int8), 0
        while at < len(c):
            s = max(0, at - WINDOW) // STRIDE * STRIDE
            e = min(len(c), s + STRIDE * (TOGETHER // STRIDE))
            em = self.lattice(c[s:e], np.array([0, e - s]))[at - s :]
            cut = len(em)
            if e < len(c):
                sure = np.flatnonzero(~self.doubtful(em, np.array([0, len(em)]))[: len(em) - WINDOW])
                cut = int(sure[-1]) + 1 if len(sure) else len(em) - WINDOW
            out[at : at + cut] = self.best(em[:cut], np.array([0, cut]))
            at += cut
        return out


def _digits(piece: str) -> str:
    return "".join(_SOME_DIGIT.findall(piece))


def _refuted(kind: str, piece: str) -> bool:
    """Whether the text itself speaks against a label.

    An address needs its at sign, or the word in brackets, or that word and "dot". Four parts of a network address are at most 255. A card has 12 to 19 digits, and
    its check digit, however they are set apart. A phone number has 7 to 15, and is refuted, too, if one match of the pattern holds
    all its digits and their number is wrong.
    """
    if kind == "email":
        return "@" not in piece and not _AT.search(piece)
    digits = _digits(piece)
    if kind == "ip":
        parts = _SOME_DIGITS.findall(piece)
        return len(parts) != 4 or not all(map(_small, parts))
    if kind == "card":
        return not 12 <= len(digits) <= 19 or not luhn(digits)
    if not 7 <= len(digits) <= 15:
        return True
    return not 8 <= len(digits) <= 15 and any(_digits(m[0]) == digits for m in _PHONE.finditer(piece))


def _added(tags: np.ndarray, base: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """Runs of a label that touch no span of a pattern, without space at their ends.

    A number that has a card's form but not its check digit, for one, is known to be none.
    """
    at = np.flatnonzero(tags)
    if not len(at):
        return []
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (tags[at[1:]] != tags[at[:-1]]))
    taken = np.zeros(len(tags) + 1, bool)
    for _, s, e in base:
        taken[s:e] = True
    out = []
    for s, e in zip(at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1):
        piece = text[s:e]
        s, e = int(s + len(piece) - len(piece.lstrip())), int(e - len(piece) + len(piece.rstrip()))
        if e - s >= SHORTEST and not taken[s:e].any() and not _refuted(KINDS[tags[s] - 1], text[s:e]):
            out.append((KINDS[tags[s] - 1], s, e))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _sorted(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def train(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE, windows: int = WINDOWS) -> Tagger | None:
    """From windows of at most ``sample`` different texts, whatever their length, and at most ``windows`` of each sort: those that hash lowest."""
    rows = docs.select(F.col(text_column).alias("t"), F.xxhash64(text_column).alias("h")).where(F.col(text_column).isNotNull())
    chosen = None
    for some, n in ((rows.where(F.col("t").rlike("@|[0-9]{2}")), sample // 2), (rows, sample - sample // 2)):
        # hashes alone are ordered; equal texts are one
        last = some.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
        if last is not None:
            some = some.where(F.col("h") <= last)
            chosen = some if chosen is None else chosen.union(some)
    if chosen is None:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0), batch.column(1)):
                found = list(windows_of(text.as_py(), np.random.default_rng(h.as_py() & 0xFFFFFFFF)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.string(), pa.binary()))], names=["sort", "text", "tags"])

    found = written(chosen.groupBy("h").agg(F.min("t").alias("t")).select("h", "t").mapInArrow(cut, "sort int, text string, tags binary"), "windows")
    real = []
    for k in range(3):
        real += [(r["text"], bytes(r["tags"])) for r in found.where(F.col("sort") == k).orderBy(F.xxhash64("text", "tags"), "text").limit(windows).collect()]
    return fit_windows(real)


def find(docs: DataFrame, model: Tagger | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone of the patterns, base_sha256, spans, n_added)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model) if model is not None else None
        for batch in batches:
            for a, b, texts, tags, starts in _tagged(batch.column(1), decoder):
                rows = []
                for i, text in enumerate(texts):
                    base = base_spans(text)
                    more = _added(tags[starts[i] : starts[i + 1]], base, text) if tags is not None else []
                    count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    rows.append((*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(_sorted(base + more)), len(more)))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return docs.select(id_column, text_column).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def _tagged(column: pa.Array, decoder: Decoder | None, most: int = TOGETHER) -> Iterator[tuple]:
    """(from, to, texts, labels, starts) for successive texts of about so many characters."""
    a = 0
    while a < len(column):
        texts, size, b = [], 0, a
        while b < len(column) and (not texts or size < most):
            texts.append(column[b].as_py() or "")
            size += len(texts[-1])
            b += 1
        starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        yield a, b, texts, decoder.tag(classes("".join(texts)), starts) if decoder else None, starts
        a = b


def redact(docs: DataFrame, model: Tagger | None, text_column: str = "text", count_column: str | None = None) -> DataFrame:
    """The documents with each span, of patterns or added, replaced by its kind in brackets; null texts stay null.

    Overlapping spans are replaced as one, named by the first. ``count_column``, if given, gets the new length.
    """
    at = docs.columns.index(text_column)
    count_at = docs.columns.index(count_column) if count_column else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model) if model is not None else None
        for batch in batches:
            for a, b, texts, tags, starts in _tagged(batch.column(at), decoder):
                part = batch.slice(a, b - a)
                null = part.column(at).is_null().to_pylist()
                out = []
                for i, text in enumerate(texts):
                    base = base_spans(text)
                    more = _added(tags[starts[i] : starts[i + 1]], base, text) if tags is not None else []
                    out.append(None if null[i] else replaced(text, base + more))
                columns = list(part.columns)
                columns[at] = pa.array(out, columns[at].type)
                if count_at is not None:
                    columns[count_at] = pa.array([old if new is None or new == text else len(new) for old, new, text in zip(columns[count_at].to_pylist(), out, texts)], columns[count_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    if not spans:
        return text
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind}]"]
            end = e
        else:
            end = max(end, e)
    return "".join([*out, text[end:]])
