"""Personal data: fixed patterns, and a BiLSTM-CRF tagger that adds to them.

The tagger reads every character of whole texts, letters told apart, digits not.
Overlapping windows vote on each character,
weighted by its distance from the window's border. Where "outside" leads by more
than all transitions together can make up for, the best path surely passes through
it, so these characters cut a text into stretches that Viterbi decodes exactly; a
very long stretch passes by parts that exchange exact messages.

It is trained in numpy on labelled windows of the corpus: the patterns' spans, and
planted ones in forms that the patterns miss (phones without sign or glued to other
numbers, cards with other separators, written-out or international addresses),
among planted dates, prices, versions, ids and other numbers that are no one's.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import Arrays, fit, load
from .text import chunks

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"  # what may stand before an address's sign
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WINDOW, STRIDE, STEP, LEARNED = 256, 224, 32, 96  # characters read at once, in multiples of the third; those of a learned window
EMBED, HIDDEN, CLASSES = 12, 12, 64
TAGS = 1 + 2 * len(KINDS)
BATCH, BATCHES, TRAIN_WINDOWS = 64, 480, 16000
SURE = 0.6
GROUP = 768  # windows read at once
BLOCK = 1 << 20  # characters whose scores are held
CELLS, LONG = 1 << 18, 1 << 12  # characters decoded together, and of a stretch that is decoded by itself
AT_WORD = re.compile(r"[(\[{] ?(at|a) ?[)\]}]", re.I)
Span = tuple[int, int, str]


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(numbers: list[int]) -> bool:
    doubled = sum(sum(divmod(2 * d, 10)) for d in numbers[-2::-2])
    return (sum(numbers[-1::-2]) + doubled) % 10 == 0


def valid(kind: str, text: str) -> bool:
    """What makes a span one of its kind; for a pattern's match it is the contract's check."""
    if kind == "email":
        return "@" in text or bool(AT_WORD.search(text))
    found = digits(text)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in parts))
    if kind == "card":
        return 12 <= len(found) <= 19 and luhn(found)
    return 9 <= len(found) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: sought from the sign, so each letter is read twice at most."""
    last, sign = 0, text.find("@")
    while sign >= 0:
        start = len(text[last:sign].rstrip(LOCAL)) + last
        host = HOST.match(text, sign) if start < sign else None
        if host:
            yield start, host.end()
        last = host.end() if host else sign + 1
        sign = text.find("@", last)


def dotted_fours(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``: each four parts of a longest dotted sequence."""
    for found in DOTTED.finditer(text):
        if found.group().count(".") >= 3:
            parts, at = found.group().split("."), found.start()
            for k in range(0, len(parts) - 3, 4):
                size = len(".".join(parts[k : k + 4]))
                yield at, at + size
                at += size + 1


def pattern_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass their check, by start and then kind. Time is linear in the text."""
    found = [(a, b, "email") for a, b in emails(text)] + [(a, b, "ip") for a, b in dotted_fours(text)]
    found += [(*m.span(), "card") for m in CARD.finditer(text)]
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text)]
    return sorted((s for s in found if valid(s[2], text[s[0] : s[1]])), key=lambda s: (s[0], KINDS.index(s[2])))


def _classes() -> np.ndarray:
    table = np.full(0x110000, 63, dtype=np.uint8)
    table[128:] = 27
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[48:58] = 28
    table[[9, 10, 11, 12, 13, 32]] = [29, 30, 29, 29, 29, 29]
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[signs] = 31 + np.arange(len(signs))
    return table


CLASS = _classes()  # 0 is left for padding


def classes(text: str) -> np.ndarray:
    return CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def reading(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of all texts, and each text's bounds."""
    return classes("".join(texts)), np.cumsum([0, *map(len, texts)])


# ---- the network ----------------------------------------------------------


def fresh(random: np.random.Generator) -> Arrays:
    def normal(*shape: int) -> np.ndarray:
        return random.normal(0, shape[-2] ** -0.5, shape).astype(np.float32)

    bias = np.zeros((2, 1, 3 * HIDDEN), dtype=np.float32)
    bias[:, :, :HIDDEN] = 1
    return {"embed": normal(CLASSES, EMBED), "wx": normal(2, EMBED, 3 * HIDDEN), "wh": normal(2, HIDDEN, 3 * HIDDEN), "b": bias, "wo": normal(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS, dtype=np.float32), "moves": np.zeros((TAGS, TAGS), dtype=np.float32)}


def squash(x: np.ndarray) -> np.ndarray:
    """A cheap sigmoid to (-1, 1), for new cell values; gates are (1 + squash) / 2.

    What a cell forgets it takes in anew (one gate for both), so its value stays within
    (-1, 1) and needs no squashing on its way out.
    """
    return x / (1 + np.abs(x))


def emissions(model: Arrays, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Tag scores (time, window, tag) of windows ``x`` (window, time); and what the way back needs."""
    steps = x.shape[1]
    read = model["embed"][np.stack([x.T, x.T[::-1]])]  # direction, time, window, embedding
    pre = read @ model["wx"][:, None] + model["b"][:, None]
    h = np.zeros((2, len(x), HIDDEN), dtype=pre.dtype)
    c = np.zeros_like(h)
    states = []
    for t in range(steps):
        z = squash(pre[:, t] + h @ model["wh"])
        gate = 0.5 * z[:, :, : 2 * HIDDEN] + 0.5
        f, o, g = gate[:, :, :HIDDEN], gate[:, :, HIDDEN:], z[:, :, 2 * HIDDEN :]
        before = (h, c)
        c = g + f * (c - g)
        h = o * c
        states.append((before, z, gate, c, h))
    out = np.stack([st[-1] for st in states], axis=1)
    both = np.concatenate([out[0], out[1][::-1]], axis=2)
    return both @ model["wo"] + model["bo"], (read, states, both)


def read_windows(model: Arrays, x: np.ndarray) -> np.ndarray:
    """The scores of ``emissions`` as (window, time, tag), for reading only: features stand before windows."""
    steps, size = x.shape[1], len(x)
    weights = np.concatenate([model["wh"], model["wx"], model["b"]], axis=1).transpose(0, 2, 1).copy()
    embed, ahead = model["embed"], x.T.astype(np.intp)
    seen = np.ones((2, HIDDEN + EMBED + 1, size), dtype=np.float32)  # state, character, one for the bias
    h, read = seen[:, :HIDDEN], seen[:, HIDDEN:-1]
    h[:] = 0
    c = np.zeros((2, HIDDEN, size), dtype=np.float32)
    z, far = (np.empty((2, 3 * HIDDEN, size), dtype=np.float32) for _ in range(2))
    out = np.empty((steps, 2, HIDDEN, size), dtype=np.float32)
    for t in range(steps):
        for way, at in ((0, t), (1, steps - 1 - t)):
            read[way] = embed.take(ahead[at], axis=0, mode="clip").T
        np.matmul(weights, seen, out=z)
        np.abs(z, out=far)
        far += 1
        z /= far
        gate, new = z[:, : 2 * HIDDEN], z[:, 2 * HIDDEN :]
        gate *= 0.5
        gate += 0.5
        c -= new
        c *= gate[:, :HIDDEN]
        c += new
        np.multiply(c, gate[:, HIDDEN:], out=h)
        out[t] = h
    scores = out[:, 0].transpose(0, 2, 1) @ model["wo"][:HIDDEN]
    scores += out[::-1, 1].transpose(0, 2, 1) @ model["wo"][HIDDEN:]
    scores += model["bo"]
    return scores.transpose(1, 0, 2)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def slopes(model: Arrays, x: np.ndarray, y: np.ndarray) -> Arrays:
    """Gradient of the CRF's mean negative log-likelihood of tags ``y`` (window, time)."""
    scores, (read, states, both) = emissions(model, x)
    steps, size = scores.shape[:2]
    moves = model["moves"]
    ahead = [scores[0]]
    for t in range(1, steps):
        ahead.append(scores[t] + _lse(ahead[-1][:, :, None] + moves, 1))
    behind = [np.zeros_like(scores[0])]
    for t in range(steps - 2, -1, -1):
        behind.append(_lse(moves + (scores[t + 1] + behind[-1])[:, None, :], 2))
    ahead_, behind_ = np.stack(ahead), np.stack(behind[::-1])
    total = _lse(ahead_[-1], 1)
    d = np.exp(ahead_ + behind_ - total[:, None])
    pair = np.exp(ahead_[:-1, :, :, None] + moves + (scores[1:] + behind_[1:])[:, :, None, :] - total[:, None, None]).sum(axis=(0, 1))
    tags = y.T
    np.put_along_axis(d, tags[:, :, None], np.take_along_axis(d, tags[:, :, None], 2) - 1, 2)
    np.subtract.at(pair, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    d /= size
    out = {"moves": pair / size, "wo": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, TAGS), "bo": d.sum(axis=(0, 1))}
    back = d @ model["wo"].T
    dh_out = np.stack([back[:, :, :HIDDEN], back[::-1, :, HIDDEN:]])
    dz_all = np.zeros((2, steps, size, 3 * HIDDEN), dtype=both.dtype)
    dwh = np.zeros_like(model["wh"])
    dh, dc = np.zeros((2, size, HIDDEN), dtype=both.dtype), np.zeros((2, size, HIDDEN), dtype=both.dtype)
    for t in range(steps - 1, -1, -1):
        (h0, c0), z, gate, c, _ = states[t]
        f, o, g = gate[:, :, :HIDDEN], gate[:, :, HIDDEN:], z[:, :, 2 * HIDDEN :]
        dh = dh + dh_out[:, t]
        dc = dc + dh * o
        dz = dz_all[:, t]
        dz[:, :, :HIDDEN] = 0.5 * dc * (c0 - g)
        dz[:, :, HIDDEN : 2 * HIDDEN] = 0.5 * dh * c
        dz[:, :, 2 * HIDDEN :] = dc * (1 - f)
        dz *= (1 - np.abs(z)) ** 2
        dwh += h0.transpose(0, 2, 1) @ dz
        dh = dz @ model["wh"].transpose(0, 2, 1)
        dc = dc * f
    flat = dz_all.reshape(2, -1, 3 * HIDDEN)
    out |= {"wh": dwh, "b": flat.sum(axis=1, keepdims=True), "wx": read.reshape(2, -1, EMBED).transpose(0, 2, 1) @ flat}
    dread = (flat @ model["wx"].transpose(0, 2, 1)).reshape(2, steps, size, EMBED)
    embed = np.zeros_like(model["embed"])
    for way, order in ((0, x.T), (1, x.T[::-1])):
        np.add.at(embed, order, dread[way])
    return out | {"embed": embed}


def decode(moves: np.ndarray, regions_: list[np.ndarray], ahead_of: tuple[np.ndarray, np.ndarray] | None = None, after: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Viterbi tags and their posterior chances, for regions of scores (time, tag) at once.

    Parts of a longer region bring what the rest of it says: ``ahead_of`` the best
    and the summed scores (row, tag) that end just before each part, ``after`` the
    summed scores of what follows each tag of its last character, and that tag.
    """
    length = np.array([len(r) for r in regions_])
    rows, steps = np.arange(len(regions_)), int(length.max())
    scores = np.zeros((steps, len(rows), TAGS))
    for k, own in enumerate(regions_):
        scores[: len(own), k] = own
    inside = np.arange(steps)[:, None] < length
    links = np.tile(np.arange(TAGS, dtype=np.int8), (steps, len(rows), 1))
    best, total = scores[0], scores[0]
    if ahead_of:
        best = (ahead_of[0][:, :, None] + moves).max(axis=1) + scores[0]
        total = _lse(ahead_of[1][:, :, None] + moves, 1) + scores[0]
    ahead = [total]
    for t in range(1, steps):
        on = inside[t][:, None]
        way = best[:, :, None] + moves
        links[t] = np.where(on, way.argmax(axis=1), links[t])
        best = np.where(on, way.max(axis=1) + scores[t], best)
        total = np.where(on, _lse(total[:, :, None] + moves, 1) + scores[t], total)
        ahead.append(total)
    behind, tag = after or (np.zeros((len(rows), TAGS)), best.argmax(axis=1))
    sure = np.zeros((steps, len(rows)))
    tags = np.zeros((steps, len(rows)), dtype=np.int8)
    whole = _lse(total + behind, 1)
    for t in range(steps - 1, -1, -1):
        tags[t] = tag
        sure[t] = np.exp(ahead[t][rows, tag] + behind[rows, tag] - whole)
        tag = links[t, rows, tag]
        if t:
            behind = np.where(inside[t][:, None], _lse(moves + (scores[t] + behind)[:, None, :], 2), behind)
    return [(tags[:n, k], sure[:n, k]) for k, n in enumerate(length)]


def transfers(moves: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Best and summed scores (part, 2, tag, tag) of all ways through each part, from the tag before it to its last."""
    length = np.array([len(r) for r in parts])
    scores = np.zeros((int(length.max()), len(parts), 1, TAGS))
    for k, own in enumerate(parts):
        scores[: len(own), k, 0] = own
    # ways that don't exist cost more than any real one
    best = np.tile(np.where(np.eye(TAGS) > 0, 0.0, -1e30), (len(parts), 1, 1))
    total, factor = best, np.exp(moves)
    for t, own in enumerate(scores):
        on = (t < length)[:, None, None]
        way = best[:, :, :1] + moves[0]
        for tag in range(1, TAGS):
            np.maximum(way, best[:, :, tag : tag + 1] + moves[tag], out=way)
        best = np.where(on, way + own, best)
        top = total.max(axis=2, keepdims=True)
        total = np.where(on, np.log(np.exp(total - top) @ factor) + top + own, total)
    return np.stack([best, total], axis=1)


def decode_long(moves: np.ndarray, read: Callable[[int, int], np.ndarray], length: int, *, block: int = 1 << 16, part: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """What ``decode`` says of one region of any length, whose scores ``read(start, stop)`` gives.

    Scores are held of one block at a time. A block's parts run side by side: first
    for every tag before them, which gives the exact messages between parts, then
    with these. The first character has none before it and is handled alone.
    """

    def blocks() -> Iterator[list[np.ndarray]]:
        for a in range(1, length, block):
            own = read(a, min(length, a + block)).astype(np.float64)
            yield [own[k : k + part] for k in range(0, len(own), part)]

    through = np.concatenate([transfers(moves, parts) for parts in blocks()])
    first = read(0, 1)[0].astype(np.float64)
    ahead = np.zeros((2, len(through) + 1, TAGS))
    ahead[:, 0] = first
    for k, (best, total) in enumerate(through):
        ahead[0, k + 1] = (ahead[0, k][:, None] + best).max(axis=0)
        ahead[1, k + 1] = _lse(ahead[1, k][:, None] + total, 0)
    behind = np.zeros((len(through) + 1, TAGS))
    last = np.zeros(len(through) + 1, dtype=np.int64)
    last[-1] = ahead[0, -1].argmax()
    for k in range(len(through) - 1, -1, -1):
        behind[k] = _lse(through[k, 1] + behind[k + 1], 1)
        last[k] = (ahead[0, k] + through[k, 0][:, last[k + 1]]).argmax()
    chance = ahead[1, 0] + behind[0]
    done = [(last[:1].astype(np.int8), np.exp(chance[last[:1]] - _lse(chance, 0)))]
    k = 0
    for parts in blocks():
        n = k + len(parts)
        done += decode(moves, parts, (ahead[0, k:n], ahead[1, k:n]), (behind[k + 1 : n + 1], last[k + 1 : n + 1]))
        k = n
    return np.concatenate([tags for tags, _ in done]), np.concatenate([sure for _, sure in done])


# ---- training -------------------------------------------------------------


def tagged(text: str, spans: list[Span]) -> np.ndarray:
    """One tag per character: 0 outside, 1 + 2k at the start of kind k, 2 + 2k inside."""
    out = np.zeros(len(text), dtype=np.int64)
    for a, b, kind in reversed(spans):
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] -= 1
    return out


def _digits(random: np.random.Generator, n: int) -> str:
    return "".join(map(str, random.integers(0, 10, n)))


def _word(random: np.random.Generator) -> str:
    return "".join(random.choice(list("abcdefghijklmnoprstuvwz"), int(random.integers(3, 9))))


def _card_number(random: np.random.Generator, size: int = 16) -> str:
    start = _digits(random, size - 1)
    return next(start + d for d in "0123456789" if luhn(digits(start + d)))


def planted(random: np.random.Generator) -> tuple[str, list[Span]]:
    """A text piece in a form that the patterns miss, and its spans."""
    form = int(random.integers(0, 16))
    d, w = lambda n: _digits(random, n), lambda: _word(random)
    host = f"{w()}{random.integers(1, 99)}.{random.choice(['example.com', 'example', 'example.org', 'test'])}"
    if form < 6:
        a, b, c = d(3), d(3), d(4)
        text = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}", f"00{random.integers(1, 99)} {a} {b} {c}", f"1-{a}-{b}-{c}"][form]
        return text, [(0, len(text), "phone")]
    if form < 8:  # a match of the pattern takes in what follows, and fails
        own = f"+{random.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}"
        more = ".".join(map(str, random.integers(10, 256, 4))) if form == 6 else _card_number(random)
        return f"{own} {more}", [(0, len(own), "phone"), (len(own) + 1, len(own) + 1 + len(more), "ip" if form == 6 else "card")]
    if form < 11:
        number, between = _card_number(random), str(random.choice([".", "/", "_", " ", " - ", " . "]))
        text = between.join(number[k : k + 4] for k in range(0, 16, 4))
        return text, [(0, len(text), "card")]
    if form < 14:
        odd = str(random.choice(list("éüñößçåø")))
        local = w() + str(random.choice(["", "." + w(), str(random.integers(1, 99))]))
        text = [f"{local} {random.choice(['(at)', '[at]', '{at}'])} {host}", f"{local}[at]{host.replace('.', ' [dot] ')}", f"{local}@{w()}{odd}{w()}.example" if random.random() < 0.5 else f"{local}{odd}@{host}"][form - 11]
        return text, [(0, len(text), "email")]
    text = str(random.choice(["[.]", "(.)", " . ", "[dot]"])).join(map(str, random.integers(1, 256, 4)))
    return text, [(0, len(text), "ip")]


def harmless(random: np.random.Generator) -> str:
    """Numbers and signs that are no personal data."""
    d, n = lambda k: _digits(random, k), lambda a, b: int(random.integers(a, b))
    hexes = lambda k: "".join(random.choice(list("0123456789abcdef"), k))
    return [
        lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", lambda: f"{n(1, 29)}.{n(1, 13):02}.{n(1900, 2100)}", lambda: f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2100)}",
        lambda: f"{n(0, 24)}:{n(0, 60):02}:{n(0, 60):02}", lambda: f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02} {n(0, 24)}:{n(0, 60):02}", lambda: f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}",
        lambda: f"{n(1, 10)}.{n(0, 10)}", lambda: f"{n(1, 999)},{d(3)},{d(3)}.{d(2)}", lambda: f"{n(1, 999)}.{d(3)}.{d(3)},{d(2)}", lambda: f"$ {n(1, 9999)}.{d(2)}",
        lambda: f"{n(1900, 2000)}-{n(2000, 2100)}", lambda: f"pp. {n(1, 400)}-{n(400, 900)}", lambda: f"978-{n(0, 10)}-{d(2)}-{d(6)}-{n(0, 10)}", lambda: f"No. {d(n(5, 12))}",
        lambda: hexes(40), lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: ", ".join(str(n(0, 999)) for _ in range(n(3, 9))), lambda: f"{n(0, 90)}.{d(4)}, {n(0, 90)}.{d(4)}",
        lambda: f"{d(2)}-{d(3)}-{d(3)}", lambda: f"{n(1, 99)} (at) {n(1, 99)}", lambda: f"@{_word(random)}", lambda: f"{_word(random)}@", lambda: " ".join(d(n(1, 4)) for _ in range(n(2, 8))),
        lambda: ".".join(d(n(5, 9)) for _ in range(4)), lambda: f"{d(5)}/{d(2)}", lambda: f"{n(1, 99)} % ({n(1, 99)} of {n(100, 999)})",
    ][n(0, 26)]()


def examples(text: str, random: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A few windows of a text, as it is and with planted pieces: classes and tags of ``LEARNED`` characters."""

    def window(own: str, known: list[Span], about: int) -> tuple[np.ndarray, np.ndarray]:
        code, y = classes(own), tagged(own, known)
        first = about - int(random.integers(8, LEARNED - 24))
        first = max(0, min(first, len(code) - LEARNED))
        out = np.zeros((2, LEARNED), dtype=np.uint8)
        out[0, : len(code) - first], out[1, : len(code) - first] = code[first : first + LEARNED], y[first : first + LEARNED]
        return out[0], out[1]

    def around(at: int) -> tuple[str, str]:
        return text[max(0, at - 600) : at], text[at : at + 600]

    spans = pattern_spans(text)
    places = [spans[k][0] for k in random.permutation(len(spans))[:2]]
    for at in [*places, int(random.integers(0, len(text) + 1))]:
        left, right = around(at)
        yield window(left + right, pattern_spans(left + right), len(left))
    for _ in range(4):
        at = text.find(" ", int(random.integers(0, len(text) + 1)))
        left, right = around(len(text) if at < 0 else at)
        piece, own = planted(random) if random.random() < 0.6 else (harmless(random), [])
        left += str(random.choice([" ", " ", " ", "\n", " (", ": ", " tel. ", " call ", " mail ", " card ", " "]))
        whole = left + piece + str(random.choice(["", "", ".", ",", ")", ";", ":"])) + right
        own = [(a + len(left), b + len(left), kind) for a, b, kind in own]
        # spans of the patterns that touch the planted ones are parts of them
        known = [s for s in pattern_spans(whole) if not any(s[0] < b and a < s[1] for a, b, _ in own)]
        yield window(whole, sorted([*known, *own]), len(left))


def learn(held: pa.Table) -> Arrays:
    """Adam on batches of ``BATCH`` windows, half of them with a span."""
    random = np.random.default_rng(17)
    x, y = (np.frombuffer(b"".join(held.column(n).to_pylist()), dtype=np.uint8).reshape(-1, LEARNED) for n in ("code", "tags"))
    x, y = x[:TRAIN_WINDOWS], y[:TRAIN_WINDOWS].astype(np.int64)
    model = fresh(random)
    some = y.any(axis=1)
    groups = [g for g in (np.flatnonzero(some), np.flatnonzero(~some)) if len(g)]
    first, second = ({n: np.zeros_like(v) for n, v in model.items()} for _ in range(2))
    for step in range(1, BATCHES + 1):
        at = np.concatenate([random.choice(g, BATCH // len(groups)) for g in groups])
        rate = 0.015 * min(1, step / 20, 2 * (1 - (step - 1) / BATCHES))
        found = slopes(model, x[at], y[at])
        size = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
        for n, g in found.items():
            g = g / max(1.0, size / 2)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            change = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            model[n] = (model[n] - change).astype(np.float32)
    return model


def learn_tagger(docs: DataFrame, *, texts: int = 4000, others: int = 1500) -> bytes:
    """Train on windows of about ``texts`` texts that hold a digit or @ and of about ``others`` of all.

    Texts are chosen by a hash of id and text. Each gives at most seven windows in its
    own task; of these about ``TRAIN_WINDOWS`` reach the one that trains.
    """
    marked = F.col("text").rlike("[0-9@]")
    size = docs.agg(F.count("text").alias("all"), F.count_if(marked).alias("some")).first()
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    shares = [int(1_000_000 * min(1.0, n / max(1, size[k]))) for n, k in ((texts, "some"), (others, "all"))]
    chosen = docs.where(F.col("text").isNotNull() & ((marked & (place < shares[0])) | (place < shares[1]))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seed = int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "little")
                made = [(x.tobytes(), y.tobytes()) for x, y in examples(text, np.random.default_rng(seed))]
                yield pa.RecordBatch.from_pydict({"code": pa.array([x for x, _ in made], pa.binary()), "tags": pa.array([y for _, y in made], pa.binary())})

    windows = chosen.mapInArrow(run, "code binary, tags binary")
    # of about 7 * (texts + others) windows of 192 bytes
    return fit(windows.repartition(1).sortWithinPartitions(F.xxhash64("code", "tags"), "code", "tags"), learn)


# ---- tagging --------------------------------------------------------------


def windows_of(bounds: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all windows, of texts with these bounds, that touch characters [lo, hi)."""
    first, size = bounds[:-1], np.diff(bounds)
    a, b = np.clip(lo - first, 0, size), np.clip(hi - first, 0, size)
    used = np.flatnonzero(b > a)
    a, b, first, size = a[used], b[used], first[used], size[used]
    most = np.where(size <= WINDOW, 1, 1 - (WINDOW - size) // STRIDE)
    low, high = np.maximum(0, (a - WINDOW) // STRIDE + 1), np.minimum(most, (b - 1) // STRIDE + 1)
    each = high - low
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
    start = np.repeat(first, each) + k * STRIDE
    return start, np.minimum(start + WINDOW, np.repeat(first + size, each))


def scores_of(model: Arrays, code: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The windows' votes on characters [lo, hi) of the texts with these bounds."""
    start, stop = windows_of(bounds, lo, hi)
    length = -(-(stop - start) // STEP) * STEP
    total, weight = np.zeros((hi - lo, TAGS), dtype=np.float32), np.full((hi - lo, 1), 1e-6, dtype=np.float32)
    for size in np.unique(length):
        near = np.minimum(np.arange(size), np.arange(size)[::-1]).astype(np.float32)[:, None] + 1
        own = np.flatnonzero(length == size)
        for group in np.array_split(own, -(-len(own) // GROUP)):
            at = start[group, None] + np.arange(size)
            scores = read_windows(model, np.where(at < stop[group, None], code[np.minimum(at, len(code) - 1)], 0))
            scores *= near
            scores = np.ascontiguousarray(scores)
            begin, first, last = start[group].tolist(), np.maximum(start[group], lo).tolist(), np.minimum(stop[group], hi).tolist()
            for row, (a, b, c) in enumerate(zip(begin, first, last, strict=True)):
                total[b - lo : c - lo] += scores[row, b - a : c - a]
                weight[b - lo : c - lo] += near[b - a : c - a]
    total /= weight
    return total


def surely_outside(scores: np.ndarray, moves: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Characters that the best path surely leaves untagged; ``border[t]`` tells that a text begins at t.

    Against "outside" a tag at one character loses the lead of tag 0 there and wins at
    most ``inner`` by the transition to it. In a run of characters that all lose, no
    path stays tagged once the losses exceed what leaving and entering can cost, on
    the way from either end of the run; beyond the end of a text nothing is to be won.
    """
    own = moves - moves[0, 0]
    inner, enter, leave = own[1:, 1:].max(), own[0, 1:], own[1:, 0]
    alone = max(0.0, max(0.0, enter.max()) + max(0.0, leave.max()) - inner)
    cost = max(0.0, np.ptp(leave), np.ptp(enter), inner - leave.min() - enter.min())
    most = scores[:, 1].copy()
    for tag in range(2, TAGS):
        np.maximum(most, scores[:, tag], out=most)
    lost = (scores[:, 0] - most).astype(np.float64) - inner
    size = len(lost)
    fine = lost > alone
    total = np.concatenate([[0.0], np.cumsum(np.where(fine, lost, 0.0))])
    place = np.arange(size)
    opens, closes = border[:size].copy(), border[1 : size + 1].copy()
    opens[1:] |= ~fine[:-1]
    closes[:-1] |= ~fine[1:]
    opens[:1] = closes[-1:] = True
    first = np.maximum.accumulate(np.where(opens, place, 0))
    last = np.minimum.accumulate(np.where(closes, place, size)[::-1])[::-1]
    ahead = border[first] | (total[place + 1] - total[first] > cost)
    behind = border[last + 1] | (total[last + 1] - total[place] > cost)
    return fine & ahead & behind


OUTSIDE = np.full((1, TAGS), -1e6, dtype=np.float32)
OUTSIDE[0, 0] = 0


def stretches(model: Arrays, code: np.ndarray, bounds: np.ndarray, *, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Start, tags and chances of all stretches that can hold a span; memory is bounded by a few blocks."""
    moves = model["moves"].astype(np.float64)
    border = np.zeros(len(code) + 1, dtype=bool)
    border[bounds] = True
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0

    def closed(a: int, b: int, own: list[np.ndarray]) -> tuple[int, np.ndarray]:
        return a - (not border[a]), np.concatenate([*([] if border[a] else [OUTSIDE]), *own, *([] if border[b] else [OUTSIDE])])

    def far(a: int, b: int) -> tuple[int, np.ndarray, np.ndarray]:
        return a, *decode_long(moves, lambda lo, hi: scores_of(model, code, bounds, a + lo, a + hi), b - a)

    held: list[np.ndarray] = []
    opened = None
    for lo in range(0, len(code), block):
        hi = min(len(code), lo + block)
        scores = scores_of(model, code, bounds, lo, hi)
        free = np.concatenate([[False], ~surely_outside(scores, moves, border[lo : hi + 1]), [False]])
        joint = free[1:] & free[:-1] & border[lo : hi + 1]  # two texts meet
        begin = np.flatnonzero((free[1:] & ~free[:-1]) | joint) + lo
        end = np.flatnonzero((free[:-1] & ~free[1:]) | joint) + lo
        if opened is not None and (border[lo] or not free[1]):
            if lo - opened > LONG:
                yield far(opened, lo)
            else:
                waiting.append(closed(opened, lo, held))
            opened, held = None, []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            own = scores[a - lo : b - lo]
            if a == lo and opened is not None:
                a = opened
            else:
                held = []
            held = [*held, own] if b - a <= LONG else []
            if b == hi and not border[hi]:
                opened = a
                continue
            opened = None
            if b - a > LONG:
                yield far(a, b)
            else:
                waiting.append(closed(a, b, held))
                size += b - a
        if size >= CELLS or hi == len(code):
            yield from _decoded(moves, waiting)
            waiting, size = [], 0


def _decoded(moves: np.ndarray, own: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Decode stretches in groups of like lengths and of at most ``CELLS`` characters, padding included."""
    order = sorted(own, key=lambda v: (len(v[1]), v[0]))
    first = 0
    while first < len(order):
        stop = first + 1
        longest = 8 + 1.5 * len(order[first][1])
        while stop < len(order) and len(order[stop][1]) <= longest and (stop + 1 - first) * len(order[stop][1]) <= CELLS:
            stop += 1
        group = order[first:stop]
        for (a, _), (tags, sure) in zip(group, decode(moves, [v for _, v in group]), strict=True):
            yield a, tags, sure
        first = stop


def tagger_spans(model: Arrays, texts: list[str]) -> list[list[Span]]:
    """Confident spans of the tagger in each text, that are of their kind."""
    out: list[list[Span]] = [[] for _ in texts]
    code, bounds = reading(texts)
    for a, tags, sure in stretches(model, code, bounds):
        for start in np.flatnonzero(tags % 2 == 1).tolist():
            stop = start + 1
            while stop < len(tags) and tags[stop] == tags[start] + 1:
                stop += 1
            if sure[start:stop].min() < SURE:
                continue
            k = int(np.searchsorted(bounds, a + start, "right")) - 1
            span = a + start - int(bounds[k]), a + stop - int(bounds[k]), KINDS[(int(tags[start]) - 1) // 2]
            if valid(span[2], texts[k][span[0] : span[1]]):
                out[k].append(span)
    return [sorted(own) for own in out]


def all_spans(base: list[Span], added: list[Span]) -> list[Span]:
    """Base spans, and those added ones that overlap none of them."""
    taken: list[list[int]] = []
    for a, b, _ in base:  # by start
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        before = bisect_left(starts, b)  # the last one that starts before the span's end
        return not before or taken[before - 1][1] <= a

    return sorted([*base, *(s for s in added if free(s[0], s[1]))], key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: bytes, *, redact: bool = False) -> DataFrame:
    """All columns of ``docs`` and what is found in ``text``.

    Adds ``n_email, n_ip, n_card, n_phone`` (matches of the patterns), ``base_sha256``
    of their spans as ``kind:start:end`` (code points, end exclusive) and ``spans``,
    those of both patterns and tagger. With ``redact`` the text is replaced by its
    redacted form. A null text stays null and has no spans, like an empty one.
    Without a model the patterns stand alone. The longest text of a batch needs about
    20 bytes of memory a character. Old columns of the new names are
    replaced, others kept; rows are independent of each other.
    """
    names = [f"n_{k}" for k in KINDS]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = load(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for chunk in chunks(batch.column(at)):
                kept = [c.slice(chunk.first, chunk.rows) for c in batch.columns]
                raw = kept[at].to_pylist()
                texts = [t or "" for t in raw]
                base = [pattern_spans(t) for t in texts]
                added = tagger_spans(arrays, texts) if arrays else [[] for _ in texts]
                spans = [all_spans(b, a) for b, a in zip(base, added, strict=True)]
                if redact:
                    kept[at] = pa.array([t and redacted(t, s) for t, s in zip(raw, spans, strict=True)], pa.string())
                counts = [pa.array([sum(s[2] == kind for s in own) for own in base], pa.int64()) for kind in KINDS]
                digest = pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own in base])
                yield pa.RecordBatch.from_arrays([*kept, *counts, digest, pa.array([written(s) for s in spans], pa.string())], names=[*batch.schema.names, *names, "base_sha256", "spans"])

    own = docs.drop(*names, "base_sha256", "spans")
    fields = [*(T.StructField(n, T.LongType()) for n in names), *(T.StructField(n, T.StringType()) for n in ("base_sha256", "spans"))]
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *fields]))
