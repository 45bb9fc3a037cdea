"""Personal data in texts: fixed forms by rule, further ones by a character tagger.

The rules find e-mail addresses, IPv4 addresses, card and phone numbers of the usual forms.
The tagger is a bidirectional LSTM over characters with a CRF of begin, inside and
outside tags above it, written and trained in numpy on labelled spans: the spans
that the rules find in a bounded sample of the corpus (``SAMPLE_WINDOWS``), and
spans of usual and unusual forms put between words of this sample, beside numbers that are
no personal data. It adds spans that the rules miss: numbers without a plus sign, addresses
with blanks or letters beyond ASCII, cards of 15 digits or with other separators.

A text is dealt into overlapping windows. Each window is decoded by the CRF's forward and
backward sums; where windows overlap, the tags' probabilities are averaged, a window
counting the more the farther a character is from its edge, and the spans are
read from the whole text's tags, so a span may be longer than a window. No kind is
without a digit or an at sign, so windows that hold neither take no part; this
depends on the text alone. Every text is read whole, in time linear in its length.

Spans that overlap a rule's span, or whose characters cannot be of their kind, are
not added. Only the sample and the weights pass through the driver.

Defined cases: null and empty texts have no spans; an empty table gives no rows, and without a
sample the words between the spans are made up; repeated rows give equal rows; ids may be null or repeated;
offsets count code points; other columns are never read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and between the beginnings of two; windows in one batch.
WINDOW, STRIDE, BATCH = 64, 32, 512
#: Windows of the corpus that the tagger is trained on, and spans made up beside them; passes and sizes of the network.
SAMPLE_WINDOWS, MADE_UP, EPOCHS, EMBEDDED, HIDDEN = 400, 2600, 10, 12, 16
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_SIGN = re.compile("[0-9@]")
# The rules' forms. Runs are taken whole (possessive), which changes no match and keeps time linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # number of the kind, start, end


def luhn(digits: str) -> bool:
    twice = [2 * int(x) - 9 * (x > "4") for x in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def rule_spans(text: str) -> list[Span]:
    """Spans of the usual forms, by kind, then start."""
    found: list[Span] = []
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


# --- the network

_SYMBOLS = np.full(128, 96, np.int64)
_SYMBOLS[32:127] = np.arange(1, 96)
_SYMBOLS[ord("A") : ord("Z") + 1] = _SYMBOLS[ord("a") : ord("z") + 1]
_SYMBOLS[ord("0") : ord("9") + 1] = _SYMBOLS[ord("0")]
SYMBOLS = 98


def symbols(text: str) -> np.ndarray:
    """Numbers of the characters: printable ASCII each its own, but digits one and letters whatever their case, other ASCII one, all others one; 0 is beyond the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _SYMBOLS[np.minimum(points, 127)], 97)


def allowed() -> np.ndarray:
    """Which tag may follow which: inside only after begin or inside of its kind."""
    out = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden states of (steps, directions, rows, inputs), and what the way back needs."""
    steps, sides, rows, _ = x.shape
    size = u.shape[1]
    gates, cells, hidden = np.empty((steps, sides, rows, 4 * size), x.dtype), *np.zeros((2, steps + 1, sides, rows, size), x.dtype)
    given = x @ w + b
    for t in range(steps):
        g = given[t] + hidden[t] @ u
        g[..., : 3 * size] = _sigmoid(g[..., : 3 * size])
        g[..., 3 * size :] = np.tanh(g[..., 3 * size :])
        i, f, o, c = (g[..., k * size : (k + 1) * size] for k in range(4))
        cells[t + 1] = f * cells[t] + i * c
        hidden[t + 1] = o * np.tanh(cells[t + 1])
        gates[t] = g
    return hidden[1:], (x, gates, cells, hidden)


def _lstm_back(d_out: np.ndarray, kept: tuple, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs and of w, u, b."""
    x, gates, cells, hidden = kept
    steps, size = d_out.shape[0], d_out.shape[-1]
    d_gates, d_h, d_c = np.empty_like(gates), *np.zeros((2, *d_out.shape[1:]), gates.dtype)
    for t in reversed(range(steps)):
        i, f, o, c = (gates[t, ..., k * size : (k + 1) * size] for k in range(4))
        shown = np.tanh(cells[t + 1])
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - shown * shown)
        d = d_gates[t]
        d[..., :size], d[..., size : 2 * size] = d_c * c * i * (1 - i), d_c * cells[t] * f * (1 - f)
        d[..., 2 * size : 3 * size], d[..., 3 * size :] = d_h * shown * o * (1 - o), d_c * i * (1 - c * c)
        d_h, d_c = d @ u.transpose(0, 2, 1), d_c * f
    flat = lambda x: x.transpose(1, 0, 2, 3).reshape(x.shape[1], -1, x.shape[3])
    gradient = lambda x: flat(x).transpose(0, 2, 1) @ flat(d_gates)
    return d_gates @ w.transpose(0, 2, 1), gradient(x), gradient(hidden[:-1]), d_gates.sum(axis=(0, 2))[:, None]


def crf_sums(emitted: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (steps, rows, tags): each step's tag probabilities, the expected number of each move, and each row's log sum over all tag sequences."""
    steps, rows, tags = emitted.shape
    top = emitted.max(axis=2, keepdims=True)
    e, m = np.exp(emitted - top), np.exp(moves)
    ahead, scale = np.empty_like(e), np.empty((steps, rows, 1), e.dtype)
    for t in range(steps):
        a = e[t] * (np.exp(first) if t == 0 else ahead[t - 1] @ m)
        scale[t] = a.sum(axis=1, keepdims=True)
        ahead[t] = a / scale[t]
    behind, moved = np.ones((rows, tags), e.dtype), np.zeros((tags, tags), e.dtype)
    out = np.empty_like(e)
    out[-1] = ahead[-1]
    for t in range(steps - 1, 0, -1):
        some = e[t] * behind / scale[t]
        moved += m * (ahead[t - 1].T @ some)
        behind = some @ m.T
        out[t - 1] = ahead[t - 1] * behind
    return out, moved, (np.log(scale) + top).sum(axis=(0, 2))


@dataclass
class Tagger:
    """Weights by name."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def begun(seed: int = 7, kind: type = np.float32) -> Tagger:
        rng = np.random.default_rng(seed)
        near = lambda *shape: rng.normal(0, (1 / shape[-2]) ** 0.5, shape)
        w = {"embedding": rng.normal(0, 0.3, (SYMBOLS, EMBEDDED)), "out": near(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        # of the LSTM onwards and backwards; it begins by remembering
        w |= {"w": near(2, EMBEDDED, 4 * HIDDEN), "u": near(2, HIDDEN, 4 * HIDDEN), "b": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN), (2, 1, 1))}
        return Tagger({name: x.astype(kind) for name, x in w.items()})

    def emitted(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        x = w["embedding"][ids.T]
        hidden, kept = _lstm(np.stack([x, x[::-1]], axis=1), w["w"], w["u"], w["b"])
        both = np.concatenate([hidden[:, 0], hidden[::-1, 1]], axis=2)
        return both @ w["out"] + w["bias"], (both, kept)

    def moves(self) -> np.ndarray:
        return np.where(allowed(), self.weights["moves"], self.weights["moves"].dtype.type(-1e4))

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """(rows, characters, tags) of windows of symbols."""
        return crf_sums(self.emitted(ids)[0], self.moves(), self.weights["first"])[0].transpose(1, 0, 2)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a row's tags, and its gradients."""
        w, (rows, steps) = self.weights, ids.shape
        emitted, (both, kept) = self.emitted(ids)
        moves = self.moves()
        p, moved, total = crf_sums(emitted, moves, w["first"])
        y = tags.T
        t, r = np.ogrid[:steps, :rows]
        said = emitted[t, r, y].sum(axis=0) + moves[y[:-1], y[1:]].sum(axis=0) + w["first"][y[0]]
        d = p.copy()
        d[t, r, y] -= 1
        seen = np.zeros_like(moved)
        np.add.at(seen, (y[:-1], y[1:]), 1)
        grads = {"moves": np.where(allowed(), moved - seen, 0), "first": d[0].sum(axis=0), "bias": d.sum(axis=(0, 1)), "out": both.reshape(-1, both.shape[2]).T @ d.reshape(-1, TAGS)}
        d_both = d @ w["out"].T
        d_x, grads["w"], grads["u"], grads["b"] = _lstm_back(np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]], axis=1), kept, w["w"], w["u"])
        shown = np.eye(SYMBOLS, dtype=d_x.dtype)[ids.T.ravel()]
        grads["embedding"] = shown.T @ (d_x[:, 0] + d_x[::-1, 1]).reshape(-1, EMBEDDED)
        return float((total - said).mean()), {name: g / rows for name, g in grads.items()}


def train(labelled: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.03, batch: int = 64, seed: int = 7) -> Tagger:
    """A tagger from (text of at most a window, its spans), by Adam with a falling rate."""
    ids, tags = np.zeros((len(labelled), WINDOW), np.int64), np.zeros((len(labelled), WINDOW), np.int64)
    for row, (text, spans) in enumerate(labelled):
        ids[row, : len(text)] = symbols(text)
        for kind, start, end in spans:
            tags[row, start:end] = 2 + 2 * kind
            tags[row, start] = 1 + 2 * kind
    tagger, rng = Tagger.begun(seed), np.random.default_rng(seed)
    mean, square = ({name: np.zeros_like(x) for name, x in tagger.weights.items()} for _ in range(2))
    steps = epochs * -(-len(labelled) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labelled))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            step += 1
            for name, g in tagger.loss(ids[some], tags[some])[1].items():
                g = np.clip(g, -5, 5)
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.01 * (g * g - square[name])
                tagger.weights[name] -= rate * (1 - step / (steps + 1)) * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
    return tagger


# --- labelled spans


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _with_check_digit(digits: str) -> str:
    return next(digits + x for x in "0123456789" if luhn(digits + x))


def made_up(rng: np.random.Generator, words: list[str]) -> tuple[str, int | None]:
    """A string and its kind, usual or not; None for numbers and signs that are no personal data."""
    pick = lambda *some: some[rng.integers(len(some))]
    word = lambda: words[rng.integers(len(words))].lower()[:8]
    kind = int(rng.integers(-3, len(KINDS)))
    if kind == 0:
        local = pick(word(), word() + pick(".", "_", "-", "+") + word(), word() + _digits(rng, 2), word() + "." + _digits(rng, 2))
        host = pick(word(), word() + "-" + word(), "mail" + _digits(rng, 1) + "." + word(), "localhost", word() + "." + word())
        return local + pick("@", "@", "@", " @ ", "@ ", "(@)") + host + pick("", ".com", ".com", ".org", ".co.uk", ".net"), 0
    if kind == 1:
        if rng.integers(4) == 0:
            return ":".join(f"{x:x}" for x in rng.integers(4096, 65536, 8)), 1
        return ".".join(map(str, rng.integers(1, 256, 4))), 1
    if kind == 2:
        digits = _with_check_digit(pick("37", "34") + _digits(rng, 12) if rng.integers(3) == 0 else _digits(rng, 15))
        gap = pick("", " ", "-", ".", "  ", "/")
        sizes = (4, 6, 5) if len(digits) == 15 else (4, 4, 4, 4)
        ends = np.cumsum([0, *sizes])
        return gap.join(filter(None, (digits[a:b] for a, b in zip(ends, ends[1:])))), 2
    if kind == 3:
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        near = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a}/{b}-{c}", f"{a} {b} {c}")
        return pick("+1 ", "+1 ", "+", "1-", "00" + _digits(rng, 2) + " ", "", "") + near, 3
    year = f"{rng.integers(1900, 2100)}"
    date = f"{year}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    hexed = "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(8, 33)))
    return pick(
        year, date, date.replace("-", "/"), f"{rng.integers(24)}:{rng.integers(60):02d}", f"{rng.integers(1, 99)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"{rng.integers(9)}.{rng.integers(20)}", f"{rng.integers(9)}.{rng.integers(20)}.{rng.integers(9)}", hexed,
        f"password={hexed}", f"key_{hexed}", word() + _digits(rng, 2), "#" + _digits(rng, 4), _digits(rng, int(rng.integers(1, 8))), f"{rng.integers(99)} @ {rng.integers(99)}", f"@{word()}", f"{_digits(rng, 2)} %", f"page {rng.integers(999)} of {rng.integers(999)}", f"({year})",
    ), None


def labelled_spans(windows: list[str], many: int = MADE_UP, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """The windows with the rules' spans, and made-up strings between words of the windows."""
    rng = np.random.default_rng(seed)
    words = sorted({w for x in windows for w in re.findall("[A-Za-zÀ-ÿ]{2,12}", x)}) or "the and ing tion ent for with that".split()
    out = [(x[:WINDOW], rule_spans(x[:WINDOW])) for x in windows]
    for _ in range(many):
        text, kind = made_up(rng, words)
        some = [words[i] for i in rng.integers(len(words), size=8)]
        before = " ".join(some[: rng.integers(0, 4)]) + (" ", ": ", "\n", " ", "(", "")[rng.integers(6)]
        before = before[max(0, len(text) + len(before) - WINDOW + 2) :] if rng.integers(4) else ""
        after = (" ", ". ", ", ", "\n", ")", "")[rng.integers(6)] + " ".join(some[4 : 4 + rng.integers(0, 4)])
        if after[:1].isalnum() or before[-1:].isalnum():
            after, before = " " + after, before + " "
        whole = (before + text + after)[:WINDOW]
        out.append((whole, [] if kind is None or len(before) + len(text) > WINDOW else [(kind, len(before), len(before) + len(text))]))
    return out


def sampled_windows(docs: DataFrame, text_col: str = "text", windows: int = SAMPLE_WINDOWS) -> list[str]:
    """Windows round the first digit or at sign of ``windows`` texts, chosen by a hash of the window."""
    rows = docs.select(docs[text_col].alias("text")).filter(F.col("text").rlike("[0-9@]"))
    at = F.greatest(F.lit(1), F.regexp_instr("text", F.lit("[0-9@]")) - WINDOW // 2)
    rows = rows.select(F.col("text").substr(at, F.lit(WINDOW)).alias("window")).distinct()
    return [r["window"] for r in rows.orderBy(F.xxhash64("window"), "window").limit(windows).collect()]


def fit(docs: DataFrame, text_col: str = "text", windows: int = SAMPLE_WINDOWS) -> Tagger:
    return train(labelled_spans(sampled_windows(docs, text_col, windows)))


# --- whole texts


def window_starts(text: str) -> list[int]:
    """Beginnings of the windows that hold a digit or an at sign."""
    found: dict[int, None] = {}
    m = _SIGN.search(text)
    while m:
        last = m.start() // STRIDE * STRIDE  # the last window that holds the sign, and those before it that do
        for start in range(max(0, last - WINDOW + STRIDE), last + 1, STRIDE):
            found[start] = None
        m = _SIGN.search(text, last + STRIDE)
    return list(found)


#: How much a window says of each of its characters.
_CENTRAL = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]


def tagged_stretches(tagger: Tagger, texts: list[str], batch: int = BATCH) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text number, offset, tags) of each run of windows that overlap, in order.

    Windows are twice their stride, so each half of one is shared with one
    neighbour: a half's probabilities are the sum of what both say. Only the last
    half waits for the next window."""
    places = [(i, start) for i, text in enumerate(texts) for start in window_starts(text)]
    waiting, begun, tags = None, None, []
    for at in range(0, len(places), batch):
        some = places[at : at + batch]
        ids = np.zeros((len(some), WINDOW), np.int64)
        for row, (i, start) in enumerate(some):
            piece = symbols(texts[i][start : start + WINDOW])
            ids[row, : len(piece)] = piece
        said = tagger.probabilities(ids) * _CENTRAL
        for place, p in zip(some, said):
            follows = waiting is not None and place == (waiting[0], waiting[1] + STRIDE)
            if waiting is not None and not follows:
                yield *begun, np.concatenate([*tags, waiting[2].argmax(axis=1)])
            if not follows:
                begun, tags = place, []
            tags.append((p[:STRIDE] + waiting[2] if follows else p[:STRIDE]).argmax(axis=1))
            waiting = (*place, p[STRIDE:])
    if waiting is not None:
        yield *begun, np.concatenate([*tags, waiting[2].argmax(axis=1)])


def spans_of_tags(tags: np.ndarray) -> list[Span]:
    """Runs of one kind; a begin tag inside one starts another."""
    kind = (tags + 1) // 2
    begins = np.flatnonzero((kind > 0) & ((tags % 2 == 1) | (kind != np.concatenate([[0], kind[:-1]]))))
    changes = np.union1d(np.flatnonzero(np.diff(kind, append=0)) + 1, begins)
    ends = changes[np.searchsorted(changes, begins, side="right")]
    return [(int(kind[a]) - 1, int(a), int(b)) for a, b in zip(begins, ends)]


_MAIL = re.compile(r"[^\s@()]+ ?[(\[]?@[)\]]? ?[^\s@()]+")
_CARD_SIGNS = re.compile(r"[0-9][0-9 ./-]*[0-9]")
_PHONE_SIGNS = re.compile(r"(?=.*[ ().+/-])[+(0-9][0-9 ().+/-]*[0-9]")
_DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}")


def plausible(kind: int, text: str) -> bool:
    """Whether the characters of a tagged span can be of its kind."""
    if kind == 0:
        local, _, host = text.partition("@")
        return bool(_MAIL.fullmatch(text)) and any(map(str.isalpha, local)) and any(map(str.isalpha, host))
    if kind == 1:
        try:
            return bool(ipaddress.ip_address(text))
        except ValueError:
            return False
    digits = "".join(_DIGIT.findall(text))
    if kind == 2:
        return bool(_CARD_SIGNS.fullmatch(text)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(_PHONE_SIGNS.fullmatch(text)) and 8 <= len(digits) <= 15 and not _DATE.fullmatch(text)


_EDGE = " \t\r\n.,;:!?\"'"


def added_spans(tagger: Tagger, texts: list[str], ruled: list[list[Span]]) -> list[list[Span]]:
    """For each text the tagger's plausible spans that meet none of the rules' spans."""
    out: list[list[Span]] = [[] for _ in texts]
    for i, offset, tags in tagged_stretches(tagger, texts):
        for kind, a, b in spans_of_tags(tags):
            a, b = a + offset, min(b + offset, len(texts[i]))
            least, most = a - WINDOW, b + WINDOW  # whole runs of letters and digits, but not of any length
            while max(0, least) < a and texts[i][a - 1 : a + 1].isalnum():
                a -= 1
            while b < min(len(texts[i]), most) and texts[i][b - 1 : b + 1].isalnum():
                b += 1
            if a == least or b == most:
                continue
            piece = texts[i][a:b]
            a, b = a + len(piece) - len(piece.lstrip(_EDGE)), b - len(piece) + len(piece.rstrip(_EDGE))
            a -= ")" in piece and "(" not in piece and texts[i][max(0, a - 1) : a] == "("
            if a < b and plausible(kind, texts[i][a:b]):
                out[i].append((kind, a, b))
    for i, some in enumerate(out):
        if some:
            some = sorted(set(some), key=lambda x: x[1:])
            some = [x for k, x in enumerate(some) if not k or some[k - 1][2] <= x[1]]  # grown spans may meet
            taken = np.array(sorted((a, b) for _, a, b in ruled[i]), np.int64).reshape(-1, 2)
            reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
            free = lambda a, b: (k := int(np.searchsorted(taken[:, 0], b))) == 0 or reach[k - 1] <= a  # noqa: B023, E731
            out[i] = [x for x in some if free(*x[1:])]
    return out


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in sorted(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
SLICE_BYTES = 1 << 22


def _found(tagger: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                rows = batch.slice(at, upto - at)
                texts = [x or "" for x in rows["text"].to_pylist()]
                ruled = [rule_spans(x) if _SIGN.search(x) else [] for x in texts]
                added = added_spans(tagger, texts, ruled)
                counts = [pa.array([sum(x[0] == kind for x in some) for some in ruled], pa.int64()) for kind in range(len(KINDS))]
                sha = [hashlib.sha256(_told(x).encode()).hexdigest() for x in ruled]
                yield pa.RecordBatch.from_arrays([rows["doc_id"], *counts, pa.array(sha, pa.string()), pa.array([_told(x + y) for x, y in zip(ruled, added)], pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])
                at = upto

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """doc_id, the rules' spans of each kind counted and digested, and all spans, of every document."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_found(tagger or fit(docs, text_col)), SCHEMA)
