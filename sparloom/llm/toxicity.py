"""Toxicity by a support vector machine on a subsequence string kernel with Nystrom landmarks (operator 1).

Sentences: a text is lower-cased and cut at empty lines and at stops that follow two letters or digits and precede white space
(so "i . d . i . o . t" is one sentence). Its symbols are letters, digits, and for each run of other signs one blank (if white
space is in it) or one sign. Instances of the machine are the stretches of a sentence from the blank before a word to the blank
after it, to that after the next word (so "drop dead" and "stu pid" are stretches with a blank inside), and the same of the
sentence with gaps taken out that stand between parts of one or two letters, or are signs without a blank ("i d i o t",
"st up id", "i.d-iot"); with digits read as the letters they look like as well ("1d10t"). Stretches of over `LONGEST` symbols
are read in overlapping windows.

Kernel: common subsequences of three symbols, blanks included, that lie within `SPAN` symbols, each weighed by `DECAY` to the
power of what it covers in either stretch, over the norm of a stretch of that length without repeats; so gaps and inserted
characters lower it gradually.

Training (on the driver, on a bounded sample: at most `positives` toxic and `negatives` other labelled texts of at most
`max_chars` characters, in the order of a hash of doc_id; near-copies count once): a sentence inherits its text's label. Which of
a toxic text's stretches make it toxic is not known. The first machine takes those that stand in far more toxic than other
texts; from then on, in turn, each toxic text gives the stretches, of all it has, that the machine holds highest, if they are
above what is usual in other texts, other texts give their highest as counter-examples, and the machine is fitted anew. It is
linear in the features K(x, landmarks) K(landmarks, landmarks)^(-1/2), with a squared hinge.

Scoring (on the executors): the machine is linear in K(x, landmark), and each K is a sum over shared subsequences, so the
weighted landmarks add up to one weight for each of the 64^3 subsequences; a stretch's margin is a sum over its own
subsequences, with the same value as the sum over landmarks. A sentence counts as its highest stretch, a text as its highest
sentence; that margin and the number of different stretches above zero are mapped to a probability. Time and memory grow with the bytes; texts are read in parts of a megabyte.

Defined cases: a null or empty text, or one without letters and digits, gets the score of the lowest margin. Bytes that are not
UTF-8 are read as U+FFFD. A null or repeated label row: the largest label of a doc_id counts, null is no label. Without labels
of both kinds the score is 0 for every text. Rows with the same doc_id, and equal rows, each get a row; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm.common import free_name, per_text

DECAY, SPAN, LONGEST, SYMBOLS = 0.6, 9, 26, 64
#: Symbols: 0 stands for no symbol, then a blank, a sign, letters, digits, other letters; 63 ends a sentence.
BLANK, SIGN, END = 1, 2, 63
LOWEST = -3.0  # the margin of a text without stretches
PART = 1 << 18  # characters that are read at once
WHITE = re.compile(r"\s")

_latin = np.arange(256)
_letters = np.array([chr(i).isalpha() for i in _latin])
CODES = np.select([(_latin >= 97) & (_latin <= 122), (_latin >= 48) & (_latin <= 57), _letters], [_latin - 94, _latin - 19, 39 + _latin % 24], 0).astype(np.uint8)
IS_BLANK, IS_STOP = np.isin(_latin, (9, 10, 11, 12, 13, 32)), np.isin(_latin, (33, 46, 63))
#: Digits and the letters they look like.
LOOKS = np.arange(SYMBOLS, dtype=np.uint8)
for _digit, _letter in zip("013457", "oieast", strict=True):
    LOOKS[CODES[ord(_digit)]] = CODES[ord(_letter)]
DIGITS = np.isin(np.arange(SYMBOLS), CODES[48:58])


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, END after each sentence and text, and the text of each symbol."""
    low = [t.lower() for t in texts]
    data = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "replace"), "<u4")
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
    begin = np.cumsum(sizes) - sizes
    wide = data > 255
    codes = np.where(wide, 39 + data % 24, CODES[data & 255]).astype(np.uint8)
    data = np.where(wide, 0, data).astype(np.uint8)
    gap = codes == 0
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    first[begin] |= gap[begin]
    runs, cut, inside = np.flatnonzero(first), np.flatnonzero(first[gap]), data[gap]
    blank, stop = np.logical_or.reduceat(IS_BLANK[inside], cut), np.logical_or.reduceat(IS_STOP[inside], cut)
    ends = np.add.reduceat(inside == 10, cut, dtype=np.int64) > 1
    ends |= blank & stop & (runs > 1) & ~gap[np.maximum(runs - 1, 0)] & ~gap[np.maximum(runs - 2, 0)]
    ends[np.searchsorted(runs, begin + sizes - 1, "right") - 1] = True
    codes = codes.copy()
    codes[runs] = np.where(ends, END, np.where(blank, BLANK, SIGN))
    keep = first | ~gap
    return codes[keep], np.repeat(np.arange(len(texts)), sizes)[keep]


def words_in(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place of each word."""
    letter = np.concatenate([[0], ((codes > SIGN) & (codes < END)).view(np.int8), [0]])
    edge = np.diff(letter)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, size, text) of all stretches: a row has LONGEST symbols, 0 after its size."""
    codes, of = symbols(texts)
    first, last = words_in(codes)
    spans = [cut(codes, of, first, last)]
    if len(first) > 1:
        within = codes[last[:-1]] != END
        spans.append(cut(codes, of, first[:-1][within], last[1:][within]))
        short = last - first < 3
        sign = codes[last[:-1]] == SIGN
        for out in (sign, sign | within & short[:-1] & short[1:]):
            if not out.any():
                continue
            gone = np.ones(len(codes), bool)
            gone[last[:-1][out]] = False
            joined = np.zeros(len(codes), bool)
            joined[first[:-1][out]] = True
            less, of_less, joined = codes[gone], of[gone], joined[gone]
            a, b = words_in(less)
            marks = np.concatenate([[0], np.cumsum(joined)])
            with_gap = marks[b] > marks[a]
            spans.append(cut(less, of_less, a[with_gap], b[with_gap]))
    rows, size, text = (np.concatenate(x) for x in zip(*spans, strict=True))
    like = np.flatnonzero(DIGITS[rows].any(axis=1) & ((rows > SIGN) & ~DIGITS[rows]).any(axis=1))
    return np.concatenate([rows, LOOKS[rows[like]]]), np.concatenate([size, size[like]]), np.concatenate([text, text[like]])


def cut(codes: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of stretches with a blank on both sides; long ones in windows that overlap by half."""
    long = last - first > LONGEST - 2
    if long.any():
        step, a, b = (LONGEST - 2) // 2, first[long], last[long]
        n = -(-(b - a - (LONGEST - 2)) // step) + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.minimum(np.repeat(a, n) + nth * step, np.repeat(b, n) - (LONGEST - 2))
        first, last = np.concatenate([first[~long], start]), np.concatenate([last[~long], start + LONGEST - 2])
    size = last - first + 2
    padded = np.concatenate([np.zeros(1, np.uint8), codes, np.zeros(LONGEST, np.uint8)])  # place p is at p + 1
    rows = np.lib.stride_tricks.sliding_window_view(padded, LONGEST)[first]
    rows[np.arange(LONGEST, dtype=np.uint8) >= size.astype(np.uint8)[:, None]] = 0
    rows[:, 0] = BLANK
    rows[np.arange(len(rows)), size - 1] = BLANK
    return rows, size.astype(np.uint8), of[first].astype(np.int32)


@cache
def triples(n: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Places of all subsequences in a stretch of n symbols, and their weights over the norm of them all."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    w = np.array([DECAY ** (k - i + 1) for i, _, k in at])
    return at, w / np.sqrt((w * w).sum()) if at else w


def by_size(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(size, kind="stable")
    edges = np.searchsorted(size[order], np.arange(LONGEST + 2))
    for n in range(3, LONGEST + 1):
        if edges[n + 1] > edges[n]:
            yield n, order[edges[n] : edges[n + 1]]


def numbers(rows: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the subsequences of rows of size n, in the order of triples()."""
    at = np.array(triples(n)[0])
    c = rows.astype(np.int32)
    return (c[:, at[:, 0]] * SYMBOLS + c[:, at[:, 1]]) * SYMBOLS + c[:, at[:, 2]]


def kernel_matrix(rows: np.ndarray, size: np.ndarray, others: np.ndarray, other_size: np.ndarray, group: int = 64) -> np.ndarray:
    """Kernels of all rows with all others, as sums over the subsequences that any of a group of the others has."""
    out = np.zeros((len(rows), len(others)), np.float32)
    for a in range(0, len(others), group):
        theirs = [(at, numbers(others[a : a + group][at], n), triples(n)[1]) for n, at in by_size(other_size[a : a + group])]
        used = np.unique(np.concatenate([ids.ravel() for _, ids, _ in theirs]))
        place = np.zeros(SYMBOLS**3, np.int32)
        place[used] = np.arange(1, len(used) + 1)
        table = np.zeros((len(used) + 1, len(others[a : a + group])), np.float32)  # row 0: what none of them has
        for at, ids, w in theirs:
            np.add.at(table, (place[ids].ravel(), np.repeat(at, ids.shape[1])), np.tile(w, len(at)))
        for n, at in by_size(size):
            w = triples(n)[1].astype(np.float32)
            step = max(1, 4_000_000 // (len(w) * group))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                out[some, a : a + group] = np.matmul(w[None, None, :], table[place[numbers(rows[some], n)]])[:, 0]
    return out


class Machine:
    """The trained machine as one weight for each subsequence, and the map from a text's margin to its score."""

    def __init__(self, landmarks: np.ndarray, size: np.ndarray, beta: np.ndarray, bias: float, slope: tuple[float, float] = (1.0, 0.0), shift: float = 0.0) -> None:
        self.weights = np.zeros(SYMBOLS**3)
        for n, at in by_size(size):
            np.add.at(self.weights, numbers(landmarks[at], n).ravel(), (beta[at][:, None] * triples(n)[1]).ravel())
        self.weights = self.weights.astype(np.float32)
        self.bias, self.slope, self.shift = bias, np.array(slope), shift

    def values(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The margin of each stretch."""
        out = np.zeros(len(rows), np.float32)
        for n, at in by_size(size):
            steps, w = triples(n)
            for i in range(0, len(at), 1 << 14):
                some = at[i : i + (1 << 14)]
                c = np.ascontiguousarray(rows[some, :n].T).astype(np.int32)
                own = np.zeros(len(some), np.float32)
                high, pair = c * SYMBOLS, {}
                for (x, y, z), v in zip(steps, w.astype(np.float32), strict=True):
                    if (x, y) not in pair:
                        pair = {(x, y): (high[x] + c[y]) * SYMBOLS}
                    own += v * self.weights[pair[x, y] + c[z]]
                out[some] = own
        return out + np.float32(self.bias)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """For each text: the margin of its highest stretch, and the logarithm of 1 + its different stretches above zero."""
        out = np.zeros((len(texts), 2))
        out[:, 0] = LOWEST
        above = [np.zeros((0, 2), np.int64)]
        for of, part in parts(texts):
            rows, size, text = stretches(part)
            if len(rows):
                value, text = self.values(rows, size), np.asarray(of)[text]
                np.maximum.at(out[:, 0], text, value)
                high = value > 0
                above.append(np.unique(np.stack([text[high], names_of(rows[high])], axis=1), axis=0))
        out[:, 1] = np.log1p(np.bincount(np.unique(np.concatenate(above), axis=0)[:, 0], minlength=len(texts)))
        return out

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.slope + self.shift, -500, 500)))


KEY = np.random.default_rng(3).integers(1, 1 << 62, LONGEST, dtype=np.int64) | 1


def names_of(rows: np.ndarray) -> np.ndarray:
    """A 64-bit sum of each row; stretches that share it are taken for one."""
    out = np.full(len(rows), KEY.sum())
    for i, k in enumerate(KEY):
        out += rows[:, i] * k
    return out


def parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of texts, texts) of about PART characters; a longer text is cut at white space, with some words in both parts."""
    of, some, size = [], [], 0
    for i, t in enumerate(texts):
        text = t.decode("utf-8", "replace")
        for piece in pieces(text) if len(text) > PART else (text,):
            of.append(i)
            some.append(piece)
            size += len(piece)
            if size >= PART:
                yield of, some
                of, some, size = [], [], 0
    if some:
        yield of, some


def pieces(text: str) -> Iterator[str]:
    """Parts of a long text, cut at white space where there is some near; they overlap by more than a stretch."""
    near, at = 8 * LONGEST, 0
    while at < len(text):
        blank = WHITE.search(text, at + PART, at + PART + near)
        end = blank.start() if blank else at + PART
        back = WHITE.search(text, max(at, end - near), end)
        yield text[at:end]
        if end >= len(text):
            break
        at = back.start() if back and back.start() > at else max(end - near, at + 1)


def support_vectors(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30, step: int = 1024) -> np.ndarray:
    """Weights of the squared-hinge machine, by Newton steps over the points inside the margin; the last is the bias."""
    n = z.shape[1] + 1
    keep = np.eye(n)
    keep[-1, -1] = 1e-3
    w, inside = np.zeros(n), np.ones(len(z), bool)
    for _ in range(rounds):
        left, right = keep.copy(), np.zeros(n)
        at = np.flatnonzero(inside)
        for i in range(0, len(at), step):  # a few rows at a time, in double precision
            some = at[i : i + step]
            x = np.hstack([z[some].astype(np.float64), np.ones((len(some), 1))])
            left += (x * cost[some, None]).T @ x
            right += x.T @ (cost[some] * y[some])
        w = np.linalg.solve(left, right)
        now = y * (z @ w[:-1].astype(np.float32) + w[-1]) < 1
        if (now == inside).all():
            break
        inside = now
    return w


class Sample:
    """Distinct stretches of the labelled texts, and which text has which."""

    def __init__(self, texts: list[bytes], y: np.ndarray) -> None:
        rows, size, names, own = [], [], [], []
        for of, part in parts(texts):
            r, n, t = stretches(part)
            name, first, which = np.unique(names_of(r), return_index=True, return_inverse=True)
            rows.append(r[first])
            size.append(n[first])
            names.append(name)
            # (text, stretch of this part) as one number
            own.append(np.unique(np.asarray(of, np.int64)[t] * len(name) + which))
        every = np.concatenate(names)
        known, first = np.unique(every, return_index=True)
        self.rows, self.size = np.concatenate(rows)[first], np.concatenate(size)[first]
        del rows, every, first
        pairs = [k // len(n) * len(known) + np.searchsorted(known, n)[k % len(n)] for k, n in zip(own, names, strict=True) if len(n)]
        del own, names
        pairs = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64))
        text, self.unit = pairs // max(1, len(known)), (pairs % max(1, len(known))).astype(np.int32)
        self.edges = np.searchsorted(text, np.arange(len(texts) + 1))
        label = y[text]
        self.pos, self.neg = (np.bincount(self.unit[label == x], minlength=len(known)) for x in (1, 0))

    def of(self, text: int) -> np.ndarray:
        return self.unit[self.edges[text] : self.edges[text + 1]]


def fitted(rows: np.ndarray, size: np.ndarray, y: np.ndarray, cost: np.ndarray, marks: np.ndarray, mark_size: np.ndarray) -> Machine:
    value, vector = np.linalg.eigh(kernel_matrix(marks, mark_size, marks, mark_size).astype(np.float64))
    use = value > 1e-6 * value.max()
    root = vector[:, use] / np.sqrt(value[use])
    w = support_vectors(kernel_matrix(rows, size, marks, mark_size) @ root.astype(np.float32), y, cost)
    return Machine(marks, mark_size, root @ w[:-1], float(w[-1]))


def spread_out(sample: Sample, units: np.ndarray, n: int, near: float = 0.85) -> np.ndarray:
    """The first n units that are not close to one chosen before."""
    some = units[: 4 * n]
    k = kernel_matrix(sample.rows[some], sample.size[some], sample.rows[some], sample.size[some])
    chosen: list[int] = []
    for i in range(len(some)):
        if len(chosen) < n and (not chosen or k[i, chosen].max() < near):
            chosen.append(i)
    return some[chosen]


def disguised(rows: np.ndarray, size: np.ndarray, rng: np.random.Generator, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Copies with a letter, a sign or a blank put in at a place of each."""
    fit = (size >= 6) & (size < LONGEST)
    rows, size = np.repeat(rows[fit], n, axis=0), np.repeat(size[fit], n)
    at = 2 + (rng.random(len(rows)) * (size - 3)).astype(np.int64)
    put = np.where(rng.random(len(rows)) < 0.7, rng.integers(3, 29, len(rows)), rng.integers(1, 3, len(rows)))
    out = np.where(np.arange(LONGEST) < at[:, None], rows, np.roll(rows, 1, axis=1))
    out[np.arange(len(out)), at] = put
    return out.astype(np.uint8), size + 1


#: Evidence from which the first machine takes a stretch (log-likelihood ratio of its counts); what an error costs.
SURE, COST = 20.0, 20.0


def evidence(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Log-likelihood ratio of stretches in a of n_a toxic and b of n_b other texts; negative if they are rarer in toxic ones."""
    rate = (a + b) / (n_a + n_b)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(x > 0, x * np.log(x / (n * r)), 0) for x, n, r in ((a, n_a, rate), (b, n_b, rate), (n_a - a, n_a, 1 - rate), (n_b - b, n_b, 1 - rate))]
    return np.where(a * n_b > b * n_a, 2, -2) * sum(terms)


def train(texts: list[bytes], toxic: list[int], seed: int = 7) -> Machine | None:
    """A machine from labelled texts; None without both labels.

    The map from margins to scores is fitted on every fifth text of either label, with a machine that has not seen them, where
    that leaves enough; the machine itself is then fitted on all.
    """
    only = one_of_copies([sorted(set(t.lower().split())) for t in texts], toxic)
    texts, y = [texts[i] for i in only], np.array([toxic[i] for i in only], np.int64)
    aside = np.zeros(len(y), bool)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        aside[own[4::5]] = len(own) >= 100
    machine, best = learned(texts, y, seed)
    if machine is None:
        return None
    if aside.any() and (y[aside] != y[aside][0]).any():
        blind, _ = learned([t for t, out in zip(texts, aside, strict=True) if not out], y[~aside], seed)
        best, y = blind.margins([t for t, out in zip(texts, aside, strict=True) if out]), y[aside]
    machine.slope, machine.shift = calibrated(best, y)
    return machine


def learned(texts: list[bytes], y: np.ndarray, seed: int, rounds: int = 3, sides: int = 350, against: int = 4000, each: int = 3) -> tuple[Machine | None, np.ndarray]:
    """(machine, margins of the texts)."""
    rng = np.random.default_rng(seed)
    if not (0 < y.sum() < len(y)):
        return None, y
    x = Sample(texts, y)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    gain = evidence(x.pos, x.neg, n_pos, n_neg)
    plus = np.flatnonzero((gain >= SURE) & (x.pos * n_neg >= 8 * x.neg * n_pos))
    if not len(plus):  # few examples: what toxic texts have most over others
        plus = np.flatnonzero((gain > 0) & (x.neg == 0))
        plus = plus[np.argsort(-gain[plus], kind="stable")][:40]
    if not len(plus):
        return None, y
    plus = plus[np.argsort(-gain[plus], kind="stable")][: 8 * sides]
    times = x.pos[plus].astype(float)
    others = np.flatnonzero(x.neg > 0)
    drawn = rng.choice(others, min(against, len(others)), replace=False) if len(others) else others
    hard = others[np.argsort(-x.neg[others], kind="stable")][:1000]
    hard = hard[~np.isin(hard, plus)]
    machine = None
    for _ in range(rounds):
        minus = np.unique(np.concatenate([hard, drawn]))
        minus = minus[~np.isin(minus, plus)]
        bent, bent_size = disguised(x.rows[plus], x.size[plus], rng)
        marks = unique(np.concatenate([spread_out(x, plus, sides), spread_out(x, hard, sides // 2), drawn[: sides // 2]]))
        rows, size = np.concatenate([x.rows[plus], bent, x.rows[minus]]), np.concatenate([x.size[plus], bent_size, x.size[minus]])
        ours = len(plus) + len(bent)
        sign = np.where(np.arange(len(rows)) < ours, 1.0, -1.0)
        worth = np.concatenate([np.minimum(times, 30), np.full(len(bent), 2.0), np.ones(len(minus))])
        worth[:ours] *= 0.5 * worth[ours:].sum() / worth[:ours].sum()
        machine = fitted(rows, size, sign, COST * worth / worth.mean(), x.rows[marks], x.size[marks])
        f = machine.values(x.rows, x.size)
        tops = [own[np.argsort(-f[own], kind="stable")[:each]] for own in (x.of(i) for i in range(len(y)))]
        clean = [t for t, label in zip(tops, y, strict=True) if not label and len(t)]
        usual = np.median([f[t[0]] for t in clean]) if clean else -np.inf
        met, times = np.unique(np.concatenate([t[f[t] > max(usual, -1)] for t, label in zip(tops, y, strict=True) if label]), return_counts=True)
        rare = x.pos[met] * n_neg > 4 * x.neg[met] * n_pos
        if rare.any():
            order = np.lexsort((-f[met[rare]], -times[rare]))
            plus, times = met[rare][order][: 8 * sides], times[rare][order][: 8 * sides].astype(float)
        worst = np.unique(np.concatenate(clean)) if clean else hard[:0]
        worst = worst[~np.isin(worst, plus)]
        hard = unique(np.concatenate([worst[np.argsort(-f[worst], kind="stable")][:2500], hard]))[:5000]
    top, above = [f[t[0]] if len(t) else LOWEST for t in tops], [(f[x.of(i)] > 0).sum() for i in range(len(y))]
    return machine, np.stack([top, np.log1p(above)], axis=1)


def unique(units: np.ndarray) -> np.ndarray:
    """Distinct numbers, in the order in which they come first."""
    _, first = np.unique(units, return_index=True)
    return units[np.sort(first)]


def one_of_copies(docs: list[list[bytes]], labels: list[int], tries: int = 4) -> list[int]:
    """Places of the texts that stay when near-copies of one label are counted once, as copies are no more evidence.

    Two texts are taken for copies if their lowest words agree under both hashes of one of the tries, and they share
    half of the words of both.
    """
    keep, sets = list(range(len(docs))), [set(d) for d in docs]
    hashes = [np.array([zlib.crc32(u) for u in d] or [0], np.uint64) for d in docs]
    odd = np.random.default_rng(1).integers(1 << 62, (1 << 63) - 1, (tries, 2), dtype=np.uint64) | np.uint64(1)
    for t in range(tries):
        seen: dict[tuple, int] = {}
        for i in keep:
            low = [int((hashes[i] * m >> np.uint64(20)).min()) for m in odd[t]]
            other = seen.setdefault((labels[i], *low), i)
            if 2 * len(sets[i] & sets[other]) < len(sets[i] | sets[other]):
                seen[labels[i], *low, i] = i
        keep = sorted(seen.values())
    return keep


def calibrated(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Slopes and shift of the probability of label 1, with targets drawn in by the number of examples."""
    x = np.hstack([margins, np.ones((len(margins), 1))])
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, keep = np.array([1.0, 0.0, 0.0]), np.diag([0.1, 0.1, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x.T * w) @ x + keep, x.T @ (goal - p) - keep @ a)
        a = a + step
        if np.abs(step).max() < 1e-8:
            break
    return a[:2], float(a[2])


def held_out(ident: Column) -> Column:
    """Rows that are never learned from; a null id is none of them, and is not learned from either."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = 1500, negatives: int = 3000, max_chars: int = 20_000) -> Machine | None:
    """Fit on labelled rows of docs that are not held out. The sample's bounds are the parameters."""
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = given.where("toxic = 1").orderBy(*order).limit(positives).union(given.where("toxic = 0").orderBy(*order).limit(negatives))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= max_chars)
    rows = sorted(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").distinct().limit(2 * (positives + negatives)).collect())
    return train([r["text"].encode() for r in rows], [int(r["toxic"]) for r in rows])


def toxicity_scores(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score double."""
    ident = free_name(docs, "_doc")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        score = scorer(shared.value)
        return lambda texts: {"score": score(texts)}

    return per_text(docs.withColumn(ident, docs[id_col]), text_col, [ident], "score double", make).withColumnRenamed(ident, "doc_id")


def scorer(machine: Machine | None):
    if machine is None:
        return lambda texts: np.zeros(len(texts))
    return lambda texts: machine.scores(machine.margins(texts))


def drop_toxic(docs: DataFrame, machine: Machine | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at the threshold or above; columns as they were, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("boolean")
    def rejected(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from sparloom.llm.common import slices, text_bytes

        score = scorer(shared.value)
        for column in columns:
            flags = [score(text_bytes(p.column(0))) >= threshold for p in slices(pa.RecordBatch.from_arrays([column], names=["t"]), 0)]
            yield pa.array(np.concatenate(flags) if flags else [], pa.bool_())

    return docs.where(~rejected(F.col(text_col).cast("string")))
