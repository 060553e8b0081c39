"""Toxicity by a subsequence string-kernel support vector machine (operator 8).

A word is read with a mark at each end. The kernel of two words sums, over all subsequences of
ORDER characters that span at most SPAN characters, the product of their weights DECAY ** span;
it is normalised to 1 for equal words. So gapped and inserted-character spellings stay close to
the word. Nystroem landmarks make the kernel a finite feature map; a squared-hinge linear
machine is trained on it. As the machine is linear in the landmarks, and they in their
subsequences, the trained function is one table of subsequence weights: a word's value is its
table sum over the word's norm, plus the bias, the same number that the landmark kernels give.

Texts are labelled, words are not. Words whose share among toxic texts is far beyond chance
(likelihood ratio) are taken as toxic, with spellings of them that have one letter inserted;
near copies of a text teach once; all words of clean texts are clean, weighted by their frequency. The first machine's highest
clean words weigh more in the second and are landmarks there; words of toxic texts that it
takes as toxic and clean texts do not have join the toxic ones.

A token's value is the highest of its readings: the token without its marks, the pieces between
marks, and overlapping windows of LONGEST letters where a reading is longer. A text's evidence is
the sum of its distinct tokens' values above 0; a logistic curve over its logarithm and that of
the number of distinct tokens, fitted on the sample, turns it into a score.

Learning takes a bounded sample of labelled rows: SAMPLE_TOXIC and SAMPLE_CLEAN texts with the
smallest hash of their id, one text an id, none longer than SAMPLE_LONGEST, SAMPLE_CHARS characters
of each label. Everything else sees whole texts of all rows.

Defined results: null and empty texts, and texts without letters, score like a text without a
toxic word. Without both labels in the sample, or without a word that sets them apart, all texts
score the sample's share of toxic rows (a half if the sample is empty, predicted 0). Repeated rows
each give their row; equal texts score equally. A very long text costs time and memory in
proportion to its length. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import keep_where, map_texts

ORDER = 4
SPAN = 6
DECAY = 0.8
#: Codes of characters: 0 unused, 1 the mark at a word's ends, then OWN letters of their own, then shared ones.
LETTERS = 48
OWN = 40
LONGEST = 24
SAMPLE_TOXIC = 1200
SAMPLE_CLEAN = 2500
SAMPLE_LONGEST = 1_000_000
SAMPLE_CHARS = 16_000_000
LANDMARKS = 360
CACHE_WORDS = 150_000
KEYS = LETTERS**ORDER
OFFSETS = [x for x in combinations(range(1, SPAN), ORDER - 1)]
WEIGHTS = DECAY ** (np.arange(SPAN) + 1.0)
#: Runs of four or more single characters set apart by white space are read as one word.
APART = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){3,}")
LETTER_RUN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """Lower-case tokens; single characters set apart are also joined."""
    if not text:
        return set()
    text = text.lower()
    out = set(text.split())
    for m in APART.finditer(text):
        out.add("".join(m[0].split()))
    return out


def readings(token: str) -> list[str]:
    """The words that a token may hide."""
    if len(token) <= LONGEST and token.isalpha():
        return [token]
    pieces = LETTER_RUN.findall(token)
    if len(pieces) > 1:
        pieces.append("".join(pieces))
    out: list[str] = []
    for p in pieces:
        out += [p] if len(p) <= LONGEST else [p[k : k + LONGEST] for k in range(0, len(p) - LONGEST // 2, LONGEST // 2)]
    return out


def alphabet(words: Counter[str]) -> str:
    """The OWN most frequent letters."""
    n: Counter[str] = Counter()
    for w, k in words.items():
        for x in w:
            n[x] += k
    return "".join(sorted(n, key=lambda x: (-n[x], x))[:OWN])


class Kernel:
    """The subsequence kernel over one alphabet."""

    def __init__(self, letters: str) -> None:
        self.letters = letters
        self.codes = (2 + OWN + (np.arange(0x110000) * 2654435761 >> 7) % (LETTERS - 2 - OWN)).astype(np.uint8)
        self.codes[0] = 1
        for k, x in enumerate(letters):
            self.codes[ord(x)] = 2 + k

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, code) of every character, the marks at the ends included."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        joined = "\0" + "\0\0".join(words) + "\0" if words else ""
        c = self.codes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        return np.repeat(np.arange(len(words)), lengths), c

    def subsequences(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each pattern of gaps: (word, subsequence) of its occurrences, and the reach."""
        row, c = self.coded(words)
        n = len(c)
        for at in OFFSETS:
            reach = at[-1]
            if n > reach:
                same = np.flatnonzero(row[: n - reach] == row[reach:])
                key = c[same]
                for k in at:
                    key = key * LETTERS + c[same + k]
                yield row[same], key, reach

    def bundled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, subsequence, weight): occurrences of a word added up, its norm made 1."""
        packed = [(r * KEYS + k) * 8 + reach for r, k, reach in self.subsequences(words)]
        both = np.sort(np.concatenate(packed)) if packed else np.zeros(0, np.int64)
        if not len(both):
            return both, both, np.zeros(0)
        weight, both = WEIGHTS[both & 7], both >> 3
        start = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        total, both = np.add.reduceat(weight, start), both[start]
        row = both // KEYS
        norm = np.sqrt(np.bincount(row, total**2, len(words)))
        return row, both % KEYS, total / norm[row]

    def between(self, words: list[str], others: list[str], turn: np.ndarray | None = None, kind: type = np.float32) -> np.ndarray:
        """Normalised kernels, words by others (times ``turn``)."""
        row, key, weight = self.bundled(others)
        known, at = np.unique(key, return_inverse=True)
        place = np.full(KEYS, -1, np.int32)
        place[known] = np.arange(len(known))
        table = np.zeros((len(known), len(others)), np.float32)
        table[at, row] = weight
        if turn is not None:
            table = table @ turn.astype(np.float32)
        out = np.zeros((len(words), table.shape[1]), kind)
        for k in range(0, len(words), 400):
            r, s, w = self.bundled(words[k : k + 400])
            p = place[s]
            r, w, p = r[p >= 0], w[p >= 0].astype(np.float32), p[p >= 0]
            if len(r):
                start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                out[k + r[start]] = np.add.reduceat(table[p] * w[:, None], start)
        return out

    def spread(self, words: list[str], most: int, near: float) -> list[str]:
        """The first words, leaving out those near one already taken."""
        words = words[: most * 12]
        if not words:
            return []
        k = np.hstack([self.between(words, words[j : j + 100]) for j in range(0, len(words), 100)])
        taken: list[int] = []
        for i in range(len(words)):
            if len(taken) < most and k[i, i] > 0 and (not taken or k[i, taken].max() < near):
                taken.append(i)
        return [words[i] for i in taken]


def fit_machine(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-4, rounds: int = 20, block: int = 4096) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the active rows, block by block; rows may be held in half precision."""
    d = x.shape[1] + 1
    w, keep = np.zeros(d), np.full(d, ridge)
    keep[-1] = 1e-6
    margin = np.zeros(len(x))
    loss = lambda m, w: share @ np.maximum(0, 1 - m) ** 2 + w @ (keep * w)
    for _ in range(rounds):
        active = np.flatnonzero(margin < 1)
        square, pull = np.diag(keep), np.zeros(d)
        for k in range(0, len(active), block):
            at = active[k : k + block]
            a = np.hstack([x[at].astype(np.float32), np.ones((len(at), 1), np.float32)])
            s = share[at]
            square += (a * s[:, None].astype(np.float32)).T @ a
            pull += a.T @ (s * y[at])
        step = np.linalg.solve(square, pull) - w
        along = y * (np.concatenate([x[k : k + block].astype(np.float32) @ step[:-1].astype(np.float32) for k in range(0, len(x), block)]) + step[-1])
        now, scale = loss(margin, w), 1.0
        while loss(margin + scale * along, w + scale * step) > now and scale > 1e-6:
            scale /= 2
        margin, w = margin + scale * along, w + scale * step
        if now - loss(margin, w) < 1e-6 * now:
            break
    return w[:-1], float(w[-1])


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the columns and of 1, by damped Newton steps with Platt's softened targets."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    loss = lambda w: np.sum(np.logaddexp(0, z @ w) - target * (z @ w)) + 0.5e-2 * w @ w
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - target) + 1e-2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step, scale = np.linalg.solve(h, g), 1.0
        while loss(w - scale * step) > loss(w) and scale > 1e-4:
            scale /= 2
        w = w - scale * step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Machine:
    """keys, weights: the table of subsequences; curve: weights of a text's evidence, its tokens and 1."""

    letters: str
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    curve: np.ndarray
    landmarks: list[str] = field(default_factory=list)
    beta: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.kernel = Kernel(self.letters)
        self.table = np.zeros(KEYS, np.float32)
        self.table[self.keys] = self.weights
        # A word's norm is at least that of its occurrences taken apart, which hangs on its length alone.
        apart = [sum(WEIGHTS[at[-1]] ** 2 * max(0, n + 2 - at[-1]) for at in OFFSETS) for n in range(LONGEST + 1)]
        self.least = np.sqrt(apart)

    def plain(self) -> tuple:
        return self.letters, self.keys, self.weights, self.bias, self.curve

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word of at most LONGEST letters, 0 at least."""
        out = np.zeros(len(words), np.float64)
        for k in range(0, len(words), 5_000):
            part = words[k : k + 5_000]
            total = self.bias * self.least[np.fromiter(map(len, part), np.int64, len(part))]
            for row, key, reach in self.kernel.subsequences(part):
                total += np.bincount(row, self.table[key], len(part)) * WEIGHTS[reach]
            up = np.flatnonzero(total > -1e-6) if self.bias < 0 else np.arange(len(part))
            r, s, w = self.kernel.bundled([part[i] for i in up])
            out[k + up] = np.bincount(r, self.table[s] * w, len(up)) + self.bias
        return np.maximum(out, 0)

    def token_values(self, found: list[str]) -> list[float]:
        """The highest value of each token's readings."""
        read = [readings(t) for t in found]
        words = list({w for r in read for w in r})
        value = dict(zip(words, self.values(words).tolist(), strict=True)) if len(self.keys) else {}
        return [max((value.get(w, 0.0) for w in r), default=0.0) for r in read]

    def score(self, evidence: np.ndarray, count: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(columns(evidence, count) @ self.curve[:-1] + self.curve[-1], -40, 40)))

    def text_scores(self, texts: list[str | None]) -> np.ndarray:
        bags = [tokens(t) for t in texts]
        return self.score([sum(sorted(self.token_values(list(b)))) for b in bags], [len(b) for b in bags])


def columns(evidence: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack([np.log(np.asarray(evidence) + 0.05), np.log(np.asarray(count) + 5.0)], 1)


def flat(toxic: int, clean: int) -> Machine:
    """A machine that gives every text the sample's share."""
    share = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 0.4999
    return Machine("", np.zeros(0, np.int64), np.zeros(0, np.float32), -1.0, np.array([0.0, 0.0, np.log(share / (1 - share))]))


def inserted(words: list[str], letters: str, each: int) -> list[str]:
    """Spellings with one letter put inside, ``each`` at every place, by a fixed sequence of letters."""
    rng = np.random.default_rng(20240611)
    pool = letters[:30]
    return sorted({w[:k] + pool[j] + w[k:] for w in words if len(w) > 2 for k in range(1, len(w)) for j in rng.integers(0, len(pool), each)})


def unlike(bags: list[set[str]], least: int = 8) -> list[set[str]]:
    """The bags without those that share half of their ``least`` smallest token hashes with one before them.

    A group of copies teaches once: else its chance words would look like the label's.
    """
    out: list[set[str]] = []
    holders: dict[int, list[int]] = {}
    for b in bags:
        low = nsmallest(least, (zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in b))
        met = Counter(i for h in low for i in holders.get(h, ()))
        if low and not (met and max(met.values()) * 2 >= len(low)):
            for h in low:
                holders.setdefault(h, []).append(len(out))
            out.append(b)
    return out


def train(toxic: list[str], clean: list[str]) -> Machine:
    """A machine from labelled texts."""
    known: dict[str, str] = {}  # a token of many texts is held once
    bags, others = (unlike([{known.setdefault(w, w) for w in tokens(t)} for t in texts]) for texts in (toxic, clean))
    known.clear()
    if not bags or not others:
        return flat(len(toxic), len(clean))
    t = Counter(w for b in bags for w in {r for x in b for r in readings(x)})
    c = Counter(w for b in others for w in {r for x in b for r in readings(x)})
    nt, nc = sum(t.values()), sum(c.values())

    def beyond_chance(w: str) -> float:
        a, b = t[w], c[w]
        e = (a + b) * nt / (nt + nc)
        return a * np.log(a / e) + (b * np.log(b / (a + b - e)) if b else 0.0) if a > e else 0.0

    evidence = {w: beyond_chance(w) for w in t}
    rare = lambda w: c[w] <= 0.05 * t[w] * nc / nt
    marked = [w for w in sorted(t, key=lambda w: (-evidence[w], w)) if evidence[w] > np.log(len(t)) + 2 and rare(w)]
    if not marked:
        return flat(len(toxic), len(clean))
    kernel = Kernel(alphabet(t + c))
    good = sorted(c)
    positives, hard = set(marked), set()
    landmarks = kernel.spread(marked, LANDMARKS * 4 // 9, 0.6)
    seeds = list(landmarks)
    for last in (False, True):
        square = kernel.between(landmarks, landmarks).astype(np.float64)
        size, turn = np.linalg.eigh((square + square.T) / 2)
        half = turn[:, size > 1e-3] / np.sqrt(size[size > 1e-3])
        put = [w for w in inserted(sorted(marked[:200]), kernel.letters, 2) if w not in c and w not in positives]
        bad = sorted(positives)
        rest = [w for w in good if w not in positives]
        words = [*bad, *put, *rest]
        weights = np.r_[np.log1p([t[w] for w in bad]), np.ones(len(put)), np.sqrt([c[w] for w in rest]) * np.array([10.0 if w in hard else 1.0 for w in rest])]
        a, b = len(bad), len(bad) + len(put)
        for part, mass in ((slice(0, a), 0.5), (slice(a, b), 0.5), (slice(b, None), 1.0)):
            weights[part] *= mass / max(weights[part].sum(), 1e-9)
        y = np.r_[np.ones(b), -np.ones(len(rest))]
        w, bias = fit_machine(kernel.between(words, landmarks, half, np.float16), y, weights)
        beta = half @ w
        row, key, weight = kernel.bundled(landmarks)
        keys, at = np.unique(key, return_inverse=True)
        table = np.bincount(at, weight * beta[row], len(keys)).astype(np.float32)
        machine = Machine(kernel.letters, keys, table, bias, np.zeros(3), landmarks, beta)
        if not last:
            value = np.zeros(len(rest))
            for k in range(0, len(rest), 5_000):
                r, s, u = kernel.bundled(rest[k : k + 5_000])
                value[k : k + 5_000] = np.bincount(r, machine.table[s] * u, len(rest[k : k + 5_000])) + bias
            order = [i for i in np.lexsort((np.arange(len(rest)), -value)) if value[i] > -0.6 and not rare(rest[i])]
            hard = {rest[i] for i in order}
            only = sorted(w for w in t if w not in c and w not in positives)
            positives |= {w for w, v in zip(only, machine.values(only), strict=True) if v > 0.25}
            puts = inserted(seeds, kernel.letters, 1)
            landmarks = [*seeds, *kernel.spread(puts, LANDMARKS * 2 // 9, 0.75), *kernel.spread([rest[i] for i in order], LANDMARKS * 3 // 9, 0.7)]
            landmarks = list(dict.fromkeys(landmarks))
    every = sorted(set().union(*bags, *others))
    value = dict(zip(every, machine.token_values(every), strict=True))
    both = [*bags, *others]
    x = columns([sum(value[w] for w in sorted(b)) for b in both], [len(b) for b in both])
    machine.curve = fit_curve(x, np.r_[np.ones(len(bags)), np.zeros(len(others))])
    return machine if machine.curve[0] > 0 else flat(len(toxic), len(clean))


def sample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[list[str], list[str]]:
    """Texts of the toxic and clean labelled rows with the smallest hash of their id, within the bounds above."""
    place = F.xxhash64(F.col("_k").cast("string"))
    chosen = []
    for value, most in ((1, toxic), (0, clean)):
        of = labels.where((F.col(label_col) == value) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_k")).distinct()
        chosen.append(of.orderBy(place, "_k").limit(most).withColumn("_y", F.lit(value)))
    texts = df.where(F.length(text_col) <= SAMPLE_LONGEST).select(F.col(id_col).alias("_k"), F.col(text_col).alias("_text"))
    picked = texts.join(F.broadcast(chosen[0].union(chosen[1])), "_k").groupBy("_y", "_k").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN rows reach the window.
    so_far = F.sum(F.length("_text")).over(Window.partitionBy("_y").orderBy(place, "_k"))
    rows = picked.withColumn("_n", so_far).where(F.col("_n") <= SAMPLE_CHARS).select("_k", "_y", "_text").toArrow()
    found = sorted(zip(rows.column("_k").to_pylist(), rows.column("_text").to_pylist(), rows.column("_y").to_pylist(), strict=True))
    return [t for _, t, y in found if y == 1], [t for _, t, y in found if y == 0]


def scorer(shared):
    """A function from texts to scores, with a memory of tokens, of a broadcast machine."""
    m = Machine(*shared.value)
    seen: dict[str, float] = {}

    def scores(texts: list[str | None]) -> np.ndarray:
        bags = [tokens(t) for t in texts]
        missing = set().union(*bags).difference(seen)
        if missing:
            if len(seen) + len(missing) > CACHE_WORDS:
                seen.clear()
                missing = set().union(*bags)
            words = list(missing)
            seen.update(zip(words, m.token_values(words), strict=True))
        return m.score([sum(sorted(map(seen.__getitem__, b))) for b in bags], [len(b) for b in bags])

    return scores


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(machine.plain())
    made: list = []

    def run(ids, texts):
        if not made:
            made.append(scorer(shared))
        s = made[0](texts).tolist()
        return {"doc_id": ids, "score": s, "predicted": [int(x >= 0.5) for x in s]}

    return map_texts(df, id_col, text_col, f"doc_id {df.schema[id_col].dataType.simpleString()}, score double, predicted int", run)


def keep_clean(df: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(machine.plain())

    def load():
        scores = scorer(shared)
        return lambda texts: (scores(texts) < 0.5).tolist()

    return keep_where(df, text_col, load)
