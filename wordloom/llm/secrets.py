"""Secret scans: exact base patterns, then a character convolutional network over every other candidate and its context.

Candidates are runs of 8 or more of ``[A-Za-z0-9+/_.=-]``, and what base spans leave of such a run where that is as long. The network reads
a candidate and its context as classes of bytes, in overlapping windows up to ``AFTER`` bytes behind its end: an embedding, one convolution,
the maximum over the candidate's part and over the rest of the window, and one output. A candidate's score is that of its best window. It is
written in numpy and trained on the driver on labelled findings: invented ones from a fixed generator (keys, tokens and hashes against
identifiers, numbers, addresses, paths and dates), and those of a bounded sample of the documents (``SAMPLE_DOCS``, ``SAMPLE_KIND``), where
a candidate inside a base span is a secret and any other is not. Half of the secrets lose the word that gives them away, so that the shape
counts too. Platt scaling calibrates the score on held-out findings; the threshold is the highest that still recalls ``RECALL`` of the
held-out secrets, and a standard error more, however low that is: a weak fit costs precision, not secrets. A third part, which nothing is trained or chosen on, measures
recall and precision, by the origin of the findings; candidates that look like secrets but have no base span stay in it and count as false
alarms. These figures are logged and kept in ``Network.measured``.

Offsets are code points, the end exclusive. Null and empty texts have no spans; very long texts are scanned whole; an empty table gives an empty result. Repeated rows are scanned each. Columns other than the
named ones are not carried.
"""

from __future__ import annotations

import hashlib
import itertools
import logging
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, lean, materialise, texts, trimmed

log = logging.getLogger(__name__)

#: Documents whose candidates train the network, about; of these about so many secrets, others of letters and other others; and invented findings.
SAMPLE_DOCS, SAMPLE_KIND, INVENTED = 20_000, 3_000, 5_000
#: One in so many findings only measures.
TESTED = 5
#: Findings of a document that the sample draws from, of either label.
PER_DOC = 50
#: Text of the sampled documents, about.
SAMPLE_BYTES = 256 << 20
RECALL = 0.95
BEFORE, LENGTH = 24, 72
#: A window with so many bytes of a longer secret is one.
GLUED = 16
#: Bytes from one window to the next of a candidate, and the context behind its end that its last window has.
STEP, AFTER = 24, 12
EMBED, WIDTH, FILTERS = 8, 5, 24
BLOCK_BYTES = 8 << 20
#: Bytes of text convolved at once.
CHUNK = 1 << 13
#: What single precision may take from a score.
EPSILON = 1e-5

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
#: Bytes of a candidate at least.
SHORTEST = 8
RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
HINTS = (b"passw", b"secret", b"token", b"api")


def base_spans(text: bytes, runs: list[re.Match]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes: leftmost non-overlapping matches of each kind; runs are the text's candidate runs."""
    out = []
    low = text.lower()
    if any(x in low for x in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in runs:  # 24 hex digits lie within a run
        if run.end() - run.start() >= 24:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= 24]
    return sorted(out)


def window(text: bytes, start: int, end: int) -> tuple[bytes, int]:
    """LENGTH bytes around a candidate, padded with zeros, and how many of them after BEFORE are the candidate's."""
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE, b"\0")
    right = text[start : start + LENGTH - BEFORE].ljust(LENGTH - BEFORE, b"\0")
    return left + right, min(end - start, LENGTH - BEFORE)


def starts(start: int, end: int) -> tuple[int, ...]:
    """Starts of the windows over a candidate: any STEP bytes of it lie within one, and the last ends AFTER bytes behind it."""
    last = end + AFTER - (LENGTH - BEFORE)
    return (start,) if last <= start else (*range(start, last, STEP), last)


def windows(text: bytes, start: int, end: int) -> list[tuple[bytes, int]]:
    return [window(text, s, end) for s in starts(start, end)]


def scan(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans, and candidates: runs, or their parts outside base spans."""
    runs = list(RUN.finditer(text))
    base = base_spans(text, runs)
    if not base:
        return base, [m.span() for m in runs]
    rest, k = [], 0
    cover: list[list[int]] = []
    for a, _, b in base:
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    for m in runs:
        at, end = m.span()
        while k < len(cover) and cover[k][1] <= at:
            k += 1
        for a, b in itertools.takewhile(lambda x: x[0] < end, itertools.islice(cover, k, None)):  # noqa: B023
            if a - at >= SHORTEST:
                rest.append((at, a))
            at = max(at, b)
        if end - at >= SHORTEST:
            rest.append((at, end))
    return base, rest


@dataclass(frozen=True)
class Measure:
    secrets: int
    found: int
    false_alarms: int

    @property
    def recall(self) -> float:
        return self.found / self.secrets if self.secrets else math.nan

    @property
    def precision(self) -> float:
        said = self.found + self.false_alarms
        return self.found / said if said else math.nan


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: Of the held-out candidates that the threshold was chosen on; NaN without a secret among them.
    recall: float = math.nan
    precision: float = math.nan
    #: Of candidates that nothing was chosen on, by their origin.
    measured: dict[str, Measure] = field(default_factory=dict)

    def _layers(self, x: np.ndarray, size: np.ndarray) -> tuple:
        e = self.embed[x]  # rows, LENGTH, EMBED
        steps = LENGTH - WIDTH + 1
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), steps, WIDTH * EMBED)
        h = np.maximum(cols @ self.conv + self.conv_bias, 0)
        at = np.arange(steps)
        inside = (at[None, :] >= BEFORE - WIDTH + 1) & (at[None, :] < BEFORE + size[:, None])
        best = [np.where(m[:, :, None], h, -1).argmax(axis=1) for m in (inside, ~inside)]
        pooled = np.concatenate([np.take_along_axis(h, b[:, None, :], 1)[:, 0] for b in best], axis=1)
        return cols, best, pooled, pooled @ self.out + self.bias

    def raw(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        parts = [self._layers(x[i : i + 512], size[i : i + 512])[3] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.empty(0)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))

    def probability(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(x, size))


def arrays(found: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(w for w, _ in found), np.uint8).reshape(-1, LENGTH)
    return np.where(x < 128, x, 127).astype(np.int64), np.array([n for _, n in found], np.int64)


def train(found: list[tuple[bytes, int, int]], epochs: int = 8, seed: int = 5, of: list[int] | None = None) -> Network:
    """found: (window, candidate's length in it, 1 for a secret); of: the number of each window's candidate, without it each is its own. Adam
    on minibatches; every fifth candidate is held out, and its best window counts."""
    rng = np.random.default_rng(seed)
    x, size = arrays([(w, n) for w, n, _ in found])
    y = np.array([v for _, _, v in found], float)
    _, group = np.unique(np.arange(len(y)) if of is None else of, return_inverse=True)
    out = np.zeros(group.max(initial=-1) + 1, bool)
    out[rng.permutation(len(out))[::5]] = True
    held, fit = np.flatnonzero(out[group]), np.flatnonzero(~out[group])
    held = held[np.argsort(group[held], kind="stable")]
    net = Network(rng.normal(0, 0.3, (128, EMBED)), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, 2 * FILTERS), 0.0)
    names = ("embed", "conv", "conv_bias", "out")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            cols, best, pooled, z = net._layers(x[part], size[part])
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            d_pool = dz[:, None] * net.out[None, :]
            dh = np.zeros((len(part), cols.shape[1], FILTERS))
            row, col = np.arange(len(part))[:, None], np.arange(FILTERS)[None, :]
            for k, b in enumerate(best):
                dh[row, b, col] += d_pool[:, k * FILTERS : (k + 1) * FILTERS] * (pooled[:, k * FILTERS : (k + 1) * FILTERS] > 0)
            d_cols = (dh @ net.conv.T).reshape(len(part), -1, WIDTH, EMBED)
            de = np.zeros((len(part), LENGTH, EMBED))
            for k in range(WIDTH):
                de[:, k : k + d_cols.shape[1]] += d_cols[:, :, k]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, x[part], de)
            grads = {"embed": d_embed, "conv": np.tensordot(cols, dh, ((0, 1), (0, 1))), "conv_bias": dh.sum((0, 1)), "out": pooled.T @ dz}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                setattr(net, k, getattr(net, k) - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
            net.bias -= 0.01 * float(dz.sum())
    first = np.flatnonzero(np.diff(group[held], prepend=-1))
    raw, truth = (np.maximum.reduceat(v, first) for v in (net.raw(x[held], size[held]), y[held]))
    aim = np.where(truth > 0, 1 - 1 / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a, b = a - 0.05 * float(((p - aim) * raw).mean()), b - 0.05 * float((p - aim).mean())
    net.slope, net.shift = max(a, 1e-3), b
    scores = np.sort(net.calibrated(raw)[truth > 0])
    if n := len(scores):
        missed = (1 - RECALL) * n - math.sqrt(n * RECALL * (1 - RECALL))  # a standard error, so that other secrets are recalled too
        net.threshold = float(scores[max(0, math.floor(missed))])
        said = net.calibrated(raw) >= net.threshold
        net.recall, net.precision = float(said[truth > 0].mean()), float((truth > 0)[said].mean())
    return net


def invented(n: int = INVENTED, seed: int = 11) -> list[tuple[bytes, int, int]]:
    """The windows of invented_candidates."""
    return [f for one in invented_candidates(n, seed) for f in one]


def invented_candidates(n: int = INVENTED, seed: int = 11) -> list[list[tuple[bytes, int, int]]]:
    """Labelled findings from a fixed generator, a list of windows each: half secrets, half look-alikes. Some of either stand behind a name or
    path in one run; of such a run the windows that hold GLUED bytes of the secret are secret."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    word = lambda: pick(lower, rng.randint(2, 9))
    mixed = lambda k: "".join(rng.sample(pick(lower, k - 4) + pick(upper, 2) + pick(digits, 2), k))
    secrets = [
        lambda: pick("0123456789abcdef", rng.choice((16, 18, 20, 32, 40, 64))),
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: pick(lower + upper + digits + "+/", rng.choice((24, 32, 40, 44))) + rng.choice(("", "=", "==")),
        lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-", "sk-")) + pick(lower + upper + digits, rng.randint(20, 40)),
        lambda: ".".join(pick(lower + upper + digits + "_-", rng.randint(18, 40)) for _ in range(3)),
        lambda: mixed(rng.randint(8, 15)),
        lambda: pick(lower + upper, rng.randint(16, 44)),
    ]
    others = [
        lambda: pick(digits, rng.randint(8, 19)),
        lambda: (word() + word() + pick(lower, 4))[: rng.randint(8, 16)] + rng.choice(("", "", ".", "...", "=")),
        lambda: (word() + word() + pick(lower, 4))[: rng.randint(8, 16)].title() + rng.choice(("", "", ".")),
        lambda: "-".join(word() + pick(lower, 3) for _ in range(rng.randint(2, 3))),
        lambda: word() + "".join(pick(lower, rng.randint(4, 8)).title() for _ in range(rng.randint(1, 3))),
        lambda: "_".join(word().upper() + "ED" for _ in range(rng.randint(2, 4))),
        lambda: f"mail{rng.randint(1, 99)}.{word()}.example.{rng.choice(('com', 'org', 'net'))}",
        lambda: f"{word()}-{word()}-{rng.randint(1, 999)}-{word()}{word()}",
        lambda: f"/{word()}/{word()}/{word()}{rng.randint(0, 99)}.{rng.choice(('html', 'txt', 'png'))}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}",
        lambda: f"{word()}{word()}{word()}{rng.randint(0, 9)}{word()}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-{word()}{word()}.{rng.randint(1, 9)}",
        lambda: "=" * rng.randint(8, 20) + str(rng.randint(0, 99)) + "-" * rng.randint(8, 20),
        lambda: "_".join(word() for _ in range(4)) + str(rng.randint(0, 99)),
    ]
    heads = [
        lambda: "_".join(word().upper() for _ in range(rng.randint(2, 9))) + "=",
        lambda: "".join(f"/{word()}" for _ in range(rng.randint(2, 12))) + "/",
        lambda: ".".join(word() for _ in range(rng.randint(2, 9))) + rng.choice(("=", ".", "/")),
    ]
    keys = ("key", "password", "secret", "token", "auth", "credential")
    out = []
    for i in range(n):
        value = rng.choice(others if i % 2 else secrets)()
        before = " ".join(word() for _ in range(4)) + " "
        if not i % 2 and rng.random() < 0.5:
            before += rng.choice(keys) + rng.choice(("=", ": ", ' = "', " "))
        head = rng.choice(heads)() if rng.random() < 0.25 else ""
        text = (before + head + value + " " + " ".join(word() for _ in range(4))).encode()
        start, secret, end = len(before), len(before) + len(head), len(before) + len(head) + len(value)
        held = [min(end, s + LENGTH - BEFORE) - max(secret, s) for s in starts(start, end)]
        out.append([(w, k, int(not i % 2 and h >= min(GLUED, len(value)))) for (w, k), h in zip(windows(text, start, end), held, strict=True)])
    return out


def sample_findings(docs: DataFrame) -> list[tuple[list[tuple[bytes, int]], int]]:
    """Windows and label of candidates of SAMPLE_DOCS documents at most, taken by the hash of the row; half of the secrets lose their context."""
    chosen = bounded_sample(docs.where("text is not null").select("doc_id", "text", F.lit(0).alias("all")), "all", "text", "secrets", SAMPLE_DOCS, SAMPLE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            out = []
            for text in texts(block.column("text")):
                base, rest = scan(text)
                out += [(windows(text, a, b), 0 if text[a:b].isalpha() else 2) for a, b in rest[:: len(rest) // PER_DOC + 1]]
                for k, (a, kind, b) in enumerate(base[:PER_DOC]):
                    if kind == 0:
                        a = ASSIGN.match(text, a).start(2)
                    out.append((windows(text, a, b) if k % 2 else windows(bytes(BEFORE) + text[a : b + LENGTH], BEFORE, BEFORE + b - a), 1))
            cols = [[b"".join(w for w, _ in ws) for ws, _ in out], [[n for _, n in ws] for ws, _ in out], [v for _, v in out]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.binary(), pa.list_(pa.int32()), pa.int32()), strict=True)], ["windows", "sizes", "kind"])

    found = materialise(chosen.select("text").mapInArrow(run, "windows binary, sizes array<int>, kind int").distinct(), "findings")
    have = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    part = F.create_map(*[F.lit(x) for k, n in (have or {0: 1}).items() for x in (k, min(1_000_000, SAMPLE_KIND * 1_000_000 // n))])
    rows = found.where(F.pmod(F.xxhash64("windows"), F.lit(1_000_000)) < part[F.col("kind")]).toArrow().to_pylist()
    return [([(w[k * LENGTH : (k + 1) * LENGTH], n) for k, n in enumerate(sizes)], int(v == 1)) for w, sizes, v in sorted((r["windows"], r["sizes"], r["kind"]) for r in rows)]


def learn(sampled: list[tuple[list[tuple[bytes, int]], int]]) -> Network:
    """Train on invented and sampled findings. What only counts as no secret because no base pattern finds it, but looks like one to a
    network that knows the invented findings, is left out of the second training, but not of the measured part."""

    def fit(candidates: list[list[tuple[bytes, int, int]]]) -> Network:
        return train([f for one in candidates for f in one], of=[k for k, one in enumerate(candidates) for _ in one])

    known = [([(w, n) for w, n, _ in one], [v for *_, v in one]) for one in invented_candidates()]
    mine = [[(w, n, v) for (w, n), v in zip(ws, vs, strict=True)] for ws, vs in known if not only_tested(ws)]
    net = fit(mine)
    rest = [(ws, v) for ws, v in sampled if not only_tested(ws)]
    if rest:
        p = best(net, [ws for ws, _ in rest])
        net = fit(mine + [[(w, n, v) for w, n in ws] for (ws, v), q in zip(rest, p.tolist(), strict=True) if v or q < 0.5])
    net.measured = {"generator": measure(net, [(ws, max(vs)) for ws, vs in known if only_tested(ws)]), "documents": measure(net, [x for x in sampled if only_tested(x[0])])}
    return net


def only_tested(candidate: list[tuple[bytes, int]]) -> bool:
    """By the candidate's own bytes, so that repeats are on one side."""
    return zlib.crc32(candidate[0][0]) % TESTED == 0


def measure(net: Network, candidates: list[tuple[list[tuple[bytes, int]], int]]) -> Measure:
    truth = np.array([v for _, v in candidates], bool)
    said = best(net, [ws for ws, _ in candidates]) >= net.threshold - EPSILON
    return Measure(int(truth.sum()), int((said & truth).sum()), int((said & ~truth).sum()))


def best(net: Network, found: list[list[tuple[bytes, int]]]) -> np.ndarray:
    """Probability of each candidate: that of its best window."""
    if not found:
        return np.empty(0)
    first = np.cumsum([0, *map(len, found[:-1])])
    return np.maximum.reduceat(net.probability(*arrays([w for ws in found for w in ws])), first)


def probabilities(net: Network, rows: list[bytes], found: list[list[tuple[int, int]]]) -> np.ndarray:
    """Probability of each candidate (start, end) of each text, as best() gives it for its windows. Every position is convolved once, by tables of
    byte pairs, and a window's maxima come from maxima over 1, 2, 4, ... 32 positions, so a candidate costs a few lookups."""
    at, size, first = [], [], []
    offset, parts = BEFORE, [bytes(BEFORE)]
    for text, rest in zip(rows, found, strict=True):
        for a, b in rest:
            first.append(len(at))
            for p in starts(a, b):
                at.append(offset + p)
                size.append(min(b - p, LENGTH - BEFORE))
        if rest:
            parts += [text, bytes(LENGTH)]
            offset += len(text) + LENGTH
    if not at:
        return np.empty(0)
    x = np.minimum(np.frombuffer(b"".join(parts), np.uint8), 127).astype(np.int32)
    at, size, raw = np.array(at), np.array(size), np.empty(len(at))
    one = [(net.embed @ net.conv[k * EMBED : (k + 1) * EMBED]).astype(np.float32) for k in range(WIDTH)]
    pairs = [(one[k][:, None] + one[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2)]
    last = one[4] + net.conv_bias.astype(np.float32)
    steps, edges = LENGTH - WIDTH + 1, np.searchsorted(at, np.arange(0, len(x) + CHUNK, CHUNK))
    for i, j in itertools.pairwise(edges.tolist()):
        if i == j:
            continue
        low = at[i] - BEFORE
        z = x[low : at[j - 1] + LENGTH - BEFORE]
        level = [np.maximum(pairs[0][z[:-4] * 128 + z[1:-3]] + pairs[1][z[2:-2] * 128 + z[3:-1]] + last[z[4:]], 0)]
        for k in range(5):
            h = level[-1].copy()
            h[: -(1 << k)] = np.maximum(h[: -(1 << k)], h[1 << k :])
            level.append(h)
        level = np.stack(level)

        def most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            k = np.frexp(b - a)[1] - 1  # noqa: B023
            return np.maximum(level[k, a], level[k, b - (1 << k)])  # noqa: B023

        s, n = at[i:j] - BEFORE - low, size[i:j]
        left, right = s + BEFORE - WIDTH + 1, s + np.minimum(BEFORE + n, steps)
        around = most(s, left)
        more = np.flatnonzero(right < s + steps)
        around[more] = np.maximum(around[more], most(right[more], s[more] + steps))
        raw[i:j] = np.concatenate([most(left, right), around], axis=1) @ net.out + net.bias
    return net.calibrated(np.maximum.reduceat(raw, first))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and added) and n_model of every row."""
    lean(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    net = learn(sample_findings(source))
    for origin, m in net.measured.items():
        log.info("secret scan: threshold %.4f; %s: recall %.4f of %d, precision %.4f", net.threshold, origin, m.recall, m.secrets, m.precision)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK_BYTES):
            rows = texts(block.column("text"))
            found = [scan(x) for x in rows]
            good = iter((probabilities(net, rows, [rest for _, rest in found]) >= net.threshold - EPSILON).tolist())
            out = []
            for text, (base, rest) in zip(rows, found, strict=True):
                added = [(a, 3, b) for a, b in rest if next(good)]
                if base or added:
                    place: dict[int, int] = {}
                    seen = at = 0
                    for p in sorted({q for a, _, b in (*base, *added) for q in (a, b)}):
                        seen += len(text[at:p].decode())
                        at = p
                        place[p] = seen
                    base, added = ([(place[a], k, place[b]) for a, k, b in x] for x in (base, added))
                kinds = [k for _, k, _ in base]
                out.append((*[kinds.count(k) for k in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted([*base, *added])), len(added)))
            types = (*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64())
            yield from pa.table([block.column("doc_id"), *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"]).to_batches()

    return source.mapInArrow(trimmed(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
