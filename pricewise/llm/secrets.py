"""Secret scan: base patterns and a character convolutional network in numpy.

Base findings are the matches of three patterns (an assignment to a secret
name, an access key, a long hexadecimal run). Every other run of token
characters that holds a digit is a candidate. The network reads a candidate
with its surrounding context, character by character: embedding, one
convolution, ReLU, maximum over all positions and over the candidate's own,
and a linear output. It learns from labelled findings - the secrets of the
base findings against the other candidates - on all of them, but for a fourth
that calibrates it; its threshold is the highest that keeps ``RECALL`` of that
fourth's positives. Tasks learn from ``ROWS_PER_TASK`` windows each, and their
networks are averaged after every pass.
Candidates at or above it are added as spans of kind ``model``; base spans
always stay.

The texts are read once: findings and candidates with their context are
written to the shared folder, and training and scoring read only those.

Null and empty texts have no findings. With fewer than ``LEAST`` labelled
findings of either kind there is no network and nothing is added. Repeated
rows are scanned row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.common import read, release, small_batches, written

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of fewer never passes; a run of more is taken whole
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
DIGIT = re.compile(r"[0-9]")

#: Labelled windows that one task learns from, and the least of each kind.
ROWS_PER_TASK, LEAST = 20_000, 20
RECALL = 0.98
#: Context characters on each side, characters of the candidate, window length.
SIDE, BODY, WIDTH = 24, 48, 96


def base_findings(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, secret's start, secret's end), by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign", m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, base: list[tuple]) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is the secret of a base finding); a candidate that
    only touches a base finding is left out."""
    secret = {(s, e) for _, _, _, s, e in base}
    out = [(s, e, True) for s, e in sorted(secret)]
    if DIGIT.search(text):
        for m in TOKEN.finditer(text):
            s, e = m.start(), m.start() + len(m[0].rstrip(".=-"))
            if e - s >= 12 and DIGIT.search(text, s, e) and not any(a < e and s < b for a, b, *_ in base):
                out.append((s, e, False))
    return out


def window(text: str, start: int, end: int) -> str:
    """Left context, candidate (its first and last characters if it is long) and
    right context; ``\\x01`` fills up, so the candidate always starts at ``SIDE``."""
    body = text[start:end]
    if len(body) > BODY:
        body = body[: BODY - 16] + body[-16:]
    left = text[max(0, start - SIDE) : start].rjust(SIDE, "\x01")
    return (left + body + text[end : end + SIDE]).ljust(WIDTH, "\x01")


def encode(windows: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character indices (0-127; 127: any other) and the candidate's positions."""
    x = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), "<u4").reshape(-1, WIDTH)
    at = np.arange(WIDTH)
    return np.minimum(x, 127).astype(np.int64), (at >= SIDE) & (at < SIDE + np.minimum(lengths, BODY)[:, None])


@dataclass
class CharCNN:
    """The network's arrays; ``a`` and ``b`` calibrate its output."""
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    a: float = 1.0
    b: float = 0.0
    threshold: float = 1.0
    #: Distinct labelled windows it was fitted and calibrated on.
    windows: int = 0

    @classmethod
    def new(cls, seed: int = 7, dims: int = 8, filters: int = 24, taps: int = 5) -> CharCNN:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (128, dims)), r.normal(0, (2 / (taps * (dims + 1))) ** 0.5, (taps * (dims + 1), filters)), np.zeros(filters),
                   r.normal(0, 0.2, 2 * filters), np.zeros(1))

    def _forward(self, x: np.ndarray, own: np.ndarray):
        taps = len(self.kernel) // (self.embed.shape[1] + 1)
        e = np.concatenate([self.embed[x], own[:, :, None].astype(float)], axis=2)
        cols = np.concatenate([e[:, j : WIDTH - taps + 1 + j] for j in range(taps)], axis=2)
        h = np.maximum(cols @ self.kernel + self.bias, 0)
        inside = own[:, taps // 2 : WIDTH - taps + 1 + taps // 2]
        masked = np.where(inside[:, :, None], h, 0)
        all_at, own_at = h.argmax(axis=1), masked.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, all_at[:, None], 1)[:, 0], np.take_along_axis(masked, own_at[:, None], 1)[:, 0]], axis=1)
        return cols, h, pooled, all_at, own_at, pooled @ self.out + self.out_bias[0]

    def raw(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._forward(x[i : i + 512], own[i : i + 512])[-1] for i in range(0, len(x), 512))])

    def score(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x, own) + self.b, -30, 30)))

    def _gradients(self, x, own, y, weight) -> list[np.ndarray]:
        cols, h, pooled, all_at, own_at, z = self._forward(x, own)
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / weight.sum()
        n, f = len(x), len(self.bias)
        dp = dz[:, None] * self.out
        dh = np.zeros_like(h)
        rows, chans = np.arange(n)[:, None], np.arange(f)[None]
        np.add.at(dh, (rows, all_at, chans), dp[:, :f])
        np.add.at(dh, (rows, own_at, chans), dp[:, f:])
        dh *= h > 0
        dk = np.einsum("npc,npf->cf", cols, dh, optimize=True)
        dcols = dh @ self.kernel.T
        d, taps = self.embed.shape[1], len(self.kernel) // (self.embed.shape[1] + 1)
        de = np.zeros((n, WIDTH, d))
        for j in range(taps):
            de[:, j : WIDTH - taps + 1 + j] += dcols[:, :, j * (d + 1) : j * (d + 1) + d]
        dembed = np.stack([np.bincount(x.ravel(), de[:, :, c].ravel(), 128) for c in range(d)], axis=1)
        return [dembed, dk, dh.sum((0, 1)), pooled.T @ dz, np.array([dz.sum()])]

    def fit(self, x, own, y, weight, m, v, step: int, epoch: int, seed: int, rate: float = 0.01, batch: int = 128) -> int:
        """One pass of Adam on the weighted logistic loss, from the moments ``m`` and ``v``
        after ``step`` steps, which are updated; returns the steps so far."""
        params = [self.embed, self.kernel, self.bias, self.out, self.out_bias]
        r = np.random.default_rng(seed)
        order = [r.permutation(len(x)) for _ in range(epoch + 1)][-1]
        for i in range(0, len(x), batch):
            k = order[i : i + batch]
            step += 1
            for p, g, mm, vv in zip(params, self._gradients(x[k], own[k], y[k], weight[k]), m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        return step


_CANDIDATE = "start int, end int, secret boolean, window string"


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__base`` (findings) and ``__candidates`` (with context)."""
    small_batches(docs.sparkSession)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("secret", pa.bool_()), ("window", pa.string())]))

    def run(batches):
        for b in batches:
            base, some = [], []
            for t in b.column("__t").to_pylist():
                t = t or ""
                x = base_findings(t)
                base.append([{"kind": k, "start": s, "end": e} for s, e, k, _, _ in x])
                some.append([{"start": s, "end": e, "secret": y, "window": window(t, s, e)} for s, e, y in candidates(t, x)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(base, kinds), pa.array(some, found)], names=[*columns, "__base", "__candidates"])

    columns = docs.columns
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).alias("__t")).mapInArrow(
        run, f"{schema}__base array<struct<kind: string, start: int, end: int>>, __candidates array<struct<{_CANDIDATE.replace(' ', ': ').replace(',:', ',')}>>")


def _rounds(rows: DataFrame, net: CharCNN, ones: int, zeros: int, epochs: int, seed: int) -> None:
    """``epochs`` passes over all (part, secret, window, n, h): in each, every part goes on
    from the common state on its own rows, and the states are averaged by their rows."""
    params = [net.embed, net.kernel, net.bias, net.out, net.out_bias]
    sizes = [p.size for p in params]
    state = (np.concatenate([np.concatenate([p.ravel() for p in params]), np.zeros(2 * sum(sizes))]), 0)

    def run_epoch(epoch: int, shared):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            flat, step = shared.value
            table = table.sort_by([("secret", "descending"), ("h", "ascending"), ("window", "ascending"), ("n", "ascending")])
            x, own = encode(table["window"].to_pylist(), table["n"].to_numpy())
            y = table["secret"].to_numpy().astype(float)
            local = CharCNN.new(seed)
            groups = [[a.reshape(p.shape).copy() for a, p in zip(np.split(g, np.cumsum(sizes)[:-1]), params, strict=True)] for g in np.split(flat, 3)]
            local.embed, local.kernel, local.bias, local.out, local.out_bias = groups[0]
            step = local.fit(x, own, y, np.where(y == 1, 0.5 / ones, 0.5 / zeros), groups[1], groups[2], step, epoch, seed + key[0].as_py())
            out = np.concatenate([a.ravel() for g in groups for a in g])
            return pa.table({"part": [key[0].as_py()], "state": [out.tobytes()], "step": [step], "rows": [len(y)]},
                            schema=pa.schema([("part", pa.int32()), ("state", pa.binary()), ("step", pa.int64()), ("rows", pa.int64())]))
        return run

    for epoch in range(epochs):
        shared = rows.sparkSession.sparkContext.broadcast(state)
        parts = sorted(rows.groupBy("part").applyInArrow(run_epoch(epoch, shared), "part int, state binary, step long, rows long").collect())  # one state a part
        weight = np.array([r["rows"] for r in parts], float)
        state = (np.average([np.frombuffer(r["state"]) for r in parts], axis=0, weights=weight), max(r["step"] for r in parts))
    net.embed, net.kernel, net.bias, net.out, net.out_bias = (a.reshape(p.shape) for a, p in zip(np.split(state[0][: sum(sizes)], np.cumsum(sizes)[:-1]), params, strict=True))


def _calibrate(rows: DataFrame, net: CharCNN, recall: float = RECALL) -> None:
    """Platt's scaling on unseen candidates, then the highest threshold that keeps the
    recall; sums and ranks over all of them."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            z = shared.value.raw(*encode(b.column("window").to_pylist(), b.column("n").to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("secret"), pa.array(z, pa.float64())], names=["secret", "z"])

    scored = written(rows.select("secret", "window", "n").mapInArrow(run, "secret boolean, z double"), "secret-scores")
    ones, zeros = scored.agg(F.count_if("secret"), F.count_if(~F.col("secret"))).first()
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("z") * float(w[0]) + float(w[1]), F.lit(30.0)), F.lit(-30.0))))
        gap = p - F.when(F.col("secret"), (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2))
        d = p * (1 - p)
        r = scored.agg(F.sum(d * F.col("z") * F.col("z")), F.sum(d * F.col("z")), F.sum(d), F.sum(gap * F.col("z")), F.sum(gap)).first()
        hess = np.array([[r[0], r[1]], [r[1], r[2]]]) + 1e-3 * np.eye(2)
        change = np.linalg.solve(hess, np.array([r[3], r[4]]) + 1e-3 * (w - [1.0, 0.0]))
        w = w - change
        if np.abs(change).max() < 1e-10:
            break
    net.a, net.b = float(w[0]), float(w[1])
    found = scored.filter("secret").select((F.lit(net.a) * F.col("z") + F.lit(net.b)).alias("v"))
    net.threshold = float(1 / (1 + np.exp(-np.clip(nth_smallest(found, "v", int(np.floor((1 - recall) * ones))), -30, 30))))
    release(rows.sparkSession, scored, shuffles=False)


def nth_smallest(df: DataFrame, column: str, n: int, fetched: int = 10_000, bins: int = 256) -> float:
    """The value with ``n`` values before it in ascending order (finite, not null):
    counts by bin narrow it down, then at most ``fetched`` values are ordered."""
    while True:
        low, high, count = df.agg(F.min(column), F.max(column), F.count(column)).first()
        if low == high:
            return low
        if count <= fetched:
            return sorted(r[0] for r in df.select(column).collect())[n]
        at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
        for r in df.groupBy(at.alias("bin")).agg(F.count(column).alias("n")).orderBy("bin").collect():  # at most ``bins`` rows
            if n < r["n"]:
                df = df.filter(at == r["bin"])
                break
            n -= r["n"]


def train(found: DataFrame, seed: int = 7, epochs: int = 6) -> CharCNN | None:
    """Fit on all distinct labelled windows, ``ROWS_PER_TASK`` in a task; every fourth by
    hash calibrates instead."""
    spark = found.sparkSession
    one = found.select(F.explode("__candidates").alias("c")).select("c.secret", "c.window", (F.col("c.end") - F.col("c.start")).alias("n")).distinct()
    rows = written(one.withColumn("h", F.xxhash64("window", F.lit(seed))), "secret-windows")
    # Another hash decides if the first holds out no window of one kind.
    apart = [F.pmod(F.xxhash64("window", F.lit(seed + k)), F.lit(4)) == 0 for k in range(16)]
    sums = rows.agg(F.count_if("secret"), F.count_if(~F.col("secret")), *[F.count_if(a & (F.col("secret") == y)) for a in apart for y in (True, False)]).first()
    ones, zeros, *split = sums
    usable = [k for k in range(16) if 0 < split[2 * k] < ones and 0 < split[2 * k + 1] < zeros]
    if min(ones, zeros) < LEAST or not usable:
        release(spark, rows, shuffles=False)
        return None
    k = usable[0]
    trained = ones + zeros - split[2 * k] - split[2 * k + 1]
    parts = -(-trained // ROWS_PER_TASK)
    net = CharCNN.new(seed)
    learn = rows.filter(~apart[k]).withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    _rounds(learn, net, ones - split[2 * k], zeros - split[2 * k + 1], epochs, seed)
    _calibrate(rows.filter(apart[k]), net)
    net.windows = ones + zeros
    release(spark, rows, shuffles=False)
    return net


def with_spans(found: DataFrame, net: CharCNN | None) -> DataFrame:
    """``found`` with ``__spans``: base findings and the network's, by start, then kind."""
    shared = found.sparkSession.sparkContext.broadcast(net)
    columns = [c for c in found.columns if c not in ("__base", "__candidates")]
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        net = shared.value
        for b in batches:
            some = b.column("__candidates").to_pylist()
            new = [(i, c) for i, x in enumerate(some) for c in x or () if not c["secret"]]
            spans = [list(x or ()) for x in b.column("__base").to_pylist()]
            if net is not None and new:
                score = net.score(*encode([c["window"] for _, c in new], np.array([c["end"] - c["start"] for _, c in new])))
                for (i, c), p in zip(new, score, strict=True):
                    if p >= net.threshold:
                        spans[i].append({"kind": "model", "start": c["start"], "end": c["end"]})
            for x in spans:
                x.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), b.column("__base"), pa.array(spans, kinds)], names=[*columns, "__base", "__spans"])

    schema = "".join(f"`{c}` {found.schema[c].dataType.simpleString()}, " for c in columns)
    kind = "array<struct<kind: string, start: int, end: int>>"
    return found.mapInArrow(run, f"{schema}__base {kind}, __spans {kind}")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all rows and columns, with every span of a secret replaced."""
    found = written(scanned(docs, text), "secret-scan", docs.count(), 5000)
    spans = with_spans(found, train(found))
    columns = docs.columns

    def run(batches):
        for b in batches:
            out = []
            for t, x in zip(b.column(text).to_pylist(), b.column("__spans").to_pylist(), strict=True):
                if x:
                    parts, at = [], 0
                    for s in x:
                        if s["end"] > at:
                            if s["start"] >= at:
                                parts += [t[at : s["start"]], mark]
                            at = s["end"]
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else b.column(c) for c in columns], names=columns)

    return spans.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns))


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = written(scanned(docs.select("doc_id", "text")).drop("text"), "secret-scan", docs.count(), 5000)
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return with_spans(found, train(found)).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(_joined("__base"), 256).alias("base_sha256"), _joined("__spans").alias("spans"))
