"""Hard negatives: for an anchor and each of its nearest rows of the same label, the highest-scoring rows of other labels within a share of that score.

Scores are integer inner products of quantised vectors, floor(scale * x). Rows and anchors meet in tiles: anchors are dealt to blocks and rows to
slices by hash, and each pair of a block and a slice is one task's work, of bounded size (``TILE_BYTES`` a side). Within a tile most
pairs are never multiplied out. All vectors are rotated by the orthogonal axes of their second moment (uncentred PCA, summed over all rows), so that the
leading components carry most of a product. After each of ``STEPS`` components the rest of a product is bounded by the norms of what is left
of both vectors, plus slack for rounding; pairs whose bound shows that they can't be among the wanted go. Integer products of the others decide.
The rotation steers only how early pairs go, so results don't depend on it.

Rows with a null label or vector, or with a component that is null or not finite, take no part. Vectors of different lengths never meet. Rows
that are equal in id, label and vector count once. A row is another than the anchor if its id differs; a null id is an id of its own kind, comes last
among equal scores and differs from all others. An empty table gives an empty result, as does one without anchors. Scores beyond 64 bits are an error.
Columns other than the named ones are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise, settle, trimmed

#: Leading components after which bounds are drawn; the last step has all.
STEPS = (8, 24)
#: Bytes of the vectors of a tile's rows, and of its anchors, about.
TILE_BYTES = 16 << 20
#: Rows of a slice at least, where the table is small and slices only spread the work.
FEW_ROWS = 1024
#: Anchors whose leading products are taken at once.
AT_ONCE = 32

KEY = ["a_id", "a_label", "a_h"]


def participants(vectors: DataFrame, anchor: Column, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label (as text), q (quantised, as doubles), anchor; each different row once."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(
        F.col(id_col).alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.transform(vector_col, lambda x: x.cast("double")).alias("q"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where(F.col("label").isNotNull() & F.col("q").isNotNull() & ~F.exists("q", odd))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("q")
            values = np.floor(scale * q.flatten().to_numpy(zero_copy_only=False)) + 0.0  # no minus zero
            lengths = np.concatenate([[0], np.cumsum(pc.list_value_length(q).to_numpy(zero_copy_only=False))])
            at = b.schema.get_field_index("q")
            yield b.set_column(at, "q", pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values)))

    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInArrow(quantise, f"id {kind}, label string, q array<double>, anchor boolean").withColumn("h", F.xxhash64("q"))
    return done.groupBy("id", "label", "h", "q").agg(F.max("anchor").alias("anchor"))


def rotations(rows: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """For each vector length: the axes of the second moment, strongest first, and the slack of a product of unit vectors for rounding."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, q in by_length(b.column("q")):
                unit = q / max(1.0, float(np.abs(q).max(initial=0)))  # only directions count; keeps huge values in range
                sums[d] = sums.get(d, 0) + unit.T @ unit
        for d, m in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["d", "i", "j", "v"])

    cells = rows.select("q").mapInArrow(trimmed(partial), "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    got = cells.toPandas()  # d * (d + 1) / 2 numbers for each length d
    out = {0: (np.zeros((0, 0)), 0.0)}
    for d, part in got.groupby("d"):
        m = np.zeros((d, d))
        m[part.i, part.j] = m[part.j, part.i] = part.v
        axes = np.linalg.eigh(m)[1][:, ::-1]
        off = float(np.linalg.norm(axes.T @ axes - np.eye(d)))
        out[int(d)] = (np.ascontiguousarray(axes), 8 * d**1.5 * np.finfo(float).eps + 2 * off)
    return out


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Matrices of the vectors of each length, in no order that matters."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        part = column.filter(pa.array(lengths == d))
        yield int(d), part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), int(d))


class Side:
    """The vectors of one length of a tile's side: exact, rotated, and the norms of what is left of them after each step."""

    def __init__(self, table: pa.Table, d: int, axes: np.ndarray):
        self.table, self.d = table, d
        q = table.column("q").combine_chunks()
        self.q = q.flatten().to_numpy(zero_copy_only=False).reshape(len(q), d)
        self.y = self.q @ axes
        self.steps = [*[k for k in STEPS if k < d], d]
        left = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        self.left = np.sqrt(np.stack([left[:, k] if k < d else np.zeros(len(q)) for k in self.steps], axis=1))
        self.norm = np.sqrt((self.q * self.q).sum(axis=1))
        self.most = float(np.abs(self.q).max(initial=0))
        self.label = np.array(table.column("label").to_pylist(), object)


def exact(a: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products."""
    if most * max(1, len(a)) < 2.0**62:
        return rows.astype(np.int64) @ a.astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in rows]
    if any(not -(2**63) <= x < 2**63 for x in whole):
        raise ValueError("a score doesn't fit 64 bits")
    return np.array(whole, np.int64)


Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def narrow(p: np.ndarray, at: np.ndarray, a: Side, i: int, rows: Side, slack: float, keep: Keep) -> np.ndarray:
    """Of the rows `at`, whose products of leading components are p, those that no bound tells apart from the wanted."""
    for step, k in enumerate(rows.steps):
        if step:
            before = rows.steps[step - 1]
            p = p + rows.y[at, before:k] @ a.y[i, before:k]
        rest = a.left[i, step] * rows.left[at, step] + slack * a.norm[i] * rows.norm[at]
        stay = keep(p - rest, p + rest)
        p, at = p[stay], at[stay]
    return at


def kth(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -math.inf


def highest(k: int) -> Keep:
    return lambda low, up: ~(up < kth(low, k))


def within(bounds: list[tuple[int, int]], k: int) -> Keep:
    """Rows that can be among the k highest within any of the bounds."""

    def keep(low: np.ndarray, up: np.ndarray) -> np.ndarray:
        out = np.zeros(len(low), bool)
        for least, most in bounds:
            sure = low[(low >= least) & (up <= most)]
            out |= ~(up < least) & ~(low > most) & ~(up < kth(sure, k))
        return out

    return keep


def sides(anchors: pa.Table, rows: pa.Table, turn: dict[int, tuple[np.ndarray, float]]) -> Iterator[tuple[Side, Side, float]]:
    """Anchors and rows of each length that both have, rows in the order of their ids (null last)."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end"))
    a_len, r_len = (pc.list_value_length(t.column("q")).to_numpy() for t in (anchors, rows))
    for d in np.intersect1d(a_len, r_len):
        axes, slack = turn[int(d)]
        yield Side(anchors.filter(pa.array(a_len == d)), int(d), axes), Side(rows.filter(pa.array(r_len == d)), int(d), axes), slack


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; of equal ones the first."""
    return np.argsort(-scores, kind="stable")[:k]


def tile_positives(anchors: pa.Table, rows: pa.Table, turn: dict, k: int, schema: pa.Schema) -> pa.Table:
    """The k highest rows of a tile for each anchor, of its label."""
    who, what, value, made = [], [], [], []
    for a, r, slack in sides(anchors, rows, turn):
        ids, own = r.table.column("id"), a.table.column("id").to_pylist()
        every = np.array(ids.to_pylist(), object)
        first = r.steps[0]
        for label in set(a.label) & set(r.label):
            of, at = np.flatnonzero(a.label == label), np.flatnonzero(r.label == label)
            for block in np.array_split(of, math.ceil(len(of) / AT_ONCE)):
                lead = a.y[block, :first] @ r.y[at, :first].T
                for i, p in zip(block, lead, strict=True):
                    other = np.ones(len(at), bool) if own[i] is None else every[at] != own[i]
                    left = narrow(p[other], at[other], a, i, r, slack, highest(k))
                    scores = exact(a.q[i], r.q[left], a.most * r.most)
                    best = top(scores, k)
                    who += [i] * len(best)
                    what += left[best].tolist()
                    value += scores[best].tolist()
        made.append(pa.table([*[a.table.column(c).take(pa.array(who, pa.int64())) for c in ("id", "label", "h")], ids.take(pa.array(what, pa.int64())), pa.array(value, pa.int64())], schema=schema))
        who, what, value = [], [], []
    return pa.concat_tables(made) if made else schema.empty_table()


def tile_negatives(anchors: pa.Table, rows: pa.Table, turn: dict, k: int, low: int, high: int, schema: pa.Schema) -> pa.Table:
    """The k highest rows of a tile for each positive of each anchor: of another label, with low * positive <= 100 * score <= high * positive."""
    made = []
    for a, r, slack in sides(anchors, rows, turn):
        who, which, what, value = [], [], [], []
        scores_of = a.table.column("scores").to_pylist()
        first = r.steps[0]
        labels, code = np.unique(r.label.astype(str), return_inverse=True)
        place = {x: i for i, x in enumerate(labels)}
        for block in np.array_split(np.arange(len(a.label)), math.ceil(len(a.label) / AT_ONCE)):
            lead = a.y[block, :first] @ r.y[:, :first].T
            for i, p in zip(block, lead, strict=True):
                bounds = [(-(-low * s // 100), high * s // 100) for s in scores_of[i]]
                at = np.flatnonzero(code != place.get(a.label[i], -1))
                left = narrow(p[at], at, a, i, r, slack, within(bounds, k))
                scores = exact(a.q[i], r.q[left], a.most * r.most)
                for place_of, (least, most) in enumerate(bounds):
                    fit = np.flatnonzero((scores >= least) & (scores <= most))
                    best = fit[top(scores[fit], k)]
                    who += [i] * len(best)
                    which += [place_of] * len(best)
                    what += left[best].tolist()
                    value += scores[best].tolist()
        made.append(pa.table([*[a.table.column(c).take(pa.array(who, pa.int64())) for c in ("id", "label", "h")], pa.array(which, pa.int32()), r.table.column("id").take(pa.array(what, pa.int64())), pa.array(value, pa.int64())], schema=schema))
    return pa.concat_tables(made) if made else schema.empty_table()


def tiles(anchors: DataFrame, rows: DataFrame, m: int, s: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work over each pair of one of m blocks of anchors and one of s slices of rows."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id", "h", F.lit(n)), F.lit(n)).cast("int")
    parts = min(m * s, 1 << 15)
    a = anchors.withColumn("i", dealt(m)).withColumn("j", numbers(s)).repartition(parts, "i", "j")
    r = rows.withColumn("j", dealt(s)).withColumn("i", numbers(m)).select("i", "j", "id", "label", "q").repartition(parts, "i", "j")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    return a.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor says which rows are anchors; an anchor's positives are its
    `positives` highest-scoring other rows of the same label, and their negatives the `negatives` highest rows of other labels whose score
    is between low and high percent of the positive's. Higher scores come first, then smaller ids."""
    spark = vectors.sparkSession
    lean(spark)
    found = participants(vectors, anchor, scale, id_col, vector_col, label_col)
    kind = found.schema["id"].dataType.simpleString()
    arrow = pa.schema([("a_id", _arrow(found, "id")), ("a_label", pa.string()), ("a_h", pa.int64())])
    other, score = pa.field("id", _arrow(found, "id")), pa.field("score", pa.int64())
    key = f"a_id {kind}, a_label string, a_h long"
    up = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))

    def build() -> DataFrame:
        rows = materialise(found, "vectors")
        n, many, longest = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("q"))).first()
        turn = rotations(rows)
        fit = max(1, TILE_BYTES // (8 * max(1, longest or 0)))
        m = max(1, math.ceil(many / fit))
        s = max(1, math.ceil(n / fit), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / FEW_ROWS)))
        anchors = rows.where("anchor").select(*[F.col(c).alias(c) for c in ("id", "label", "h", "q")])  # new columns, as both sides of a tile come from rows
        first = tiles(anchors, rows, m, s, lambda a, r: tile_positives(a, r, turn, positives, pa.schema([*arrow, other, score])), f"{key}, id {kind}, score long")
        best = first.withColumn("p", F.row_number().over(up(*KEY)) - 1).where(F.col("p") < positives)
        chosen = materialise(best, "positives")
        packed = chosen.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "score"))), lambda x: x["score"]).alias("scores"))  # at most `positives`
        with_scores = anchors.join(packed, [anchors[c].eqNullSafe(packed[k]) for c, k in zip(("id", "label", "h"), KEY, strict=True)]).select("id", "label", "h", "q", "scores")
        which = pa.field("p", pa.int32())
        second = tiles(with_scores, rows, m, s, lambda a, r: tile_negatives(a, r, turn, negatives, low, high, pa.schema([*arrow, which, other, score])), f"{key}, p int, id {kind}, score long")
        ranked = second.withColumn("rank", F.row_number().over(up(*KEY, "p"))).where(F.col("rank") <= negatives)
        x, y = ranked.alias("x"), chosen.alias("y")
        met = x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*KEY, "p")])
        return met.select(
            F.col("x.a_id").alias("anchor_id"),
            F.col("y.id").alias("positive_id"),
            F.col("x.rank").cast("int").alias("rank"),
            F.col("x.id").alias("negative_id"),
            F.col("y.score").alias("positive_score"),
            F.col("x.score").alias("negative_score"),
        )

    return settle(spark, "negatives", build)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
