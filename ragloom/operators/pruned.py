"""Exact top-k that skips parts of the corpus.

Index (:func:`build_index`): vectors are dealt to the nearest of a few hundred
directions, which come from spherical k-means on a bounded sample, and written
as one folder per direction, sorted by their angle to it. Every vector of the
corpus is in the index; the sample only decides how well it is cut.

Search (:func:`search`) is exact. Angles between unit vectors obey the triangle
inequality: a vector at angle ``a`` from a direction and a question at angle
``t`` from it are at least ``|t - a|`` apart, so the rows of a folder with angles
``[low, high]`` score at most ``cos(max(0, t - high, low - t))``. Two passes:

1. every question is scored against its nearest directions' folders, which
   gives it k real scores and so a floor for its k-th best;
2. the other folders are read only if some question's bound reaches its floor.
   Within a folder every run of rows carries its own angles, so that runs are
   scored for those questions only that can gain from them.

Vectors without a direction (null, zero, NaN) have no score and rank last; they
lie in a folder of their own, which is read for questions with fewer than k
scored hits. A question without a direction has no scores at all: it is held
against everything.

Folders of one direction are split over files by angle, so that no direction
makes a task that grows with the corpus. Questions are broadcast in blocks
within the bounds of :mod:`.topk`; each block prunes by itself.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage, ship_code, work_path
from . import topk as K

SAMPLE_ROWS = 20_000      # vectors that decide the directions
MAX_DIRECTIONS = 1024
ROUNDS = 12               # of k-means
PROBES = 2                # folders of the first pass
ANGLE_SLACK = 1e-6        # rounding of angles
SCORE_SLACK = 1e-9        # rounding of scores
RUN_ROWS = 512            # rows that share a bound
#: Folder of the vectors without a direction.
NO_DIRECTION = -1


@dataclass
class ClusterIndex:
    """A written index: its path, the directions, and per folder ``(rows, low, high)``."""
    path: str
    directions: np.ndarray
    folders: dict[int, tuple[int, float, float]]
    id_col: str
    vec_col: str
    schema: T.StructType
    report: list[dict] = field(default_factory=list)

    def rows(self) -> int:
        return sum(n for n, _, _ in self.folders.values())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path + "/rows")


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which rows have a direction."""
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    known = np.isfinite(norm) & (norm > 0)
    out = np.zeros_like(m)
    out[known] = m[known] / norm[known, None]
    return out, known


def directions(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means: ``n`` unit directions from a sample of vectors."""
    unit, known = _units(sample)
    unit = unit[known]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    rng = np.random.default_rng(seed)
    n = min(n, len(unit))
    centre = unit[rng.choice(len(unit), n, replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, unit)
        new, alive = _units(sums)
        centre = np.where(alive[:, None], new, centre)
    return centre


def build_index(corpus: DataFrame, *, id_col: str = "id", vec_col: str = "embedding", path: str | None = None,
                n_directions: int | None = None, sample_rows: int = SAMPLE_ROWS) -> ClusterIndex:
    """Write the index of ``corpus(id, vector, ...)`` and return it; other columns are stored with the rows."""
    spark = corpus.sparkSession
    ship_code(spark)
    path = path or work_path(spark, "cluster-index")
    n, dim = corpus.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    count = n_directions or min(MAX_DIRECTIONS, max(1, math.isqrt(n)))
    sample = corpus.where(F.col(vec_col).isNotNull()).select(vec_col, F.xxhash64(id_col, vec_col).alias("_h")) \
        .orderBy("_h").limit(sample_rows).select(vec_col).toArrow()
    centre = directions(K._matrix(sample.column(0), max(dim or 0, 1))[0], count)
    sent = spark.sparkContext.broadcast(centre)
    schema = T.StructType([*corpus.schema.fields, T.StructField("_folder", T.IntegerType()),
                           T.StructField("_angle", T.DoubleType())])
    names = corpus.columns

    def deal(batches):
        for batch in batches:
            unit, known = _units(K._matrix(batch.column(names.index(vec_col)), sent.value.shape[1])[0])
            folder, angle = np.full(len(unit), NO_DIRECTION, np.int32), np.zeros(len(unit))
            if len(sent.value):
                near = unit @ sent.value.T
                best = np.argmax(near, axis=1)
                angle = np.where(known, np.arccos(np.clip(near[np.arange(len(unit)), best], -1, 1)), 0.0)
                folder = np.where(known, best, NO_DIRECTION).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folder), pa.array(angle)],
                                             names=[*names, "_folder", "_angle"])

    dealt = cut_lineage(corpus.mapInArrow(deal, schema))
    dealt.repartitionByRange("_folder", "_angle", F.xxhash64(id_col, vec_col)).sortWithinPartitions("_folder", "_angle") \
        .write.partitionBy("_folder").parquet(path + "/rows")
    folders = dealt.groupBy("_folder").agg(F.count(F.lit(1)).alias("n"), F.min("_angle").alias("low"),
                                           F.max("_angle").alias("high"))
    stats = {r["_folder"]: (r["n"], r["low"], r["high"]) for r in folders.collect()}   # at most MAX_DIRECTIONS + 1 rows
    spark.createDataFrame([(i, c.tolist(), *stats.get(i, (0, 0.0, 0.0)), schema.json()) for i, c in
                           [*enumerate(centre), (NO_DIRECTION, np.zeros(0))]],
                          "folder int, direction array<double>, n long, low double, high double, schema string") \
        .write.parquet(path + "/directions")
    return ClusterIndex(path, centre, stats, id_col, vec_col, schema)


def load_index(spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding") -> ClusterIndex:
    """An index written earlier."""
    ship_code(spark)
    rows = sorted(spark.read.parquet(path + "/directions").collect(), key=lambda r: r["folder"])
    centre = np.array([r["direction"] for r in rows if r["folder"] >= 0])
    return ClusterIndex(path, centre.reshape(len(centre), -1), {r["folder"]: (r["n"], r["low"], r["high"]) for r in rows if r["n"]},
                        id_col, vec_col, T.StructType.fromJson(json.loads(rows[0]["schema"])))


def highest_score(angle: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bound on the score of rows at angles ``[low, high]`` from a direction, for questions at ``angle`` from it."""
    apart = np.maximum(0.0, np.maximum(angle - high, low - angle) - ANGLE_SLACK)
    return np.cos(np.minimum(apart, np.pi))


def _pass(index: ClusterIndex, rows: DataFrame, block: pa.Table, qid_col: str, qvec_col: str, exclude_col: str | None,
          payload: list[str], schema: T.StructType, k: int, probe: np.ndarray, floor: np.ndarray | None) -> DataFrame:
    """Candidates of one pass: the probed folders of each question (``floor`` None), or the others within its bound."""
    id_col, vec_col = index.id_col, index.vec_col
    qm, dim = K._matrix(block.column(qvec_col), index.directions.shape[1] or None)
    excl = block.column(exclude_col).to_pylist() if exclude_col else None
    sent = rows.sparkSession.sparkContext.broadcast(
        (qm, block.column(qid_col).combine_chunks(), excl, index.directions, probe, floor))
    arrow_schema = to_arrow_schema(schema)
    keep = [id_col, vec_col] + [p for p in payload if p not in (id_col, vec_col)]
    out_cols = [id_col] + [p for p in payload if p != id_col]

    def run(batches):
        qm_, qids, excl_, centre, probe_, floor_ = sent.value
        unit, known = _units(qm_)
        held: dict[bytes, list] = {}

        def flush(key):
            wanted = np.frombuffer(key, np.int64)
            blocks = held.pop(key)
            ex = None if excl_ is None else [excl_[i] for i in wanted]
            res = K._local_topk(blocks, id_col, vec_col, out_cols, qm_[wanted], qids.take(pa.array(wanted)), ex, dim, k)
            return [] if res is None else K._emit(res[0], res[1], qid_col, id_col, payload, arrow_schema).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            folder = batch.column("_folder").to_numpy()
            angle = batch.column("_angle").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], folder[1:] != folder[:-1]]))
            for start, end in zip(starts, [*starts[1:], len(folder)], strict=True):
                at = int(folder[start])
                of_probe = (probe_ == at).any(axis=1)
                if floor_ is None:
                    runs = [(start, end, of_probe)]
                elif at == NO_DIRECTION:
                    runs = [(start, end, ~of_probe & (floor_ <= -2.0))]
                else:
                    theta = np.arccos(np.clip(unit @ centre[at], -1, 1))
                    runs = []
                    for a in range(start, end, RUN_ROWS):
                        b = min(a + RUN_ROWS, end)
                        reach = highest_score(theta, angle[a:b].min(), angle[a:b].max()) >= floor_ - SCORE_SLACK
                        runs.append((a, b, ~of_probe & (reach | ~known)))
                for a, b, wanted in runs:
                    if wanted.any():
                        key = np.flatnonzero(wanted).astype(np.int64).tobytes()
                        held.setdefault(key, []).append(table.slice(a, b - a).select(keep))
            for key in list(held):
                yield from flush(key)

    return rows.select(*keep, "_folder", "_angle").mapInArrow(run, schema)


def _needed(index: ClusterIndex, qm: np.ndarray, probe: np.ndarray, floor: np.ndarray) -> dict[int, int]:
    """Folders of the second pass with the number of questions that need each."""
    unit, known = _units(qm)
    out = {}
    for at, (_, low, high) in index.folders.items():
        others = ~(probe == at).any(axis=1)
        if at == NO_DIRECTION:
            want = others & (floor <= -2.0)
        else:
            theta = np.arccos(np.clip(unit @ index.directions[at], -1, 1))
            want = others & (~known | (highest_score(theta, low, high) >= floor - SCORE_SLACK))
        if want.any():
            out[at] = int(want.sum())
    return out


def search(index: ClusterIndex, queries: DataFrame, k: int, *, qid_col: str = "qid", qvec_col: str = "qvec",
           exclude_col: str | None = None, payload: tuple[str, ...] | list[str] = (), rank_col: str = "rk",
           probes: int = PROBES, max_rows: int = K.DEFAULT_MAX_BROADCAST_QUERIES,
           max_bytes: int = K.DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """The rows that :func:`.topk.top_k` returns, from an index.

    ``index.report`` gets one entry per block of questions: the folders read in
    each pass and the share of (question, row) pairs that were skipped.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = queries.sparkSession
    payload = list(payload)
    rows = index.table(spark)
    asked = K._dealt(queries.select(qid_col, qvec_col, *([exclude_col] if exclude_col else [])))
    blocks = K._question_blocks(asked, qvec_col, max_rows, max_bytes)
    schema = K._local_schema(rows, queries, qid_col, index.id_col, payload)
    parts = []
    for i in range(blocks):
        block = asked.where(F.pmod(F.col("__at"), F.lit(blocks).cast("long")) == i).drop("__at").toArrow()
        if block.num_rows == 0 or not index.folders:
            continue
        qm, _ = K._matrix(block.column(qvec_col), index.directions.shape[1] or None)
        unit, known = _units(qm)
        n = min(probes, len(index.directions))
        probe = np.full((len(qm), max(n, 1)), NO_DIRECTION, np.int64)
        if n:
            near = unit @ index.directions.T
            probe = np.where(known[:, None], np.argpartition(-near, n - 1, axis=1)[:, :n], -2)

        def one_pass(folders, floor, block=block, probe=probe):
            return _pass(index, rows.where(F.col("_folder").isin(sorted(folders))), block, qid_col, qvec_col, exclude_col,
                         payload, schema, k, probe, floor)

        first = {int(x) for x in np.unique(probe)} & set(index.folders)
        found = cut_lineage(K.merge_topk(one_pass(first, None), k, qid_col=qid_col, id_col=index.id_col,
                                         cols=[qid_col, index.id_col, "score", *payload]))
        # the k-th score of each question of this (bounded) block; -inf where the first pass has fewer
        kth = found.where(F.col("score").isNotNull()).groupBy(qid_col).agg(F.min("score").alias("s"), F.count("*").alias("n"))
        floors = {r[qid_col]: r["s"] for r in kth.where(F.col("n") >= k).toLocalIterator()}
        floor = np.array([floors.get(q, -np.inf) for q in block.column(qid_col).to_pylist()])
        need = _needed(index, qm, probe, floor)
        parts += [found, one_pass(set(need), floor)] if need else [found]
        scored = sum(need[f] * index.folders[f][0] for f in need) \
            + sum(int((probe == f).any(axis=1).sum()) * index.folders[f][0] for f in first)
        index.report.append({"questions": block.num_rows, "rows": index.rows(), "folders": len(index.folders),
                             "folders_first": len(first), "folders_second": len(need),
                             "share_skipped": 1 - scored / max(1, block.num_rows * index.rows())})
    if not parts:
        return K._empty_result(rows, queries, qid_col, index.id_col, payload, rank_col)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return K.merge_topk(out, k, qid_col=qid_col, id_col=index.id_col, rank_col=rank_col,
                        cols=[qid_col, rank_col, index.id_col, "score", *payload])
