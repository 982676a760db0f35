"""Exact top-k by cosine similarity, many questions at once.

The reference runs one ``ORDER BY embedding <=> q LIMIT k`` per question. Here
a whole question table is answered by one Spark job, and no question x corpus
pair is ever materialised as a row:

* **broadcast form** - the question block is small (checked: at most
  ``max_broadcast_queries`` rows and ``max_broadcast_bytes`` bytes). It is sent
  to every executor once as a matrix; each corpus task scores its Arrow
  batches against it with one matrix product and keeps only a running top-k
  per question. Output per task: at most ``questions x k`` rows.
* **blocked form** - any number of questions. Corpus rows are dealt to ``cb``
  blocks, questions to ``qb`` blocks, by a hash of the row number; every (corpus
  block, question block) tile is one cogroup call that does the same matrix
  product and emits its local top-k. The counts come from measured rows and
  dimensions, so that a side of a tile holds about ``tile_bytes``; a side that
  would need more than ``FEW_BLOCKS`` blocks for it gets larger ones, up to
  ``TILE_BYTES``, as every row is sent once per block of the other side.
  Payload stays behind and is fetched for the final hits.
* **scan_blocks form** - many questions against a corpus too large to
  shuffle: the broadcast form once per bounded question block, unioned; the
  corpus is re-scanned per block instead of being replicated through a shuffle.

Both forms end with the same merge: ``row_number`` over the question ordered
by score (nulls last) then id, ``<= k``. Spark plans it with a partial
``WindowGroupLimit`` before the shuffle, so at most k rows per question and
task cross the network.

Score = ``dot / sqrt(|c|^2 |q|^2)`` clamped to [-1, 1]; a zero, null or
NaN-bearing vector scores null and sorts last (SURVEY M5, M6, M9). Ties go to
the lower id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.sizing import scan_tasks

DEFAULT_MAX_BROADCAST_QUERIES = 20_000
DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
CORPUS_BLOCK_ROWS = 50_000
QUERY_BLOCK_ROWS = 32_768
TILE_BYTES = 64 << 20     # vectors of either side of a tile
FEW_BLOCKS = 16           # blocks of a side up to which a smaller tile_bytes holds
TILES_PER_CORE = 4        # question blocks are halved down to MIN_QUERY_BLOCK_ROWS to get that many tiles
MIN_QUERY_BLOCK_ROWS = 4_096
ROW_OVERHEAD = 64         # bytes of a row beside its vector
TILE_SLACK = 1.2          # hashing doesn't fill the blocks evenly
BLOCK_ROWS = BLOCK_QUESTIONS = 1024  # sides of a score matrix in a task (4 MB of floats, in the cache)
PAIR_PIECE = 1 << 22  # vector elements that are scored again in double at once
MERGE_FANIN = 200_000  # candidate rows one question may send to one merge task
LATE_PAYLOAD_ROWS = 50_000_000  # estimated candidate rows beyond which payload is fetched after the merge
MAX_FETCH_IDS = 2_000_000       # hit ids broadcast to the payload scan (else a shuffled semi join)
MAX_FETCH_BYTES = 128 << 20

_NULL_KEY = -3.0       # sort key for a null score: below every real cosine
_QI, _KEY, _SCORE = "_qi", "_key", "_score"


# --------------------------------------------------------------------------
# numpy / Arrow kernel (runs inside tasks)
# --------------------------------------------------------------------------

#: Hash of a row's payload, carried in its place where the payload is fetched late.
_ROW = "__payload_row"


def _matrix(arr, dim: int | None) -> tuple[np.ndarray, int]:
    """List<float> Arrow array -> (n, dim) float64 matrix; null/empty rows -> zeros."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    lens = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(lens.max()) if n else 0
    valid = lens > 0
    bad = valid & (lens != dim)
    if bad.any():
        raise ValueError(f"vector of dimension {int(lens[bad][0])} where {dim} is expected")
    m = np.zeros((n, dim), dtype=np.float64)
    if valid.any():
        vals = pc.list_flatten(arr).to_numpy(zero_copy_only=False).astype(np.float64)
        m[valid] = vals.reshape(-1, dim)
    return m, dim


#: Norms (squared) between these bounds keep a normalised vector exact to float32 rounding.
_NORM_RANGE = (1e-140, 1e140)
#: Sort key below every key, of pairs that are excluded or not known yet.
_NO_KEY = -4.0


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(float32 unit vectors, squared norms, rows without a score, rows out of float32's reach)``."""
    norm = np.einsum("ij,ij->i", m, m)
    known = norm > 0
    odd = known & ~((norm > _NORM_RANGE[0]) & (norm < _NORM_RANGE[1]))
    plain = known & ~odd
    with np.errstate(over="ignore"):
        unit = (m / np.sqrt(np.where(plain, norm, 1.0))[:, None]).astype(np.float32)
    if not plain.all():
        unit[~plain] = 0
    return unit, norm, np.flatnonzero(~known), np.flatnonzero(odd)


def _pair_keys(c: np.ndarray, nc: np.ndarray, qm: np.ndarray, nq: np.ndarray, ri: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """Sort keys of single pairs, in double: the cosine, ``_NULL_KEY`` where it is undefined."""
    out = np.empty(len(ri))
    step = max(1, PAIR_PIECE // max(1, c.shape[1]))
    for at in range(0, len(ri), step):
        r, q = ri[at:at + step], qi[at:at + step]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            denom = np.sqrt(nc[r] * nq[q])
            s = np.einsum("ij,ij->i", c[r], qm[q]) / denom
        s[~(denom > 0)] = np.nan
        out[at:at + step] = np.where(np.isnan(s), _NULL_KEY, np.clip(s, -1.0, 1.0))
    return out


def _first_k(qi: np.ndarray, key: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first k pairs per question by (key desc, rank asc), in order, and their place in it."""
    order = np.lexsort((rank, -key, qi))
    qs = qi[order]
    place = np.arange(len(qs)) - np.searchsorted(qs, qs, side="left")
    return order[place < k], place[place < k]


class _Questions:
    """A question block and, per question, the k best keys seen by the task so far.

    Scores of whole blocks are float32 products of unit vectors; what they leave
    within their rounding error of a question's k-th best key, or above it, is
    scored again in double. So every question keeps exactly its first k rows by
    (score, id), and few pairs are more than a float and a comparison.
    """

    def __init__(self, qm: np.ndarray, excl_vals, k: int):
        self.m, self.k = qm, k
        self.unit, self.norm, self.unknown, self.odd = _units(qm)
        self.error = np.float64((qm.shape[1] + 8) * 2.0 ** -23)
        self.best = np.full((len(qm), k), -np.inf)          # in descending order
        self.excl = self.excl_pos = None
        if excl_vals is not None:
            self.excl_pos = np.array([i for i, v in enumerate(excl_vals) if v is not None], dtype=np.int64)
            code, self.excl = pd.factorize(pd.Index([excl_vals[i] for i in self.excl_pos]), use_na_sentinel=True)
            self.excl = pd.Index(self.excl)
            self.by_code = np.argsort(code, kind="stable")
            self.first = np.searchsorted(code[self.by_code], np.arange(len(self.excl) + 1))

    def excluded(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """``(row, question)`` of every excluded pair, rows ascending (ids may repeat)."""
        if self.excl is None or not len(self.excl):
            return None
        of_row = self.excl.get_indexer(ids.to_pandas())
        rows = np.flatnonzero(of_row >= 0)
        sizes = self.first[of_row[rows] + 1] - self.first[of_row[rows]]
        at = np.repeat(self.first[of_row[rows]], sizes) + np.arange(sizes.sum()) - np.repeat(
            np.cumsum(sizes) - sizes, sizes)
        return np.repeat(rows, sizes), self.excl_pos[self.by_code[at]]

    def keep(self, qi: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
        """Take the keys of new pairs (per question in descending order, ``place`` 0, 1, ...)."""
        uq, at = np.unique(qi, return_inverse=True)
        both = np.full((len(uq), 2 * self.k), -np.inf)
        both[:, :self.k] = self.best[uq]
        both[at, self.k + place] = key
        both.sort(axis=1)
        self.best[uq] = both[:, :self.k - 1:-1]


def _table_candidates(tbl: pa.Table, id_col: str, vec_col: str, keep_cols: list[str], qs: _Questions,
                      dim: int) -> pa.Table | None:
    """The rows of one corpus table that may be among the first k of a question."""
    n, k = tbl.num_rows, qs.k
    if n == 0 or not len(qs.m):
        return None
    ids = tbl.column(id_col).combine_chunks()
    c, _ = _matrix(tbl.column(vec_col), dim)
    unit, norm, unknown, odd = _units(c)
    rank = np.empty(n, np.int64)
    rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(n)
    excl = qs.excluded(ids)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def reduced():
        qi, ri, key = (np.concatenate(x) for x in zip(*found, strict=True))
        first, _ = _first_k(qi, key, rank[ri], k)
        return qi[first], ri[first], key[first]

    for r0 in range(0, n, BLOCK_ROWS):
        r1 = min(n, r0 + BLOCK_ROWS)
        here = None
        if excl is not None:
            a, b = np.searchsorted(excl[0], (r0, r1))
            here = excl[0][a:b] - r0, excl[1][a:b]
        u, o = unknown[(unknown >= r0) & (unknown < r1)] - r0, odd[(odd >= r0) & (odd < r1)] - r0
        for q0 in range(0, len(qs.m), BLOCK_QUESTIONS):
            q1 = min(len(qs.m), q0 + BLOCK_QUESTIONS)
            s = qs.unit[q0:q1] @ unit[r0:r1].T
            s[:, o] = np.inf
            qo = qs.odd[(qs.odd >= q0) & (qs.odd < q1)] - q0
            s[qo] = np.inf
            s[:, u] = _NULL_KEY
            s[qs.unknown[(qs.unknown >= q0) & (qs.unknown < q1)] - q0] = _NULL_KEY
            if here is not None:
                mine = (here[1] >= q0) & (here[1] < q1)
                s[here[1][mine] - q0, here[0][mine]] = -np.inf
            worst = qs.best[q0:q1, -1]
            low = np.maximum(worst - qs.error, _NO_KEY)
            if r1 - r0 > k and not (len(o) or len(qo)) and not np.isfinite(worst).all():
                kth = np.partition(s, r1 - r0 - k, axis=1)[:, r1 - r0 - k].astype(np.float64)
                low = np.maximum(low, kth - 2 * qs.error)
            at = np.flatnonzero(s >= np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None])
            if not len(at):
                continue
            qi, ri = at // (r1 - r0) + q0, at % (r1 - r0) + r0
            key = _pair_keys(c, norm, qs.m, qs.norm, ri, qi)
            live = key >= qs.best[qi, -1]
            qi, ri, key = qi[live], ri[live], key[live]
            first, place = _first_k(qi, key, rank[ri], k)
            qi, ri, key = qi[first], ri[first], key[first]
            if not len(qi):
                continue
            qs.keep(qi, place, key)
            found.append((qi, ri, key))
            held += len(qi)
        if held > 4 * len(qs.m) * k:
            found = [reduced()]
            held = len(found[0][0])
    if not found:
        return None
    qi, ri, key = reduced()
    live = key >= qs.best[qi, -1]
    qi, ri, key = qi[live], ri[live], key[live]
    return tbl.select(keep_cols).take(pa.array(ri)) \
              .append_column(_QI, pa.array(qi.astype(np.int64))) \
              .append_column(_KEY, pa.array(key)) \
              .append_column(_SCORE, pa.array(np.where(key == _NULL_KEY, np.nan, key)))


def _reduce(tbl: pa.Table, id_col: str, k: int) -> pa.Table:
    """Keep the first k rows per question by (key desc, id asc)."""
    tbl = tbl.sort_by([(_QI, "ascending"), (_KEY, "descending"), (id_col, "ascending")])
    qi = tbl.column(_QI).to_numpy()
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
    return tbl.filter(pa.array(rank < k))


def _local_topk(blocks, id_col, vec_col, out_cols, qm, qids, excl_vals, dim, k):
    """Running top-k over an iterator of corpus Arrow tables (one task)."""
    qs = _Questions(qm, excl_vals, k)
    best, held = [], 0
    for tbl in blocks:
        cand = _table_candidates(tbl, id_col, vec_col, out_cols, qs, dim)
        if cand is None:
            continue
        best.append(cand)
        held += cand.num_rows
        if held > 4 * max(1, len(qm)) * k:
            merged = _reduce(pa.concat_tables(best), id_col, k)
            best, held = [merged], merged.num_rows
    if not best:
        return None
    out = _reduce(pa.concat_tables(best), id_col, k)
    return out, qids


def _emit(out: pa.Table, qids: pa.Array, qid_col: str, id_col: str, payload: list[str],
          schema: pa.Schema) -> pa.Table:
    score = out.column(_SCORE).combine_chunks()
    score = pc.if_else(pc.is_nan(score), pa.scalar(None, pa.float64()), score)
    cols = {qid_col: qids.take(out.column(_QI).combine_chunks()),
            id_col: out.column(id_col).combine_chunks(),
            "score": score}
    for p in payload:
        cols[p] = out.column(p).combine_chunks()
    arrays = [cols[f.name].cast(f.type) for f in schema]
    return pa.Table.from_arrays(arrays, schema=schema)


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _local_schema(corpus: DataFrame, queries: DataFrame, qid_col, id_col, payload) -> T.StructType:
    cf = {f.name: f for f in corpus.schema.fields}
    qf = {f.name: f for f in queries.schema.fields}
    fields = [T.StructField(qid_col, qf[qid_col].dataType, True),
              T.StructField(id_col, cf[id_col].dataType, True),
              T.StructField("score", T.DoubleType(), True)]
    fields += [T.StructField(p, cf[p].dataType, True) for p in payload]
    return T.StructType(fields)


def _broadcast_form(corpus, qtbl: pa.Table, qm: np.ndarray, dim: int, schema, qid_col, id_col,
                    vec_col, exclude_col, payload, k):
    spark = corpus.sparkSession
    qids = qtbl.column(qid_col).combine_chunks()
    excl = qtbl.column(exclude_col).to_pylist() if exclude_col else None
    bc = spark.sparkContext.broadcast((qm, qids, excl, dim))
    arrow_schema = to_arrow_schema(schema)
    keep = [id_col, vec_col] + [p for p in payload if p not in (id_col, vec_col)]
    out_cols = [id_col] + [p for p in payload if p != id_col]

    def run(batches):
        qm_, qids_, excl_, dim_ = bc.value
        res = _local_topk((pa.Table.from_batches([b]) for b in batches), id_col, vec_col,
                          out_cols, qm_, qids_, excl_, dim_, k)
        if res is not None:
            yield from _emit(res[0], res[1], qid_col, id_col, payload, arrow_schema).to_batches()

    return corpus.select(*keep).mapInArrow(run, schema)


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder with a hash ``__at`` of the row number.

    Rows are dealt by this hash and not by an id, so that repeated and null ids
    spread evenly; the checkpoint fixes the numbers, so that an attempt after a
    lost executor deals every row as before.
    """
    from ..session import cut_lineage
    return cut_lineage(df.withColumn("__at", F.monotonically_increasing_id())) \
        .withColumn("__at", F.xxhash64("__at"))


def _block_count(rows: int, dim: int, max_rows: int, max_bytes: int) -> int:
    """Blocks that keep a side of a tile within both bounds (with room for uneven hashing)."""
    per_block = max(1, min(max_rows, max_bytes // (8 * max(dim, 1) + ROW_OVERHEAD)))
    return max(1, math.ceil(TILE_SLACK * rows / per_block))


def _tiles(n_c: int, n_q: int, dim: int, corpus_block_rows: int, query_block_rows: int, tile_bytes: int,
           wanted: int) -> tuple[int, int]:
    """Corpus blocks and question blocks of the tiles."""
    def side(rows, max_rows):
        small = _block_count(rows, dim, max_rows, tile_bytes)
        least = _block_count(rows, dim, max_rows, max(tile_bytes, TILE_BYTES))
        return min(small, max(FEW_BLOCKS, least))

    cb, qb = side(n_c, corpus_block_rows), side(n_q, query_block_rows)
    while cb * qb < wanted and n_q > MIN_QUERY_BLOCK_ROWS * qb:
        qb *= 2
    return cb, qb


def _blocked_form(corpus, queries, schema, qid_col, qvec_col, id_col, vec_col, exclude_col,
                  payload, k, corpus_block_rows, query_block_rows, tile_bytes):
    keep = [id_col, vec_col] + [p for p in payload if p not in (id_col, vec_col)]
    qcols = [qid_col, qvec_col] + ([exclude_col] if exclude_col else [])
    cc, qq = _dealt(corpus.select(*keep)), _dealt(queries.select(*qcols))
    n_c, dim_c = cc.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    n_q, dim_q = qq.agg(F.count(F.lit(1)), F.max(F.size(qvec_col))).first()
    dim = max(dim_c or 0, dim_q or 0)
    cb, qb = _tiles(n_c, n_q, dim, corpus_block_rows, query_block_rows, tile_bytes,
                    TILES_PER_CORE * corpus.sparkSession.sparkContext.defaultParallelism)

    def block(n: int):
        return F.pmod(F.col("__at"), F.lit(n).cast("long"))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # one key, of one type on both sides: corpus block * question blocks + question block
    cc = cc.withColumn("__other", every(qb)).withColumn("__tile", block(cb) * F.lit(qb).cast("long") + F.col("__other"))
    qq = qq.withColumn("__other", every(cb)).withColumn("__tile", F.col("__other") * F.lit(qb).cast("long") + block(qb))
    arrow_schema = to_arrow_schema(schema)
    out_cols = [id_col] + [p for p in payload if p != id_col]

    def cell(ctbl: pa.Table, qtbl: pa.Table) -> pa.Table:
        if ctbl.num_rows == 0 or qtbl.num_rows == 0:
            return arrow_schema.empty_table()
        qm, qdim = _matrix(qtbl.column(qvec_col), dim)
        excl = qtbl.column(exclude_col).to_pylist() if exclude_col else None
        res = _local_topk([ctbl], id_col, vec_col, out_cols, qm,
                          qtbl.column(qid_col).combine_chunks(), excl, qdim, k)
        if res is None:
            return arrow_schema.empty_table()
        return _emit(res[0], res[1], qid_col, id_col, payload, arrow_schema)

    # as many partitions as tiles: a tile's rows are few bytes for its pairs, so partitions sized by bytes
    # would put more tiles into a task the more there are
    cc, qq = (x.drop("__at", "__other").repartition(cb * qb, "__tile") for x in (cc, qq))
    return cc.groupBy("__tile").cogroup(qq.groupBy("__tile")).applyInArrow(cell, schema)


def _scan_blocks_form(corpus, queries, schema, qid_col, qvec_col, id_col, vec_col, exclude_col,
                      payload, k, max_rows, max_bytes):
    """Many questions, huge corpus: one broadcast form per question block, unioned.

    The corpus is scanned once per block but never shuffled (the cogroup form
    would write it to shuffle once per question block). Question blocks are
    hash slices of a checkpointed question table, each within the broadcast
    bound; the driver holds one block at a time.
    """
    q = _dealt(queries)
    nb = _question_blocks(q, qvec_col, max_rows, max_bytes)
    parts = []
    for b in range(nb):
        whole = q.where(F.pmod(F.col("__at"), F.lit(nb).cast("long")) == b).drop("__at").toArrow()
        dim = pc.max(pc.list_value_length(whole.column(qvec_col))).as_py() or 0
        rows = max(1, min(max_rows, max_bytes // (8 * max(dim, 1))))
        for off in range(0, whole.num_rows, rows):           # a block that came out too large is split
            blk = whole.slice(off, rows)
            qm, dim = _matrix(blk.column(qvec_col), None)
            parts.append(_broadcast_form(corpus, blk, qm, dim, schema, qid_col, id_col, vec_col,
                                         exclude_col, payload, k))
    if not parts:
        return corpus.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _question_blocks(queries: DataFrame, qvec_col: str, max_rows: int, max_bytes: int) -> int:
    """Blocks that a question set needs to stay within both bounds, with room for uneven hashing."""
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size(qvec_col))).first()
    return max(1, math.ceil(2 * n / max(2, max_rows)), math.ceil(2 * n * 8 * max(dim or 0, 0) / max(2, max_bytes)))


SCAN_BLOCKS_MAX = 64      # most corpus re-scans the scan_blocks form may cost


def _large_form(corpus: DataFrame, queries: DataFrame, qvec_col: str, max_rows: int, max_bytes: int) -> str:
    """Choose a form for a question set beyond the broadcast bound (two count jobs).

    Re-scanning a corpus costs less than replicating it through a shuffle, so
    when the corpus is much larger than the questions and few blocks are
    needed, scan per question block; otherwise replicate both sides over
    bounded cogroup cells.
    """
    n_q = queries.count()
    n_c = corpus.count()
    blocks = _question_blocks(queries, qvec_col, max_rows, max_bytes)
    return "scan_blocks" if n_c >= 10 * n_q and blocks <= SCAN_BLOCKS_MAX else "blocked"


def top_k(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id",
          vec_col: str = "embedding", qid_col: str = "qid", qvec_col: str = "qvec",
          exclude_col: str | None = None, payload: tuple[str, ...] | list[str] = (),
          form: str = "auto", rank_col: str = "rk",
          max_broadcast_queries: int = DEFAULT_MAX_BROADCAST_QUERIES,
          max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
          corpus_block_rows: int = CORPUS_BLOCK_ROWS,
          query_block_rows: int = QUERY_BLOCK_ROWS, tile_bytes: int = TILE_BYTES,
          merge_fanin: int = MERGE_FANIN, late_payload: bool | None = None) -> DataFrame:
    """For every question row, its k most similar corpus rows.

    Returns ``(qid, rk int, id, score double, *payload)``; ``rk`` runs 1..min(k, n).
    ``exclude_col`` names a question column holding a corpus id that must not be
    returned for that question (leave-one-out evaluation).

    ``late_payload``: carry only ``(qid, id, score)`` through the merge and
    fetch the payload columns of the final hits afterwards (see
    :func:`_fetch_payload`). ``None`` decides from the estimated candidate
    volume: every corpus task sends up to ``questions x k`` candidates, so on
    a wide scan the payload would dominate the merge shuffle.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    if form not in ("auto", "broadcast", "blocked", "scan_blocks"):
        raise ValueError(f"unknown form {form!r}")
    if qid_col in (id_col, vec_col) or qid_col in payload:
        raise ValueError("question id column must differ from corpus columns")
    payload = list(payload)
    # a row's own payload comes back for it, also where corpus ids repeat or are null
    corpus = corpus.withColumn(_ROW, F.xxhash64(*payload)) if payload else corpus
    qcols = [qid_col, qvec_col] + ([exclude_col] if exclude_col else [])
    q = queries.select(*qcols)
    map_tasks = scan_tasks(corpus)
    carried = payload
    local = None
    if form in ("auto", "broadcast"):
        # bounded collect: never more than max_broadcast_queries + 1 rows reach the driver
        qtbl = q.limit(max_broadcast_queries + 1).toArrow()
        qm, dim = _matrix(qtbl.column(qvec_col), None) if qtbl.num_rows <= max_broadcast_queries \
            else (None, None)
        if qm is not None and qm.nbytes <= max_broadcast_bytes:
            if qtbl.num_rows == 0:
                return _empty_result(corpus, q, qid_col, id_col, payload, rank_col)
            n_q = qtbl.num_rows
            late = _late(late_payload, payload, map_tasks, n_q, k)
            carried = [_ROW] if late else payload
            local = _broadcast_form(corpus, qtbl, qm, dim,
                                    _local_schema(corpus, q, qid_col, id_col, carried), qid_col,
                                    id_col, vec_col, exclude_col, carried, k)
        elif form == "broadcast":
            raise ValueError("question block exceeds the broadcast bound; use form='blocked'")
    if local is None:
        n_q = q.count()                  # beyond the broadcast bound: the real size, for the checks below
        late = _late(late_payload, payload, map_tasks, n_q, k)
        if form == "auto":
            form = _large_form(corpus, q, qvec_col, max_broadcast_queries, max_broadcast_bytes)
        # a tile holds vectors only, so that its size is known
        late = late or (form == "blocked" and bool(payload) and late_payload is None)
        carried = [_ROW] if late else payload
        schema = _local_schema(corpus, q, qid_col, id_col, carried)
        if form == "scan_blocks":
            local = _scan_blocks_form(corpus, q, schema, qid_col, qvec_col, id_col, vec_col,
                                      exclude_col, carried, k, max_broadcast_queries,
                                      max_broadcast_bytes)
        else:
            local = _blocked_form(corpus, q, schema, qid_col, qvec_col, id_col, vec_col,
                                  exclude_col, carried, k, corpus_block_rows, query_block_rows, tile_bytes)
    hits = merge_topk(local, k, qid_col=qid_col, id_col=id_col, rank_col=rank_col,
                      cols=[qid_col, rank_col, id_col, "score", *carried],
                      map_tasks=map_tasks, merge_fanin=merge_fanin)
    if carried == payload:
        return hits
    out = _fetch_payload(corpus, hits, id_col, payload, broadcast_ids=n_q * k <= MAX_FETCH_IDS)
    return out.select(qid_col, rank_col, id_col, "score", *payload)


def _late(late_payload: bool | None, payload: list[str], map_tasks: int | None, n_q: int,
          k: int) -> bool:
    if not payload:
        return False
    if late_payload is not None:
        return late_payload
    return map_tasks is not None and map_tasks * min(n_q, 10 ** 9) * k > LATE_PAYLOAD_ROWS


def _fetch_payload(corpus: DataFrame, hits: DataFrame, id_col: str, payload: list[str],
                   broadcast_ids: bool) -> DataFrame:
    """Payload of the final hits from a second, column-pruned corpus scan.

    The hits (at most ``questions x k`` rows) are checkpointed first, so the
    top-k is computed once. Their distinct ids go to the scan as a broadcast
    semi join when they are checked to fit (at most ``MAX_FETCH_IDS`` ids and
    ``MAX_FETCH_BYTES``, measured with one aggregate over the checkpoint); the
    scan then reads only the id and payload columns and never shuffles the
    corpus. Beyond the bound a shuffled semi join on the narrow id column runs.
    A hit finds its own row by id and hash of the payload (rows that agree in
    both are interchangeable), so repeated and null ids keep their payload.
    """
    from ..session import cut_lineage
    hits = cut_lineage(hits)
    ids = hits.select(F.col(id_col).alias("_hit_id"), F.col(_ROW).alias("_hit_row")).distinct()
    if broadcast_ids:
        size = ids.agg(F.count(F.lit(1)).alias("n"),
                       F.coalesce(F.sum(F.octet_length(F.col("_hit_id").cast("string"))), F.lit(0))
                       .alias("b")).first()
        broadcast_ids = size.n <= MAX_FETCH_IDS and size.b + 24 * size.n <= MAX_FETCH_BYTES
    pay = corpus.select(F.col(id_col).alias("_pay_id"), F.col(_ROW).alias("_pay_row"), *payload)
    pay = pay.join(F.broadcast(ids) if broadcast_ids else ids,
                   F.col("_pay_id").eqNullSafe(F.col("_hit_id")) & (F.col("_pay_row") == F.col("_hit_row")),
                   "left_semi").dropDuplicates(["_pay_id", "_pay_row"])
    return hits.join(pay, hits[id_col].eqNullSafe(pay["_pay_id"]) & (hits[_ROW] == pay["_pay_row"]), "left")


def merge_topk(local: DataFrame, k: int, *, qid_col: str = "qid", id_col: str = "id",
               score_col: str = "score", rank_col: str = "rk", cols=None,
               map_tasks: int | None = None, merge_fanin: int = MERGE_FANIN) -> DataFrame:
    """Global top-k from local candidates: one shuffle by question, partial limit before it.

    A question receives up to ``map_tasks x k`` candidates. When that exceeds
    ``merge_fanin`` (one question against a very wide scan), the merge runs in
    two levels: first per (question, salt of the producing task), then per
    question, so no single task sorts more than ``merge_fanin`` rows of one key.
    """
    order = [F.col(score_col).desc_nulls_last(), F.col(id_col).asc()]
    if map_tasks and map_tasks * k > merge_fanin:
        salts = math.ceil(map_tasks * k / merge_fanin)
        salted = local.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        w1 = Window.partitionBy(qid_col, "_salt").orderBy(*order)
        local = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= F.lit(k)) \
            .drop("_salt", "_r1")
    w = Window.partitionBy(qid_col).orderBy(*order)
    out = local.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= F.lit(k))
    return out.select(*(cols or out.columns))


def _empty_result(corpus, q, qid_col, id_col, payload, rank_col):
    schema = _local_schema(corpus, q, qid_col, id_col, payload)
    fields = [schema[qid_col], T.StructField(rank_col, T.IntegerType()), schema[id_col],
              schema["score"]] + [schema[p] for p in payload]
    return corpus.sparkSession.createDataFrame([], T.StructType(fields))


# --------------------------------------------------------------------------
# Variants of the reference's search functions
# --------------------------------------------------------------------------

def search_ranked(corpus, queries, k=5, **kw) -> DataFrame:
    """Hits ``{rank, id, score, Q, A}`` per question (numpy search form)."""
    hits = top_k(corpus, queries, k, payload=["input", "output"], **kw)
    return hits.select("qid", F.col("rk").alias("rank"), "id", "score",
                       F.col("input").alias("Q"), F.col("output").alias("A"))


def search_scored(corpus, queries, k=3, **kw) -> DataFrame:
    """``(id, input, output, score)`` per question, ordered by ``rk``."""
    return top_k(corpus, queries, k, payload=["input", "output"], **kw) \
        .select("qid", "rk", "id", "input", "output", "score")


def search_no_id(corpus, queries, k=3, **kw) -> DataFrame:
    """``{input, output, score}`` per question."""
    return search_scored(corpus, queries, k, **kw).select("qid", "rk", "input", "output", "score")


def search_no_score(corpus, queries, k=4, **kw) -> DataFrame:
    """``(input, output)`` per question; the sort key is not returned."""
    return search_scored(corpus, queries, k, **kw).select("qid", "rk", "input", "output")


def search_per_question_k(corpus, queries, default_k=3, k_col="k", **kw) -> DataFrame:
    """Each question may carry its own k (null -> default); any k of 1 or more is met in full.

    The largest k of the set (one aggregate) bounds the shared top-k; each
    question then keeps its own.
    """
    from ..session import cut_lineage
    # the aggregate and the search both read the questions: compute them once
    queries = cut_lineage(queries)
    wanted = F.coalesce(F.col(k_col), F.lit(default_k))
    low, high = queries.agg(F.min(wanted), F.max(wanted)).first()
    if low is not None and low < 1:
        raise ValueError("k must be >= 1")
    kq = queries.select("qid", wanted.alias("_k"))
    hits = top_k(corpus, queries, max(high or 1, 1), payload=["output"], **kw)
    # kq is keyed by qid like hits: the join reuses the merge's partitioning
    return hits.join(kq, "qid").filter(F.col("rk") <= F.col("_k")).select("qid", "rk", "id", "output")
