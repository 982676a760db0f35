"""Maximal marginal relevance selection.

``fetch_k`` candidates per question come from the exact top-k; then ``k``
are picked greedily by ``lambda * sim(q, d) - (1 - lambda) * max sim(d, chosen)``
(Carbonell & Goldstein 1998; lambda = 0.5 as in the retriever the reference
configures). The first pick is the most similar candidate; ties go to the
better-ranked candidate. Scores are rounded to 9 decimals before comparing,
so float noise cannot flip a tie.

Each question's group holds at most ``fetch_k`` rows (a fixed bound). The few
candidates are dealt and sorted by question and rank, and every Arrow batch
holds many questions: a grouped ``applyInArrow`` costs a few milliseconds per
question, more than its picks. The candidate Gram matrix (fetch_k x fetch_k)
lives only inside the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import topk as K

# Fixed values (retriever configuration of the reference and the library default)
MMR_K = 4
MMR_FETCH_K = 20
MMR_LAMBDA = 0.5
_ROUND = 9


def _cos_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dotp = a @ b.T
    denom = np.sqrt(np.einsum("ij,ij->i", a, a)[:, None] * np.einsum("ij,ij->i", b, b)[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        s = dotp / denom
    s[~(denom > 0)] = np.nan
    return np.clip(s, -1.0, 1.0)


def greedy_mmr(rel: np.ndarray, gram: np.ndarray, k: int, lam: float) -> list[int]:
    """Indices chosen by MMR; candidates are in rank order, ``rel`` is their
    similarity to the question (NaN = null), ``gram`` their pairwise cosines."""
    n = len(rel)
    if n == 0:
        return []
    known = np.isfinite(rel)
    chosen = [0]                           # candidates come in rank order: rank 1 first
    while len(chosen) < min(k, n):
        sims = gram[:, chosen]
        red = np.where(np.isnan(sims), -np.inf, sims).max(axis=1)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isfinite(red), lam * rel - (1.0 - lam) * red, lam * rel)
        # a null similarity to the question ranks after every defined score, in rank order
        score = np.where(known, np.round(score, _ROUND), -1e300)
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))   # first maximum = best-ranked candidate
    return chosen


def mmr(corpus: DataFrame, queries: DataFrame, k: int = MMR_K, fetch_k: int = MMR_FETCH_K,
        lam: float = MMR_LAMBDA, *, id_col: str = "id", vec_col: str = "embedding",
        qid_col: str = "qid", qvec_col: str = "qvec", exclude_col: str | None = None,
        payload=(), late_payload: bool | None = None, **topk_kw) -> DataFrame:
    """``(qid, pos int, id, score, *payload)``: the MMR picks in pick order (``pos`` 1..k).

    The candidates' vectors come with the merge, or afterwards where a wide scan
    would send many of them (``late_payload``, see :func:`.topk.top_k`).
    """
    if k < 1 or fetch_k < k:
        raise ValueError("need 1 <= k <= fetch_k")
    payload = [p for p in payload if p not in (id_col, vec_col)]
    cand = K.top_k(corpus, queries, fetch_k, id_col=id_col, vec_col=vec_col, qid_col=qid_col,
                   qvec_col=qvec_col, exclude_col=exclude_col, payload=[vec_col, *payload],
                   late_payload=late_payload, **topk_kw)
    cf = {f.name: f.dataType for f in cand.schema.fields}
    out_schema = T.StructType(
        [T.StructField(qid_col, cf[qid_col]), T.StructField("pos", T.IntegerType()),
         T.StructField(id_col, cf[id_col]), T.StructField("score", T.DoubleType())]
        + [T.StructField(p, cf[p]) for p in payload])

    arrow_schema = to_arrow_schema(out_schema)

    def pick(tbl: pa.Table) -> pa.Table:
        """The picks of whole questions; each one's candidates start at rank 1."""
        first = np.flatnonzero(tbl.column("rk").to_numpy() == 1)
        cvec, _ = K._matrix(tbl.column(vec_col), None)      # a null vector is a zero row
        rel = tbl.column("score").to_numpy(zero_copy_only=False).astype(np.float64)  # null -> NaN
        chosen = [a + np.array(greedy_mmr(rel[a:b], _cos_matrix(cvec[a:b], cvec[a:b]), k, lam), np.int64)
                  for a, b in zip(first, np.append(first[1:], tbl.num_rows), strict=True)]
        sel = tbl.take(pa.array(np.concatenate(chosen)))
        pos = np.concatenate([np.arange(1, len(c) + 1, dtype=np.int32) for c in chosen])
        cols = {qid_col: sel.column(qid_col), "pos": pa.chunked_array([pos]),
                id_col: sel.column(id_col), "score": sel.column("score")}
        cols.update({p: sel.column(p) for p in payload})
        return pa.Table.from_arrays([cols[f.name].cast(f.type) for f in arrow_schema], schema=arrow_schema)

    def run(batches):
        held = None                                         # the last question may go on in the next batch
        for batch in batches:
            tbl = pa.Table.from_batches([batch])
            tbl = tbl if held is None else pa.concat_tables([held, tbl])
            starts = np.flatnonzero(tbl.column("rk").to_numpy() == 1)
            if not len(starts):
                continue
            if starts[-1]:
                yield from pick(tbl.slice(0, starts[-1])).to_batches()
            held = tbl.slice(starts[-1])
        if held is not None:
            yield from pick(held).to_batches()

    # a question's candidates stay together, in order, and many questions share a call
    return cand.repartition(qid_col).sortWithinPartitions(qid_col, "rk").mapInArrow(run, out_schema)
