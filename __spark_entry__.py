"""

Every query reads the given tables in full (no id subsets, no samples):

* text retrieval runs on the Q/A corpus built from ``conversations`` (every
  user turn answered by the assistant) and is evaluated leave-one-out: every
  pair is a question against all the other pairs;
* vector retrieval runs on ``embeddings``: every vector against all others;
* ingest runs on ``documents`` (content ids, first copy wins) against the
  corpus of labelled documents.

The oracle SQL recomputes each result independently in DuckDB (list lambdas
instead of the Spark operators). Scores are rounded to 4 decimals, metric
values to 6; ``+ 0.0`` turns a rounded -0.0 into 0.0 on both sides.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import prompts as P
from ragloom.functions import text as TX
from ragloom.functions import vectors as V
from ragloom.operators import context as CX
from ragloom.operators import corpus as C
from ragloom.operators import embed as E
from ragloom.operators import generate as G
from ragloom.operators import id_table as IT
from ragloom.operators import judge as J
from ragloom.operators import metrics as M
from ragloom.operators import mmr as MMR
from ragloom.operators import model_runs as MR
from ragloom.operators import pruned as PR
from ragloom.operators import reuse as RU
from ragloom.operators import runs as R
from ragloom.operators import standins as SI
from ragloom.operators import topk as K
from ragloom.plans import answer as PA
from ragloom.plans import evaluation as EV
from ragloom.session import cut_lineage, ensure_checkpoint_dir, ship_code, work_path
from ragloom.sources import files as FS
from ragloom.sources import splitting as SP
from ragloom.sources import testdata as TD
from ragloom.streaming import keyed as KS
from ragloom.streaming import stream as ST

SMOKE_DIR = "/root/testdata/sf0.001"
DIM = TD.DIM
#: Bytes of a tile's side for the tables of the tests, so that both sides have several blocks.
TILE_BYTES = 64 << 10


# ===========================================================================
# Spark side
# ===========================================================================

def _r(c, n: int = 4):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, n) + F.lit(0.0)


def _qa(spark, sf):
    ensure_checkpoint_dir(spark)
    corpus = TD.qa_corpus(spark, sf)
    questions = TD.eval_questions(corpus).withColumn("self_id", F.col("qid"))
    return corpus, questions


def _qa_hits(spark, sf, k):
    corpus, q = _qa(spark, sf)
    return corpus, q, K.top_k(corpus, q, k, exclude_col="self_id", payload=["input", "output"])


def _records(spark, sf, k=EV.EVAL_K):
    corpus, q, hits = _qa_hits(spark, sf, k)
    return EV.records(q, hits)


def _docs_load(spark, sf):
    docs = TD.read_table(spark, sf, "documents")
    load = docs.select(C.content_id("text").alias("id"), F.col("doc_id").alias("load_seq"),
                       "doc_id", "lang", F.col("text").alias("input"))
    labelled = docs.join(TD.read_table(spark, sf, "labels"), "doc_id", "left_semi")
    existing = labelled.select(C.content_id("text").alias("id")).distinct()
    return load, existing


def q_qa_pairs(spark, sf):
    return TD.qa_pairs(spark, sf)


def q_fill_output(spark, sf):
    conv = TD.read_table(spark, sf, "conversations")
    users = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    nxt = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return C.fill_output(users.join(nxt, ["conv_id", "turn"], "left"))


def q_positional_id(spark, sf):
    ensure_checkpoint_dir(spark)
    return C.positional_ids(TD.qa_pairs(spark, sf), ["conv_id", "turn"]).select("id", "conv_id", "turn")


def q_prune_columns(spark, sf):
    corpus, _ = _qa(spark, sf)
    return corpus.select("id", "input")


def q_rename_eval_columns(spark, sf):
    rec = _records(spark, sf)
    sheet = rec.select("qid", F.col("question").alias("user_input"),
                       F.col("answer").alias("response"), "reference")
    return sheet.withColumnsRenamed({"user_input": "question", "response": "answer"}) \
        .select("qid", "question", "answer", "reference")


def q_contract_report(spark, sf):
    return C.contract_report(TD.vector_corpus(spark, sf), DIM)


def q_insert_if_absent(spark, sf):
    load, existing = _docs_load(spark, sf)
    return C.rows_to_insert(load, existing).select("id", "doc_id", "lang")


def q_insert_bucketed(spark, sf):
    """K03/K06 beyond the broadcast bound: the corpus' ids in a bucketed table that is joined without an exchange."""
    load, existing = _docs_load(spark, sf)
    table, corpus = IT.fresh_name(), work_path(spark, "bucketed-corpus")
    IT.create(spark, table, existing, buckets=8)
    IT.insert(load, corpus, table, columns=["id", "doc_id", "lang"])
    IT.drop(spark, table)
    return spark.read.parquet(corpus).select("id", "doc_id", "lang")


def q_load_report(spark, sf):
    load, existing = _docs_load(spark, sf)
    return C.load_report(load, existing)


def _vec_summary(v):
    return [F.aggregate(V.as_double(v), F.lit(0.0), lambda a, x: a + x).alias("n_tokens"),
            F.size(F.filter(v, lambda x: x > 0)).cast("int").alias("n_buckets"),
            F.aggregate(F.zip_with(V.as_double(v), F.sequence(F.lit(1), F.size(v)), lambda x, i: x * i),
                        F.lit(0.0), lambda a, x: a + x).alias("weighted")]


def q_add_documents(spark, sf):
    load, existing = _docs_load(spark, sf)
    new = C.rows_to_insert(load, existing)          # anti join first: only new rows are embedded
    emb = E.embed(new, "input", "embedding", dim=DIM)
    return emb.select("id", "doc_id", *_vec_summary(F.col("embedding")))


def q_hash_embed(spark, sf):
    corpus, _ = _qa(spark, sf)
    ex = corpus.select("id", F.posexplode("embedding").alias("bucket", "n"))
    return ex.where(F.col("n") > 0).select("id", F.col("bucket").cast("int"), F.col("n").cast("double"))


def q_l2_normalise(spark, sf):
    vc = TD.vector_corpus(spark, sf)
    u = V.l2_normalise("embedding")
    return vc.select("id", _r(V.l2_norm("embedding"), 6).alias("norm"),
                     _r(F.aggregate(u, F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"),
                     _r(V.l2_norm(u), 6).alias("unit_norm"))


def _qa_vectors(spark, sf):
    pairs = TD.qa_pairs(spark, sf)
    return (E.embed(E.embed(pairs, "input", "qv", dim=DIM), "output", "av", dim=DIM))


def q_dot_scores(spark, sf):
    return _qa_vectors(spark, sf).select("conv_id", "turn", V.dot("qv", "av").alias("dot"))


def q_cosine_distance(spark, sf):
    return _qa_vectors(spark, sf).select(
        "conv_id", "turn", _r(V.cosine_similarity("qv", "av")).alias("similarity"),
        _r(V.cosine_distance("qv", "av")).alias("distance"))


def q_vector_text_round_trip(spark, sf):
    vc = TD.vector_corpus(spark, sf)
    back = V.from_text(V.to_text("embedding"))
    return vc.select("id", (back == F.col("embedding")).alias("same"), F.size(back).cast("int").alias("dim"))


def q_float32_cast(spark, sf):
    vc = TD.vector_corpus(spark, sf)
    d = V.as_double("embedding")
    f32 = V.as_float32(d)
    return vc.select("id", (f32 == F.col("embedding")).alias("same"),
                     _r(F.aggregate(V.as_double(f32), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def q_dimension_check(spark, sf):
    vc = TD.vector_corpus(spark, sf)
    return vc.select("id", F.size("embedding").cast("int").alias("dim"),
                     V.dimension_ok("embedding", DIM).alias("ok"))


def q_topk_single_rank(spark, sf):
    corpus, q = _qa(spark, sf)
    return K.search_ranked(corpus, q, 5, exclude_col="self_id").withColumn("score", _r("score"))


def q_topk_scored(spark, sf):
    corpus, q = _qa(spark, sf)
    return K.search_scored(corpus, q, 3, exclude_col="self_id").withColumn("score", _r("score"))


def q_topk_no_id(spark, sf):
    corpus, q = _qa(spark, sf)
    return K.search_no_id(corpus, q, 3, exclude_col="self_id").withColumn("score", _r("score"))


def q_topk_no_score(spark, sf):
    corpus, q = _qa(spark, sf)
    return K.search_no_score(corpus, q, 4, exclude_col="self_id")


def q_batched_topk(spark, sf):
    vc = TD.vector_corpus(spark, sf)
    hits = K.top_k(vc, TD.vector_queries(vc), 5, exclude_col="self_id")
    return hits.select("qid", "rk", "id", _r("score").alias("score"))


def q_topk_tiles(spark, sf):
    """R05 for more questions than a broadcast may hold: tiles of corpus and question blocks."""
    vc = TD.vector_corpus(spark, sf)
    hits = K.top_k(vc, TD.vector_queries(vc), 5, exclude_col="self_id", form="blocked", tile_bytes=TILE_BYTES)
    return hits.select("qid", "rk", "id", _r("score").alias("score"))


def _per_question_k():
    n = F.size(TX.statements("question"))
    return F.when(n > 1, n)


def q_topk_per_question_k(spark, sf):
    corpus, q = _qa(spark, sf)
    q = q.withColumn("k", _per_question_k())
    return K.search_per_question_k(corpus, q, default_k=3, exclude_col="self_id")


def q_mmr(spark, sf):
    vc = TD.vector_corpus(spark, sf)
    return MMR.mmr(vc, TD.vector_queries(vc), exclude_col="self_id").select("qid", "pos", "id")


def q_contexts_joined(spark, sf):
    _, _, hits = _qa_hits(spark, sf, 3)
    return CX.contexts(hits).select("qid", CX.join_contexts("contexts").alias("context"))


def q_scored_reference(spark, sf):
    _, _, hits = _qa_hits(spark, sf, 3)
    return CX.scored_reference(hits)


def q_numbered_documents(spark, sf):
    _, _, hits = _qa_hits(spark, sf, 3)
    return CX.numbered_documents(hits)


def q_prompt_baseline(spark, sf):
    _, q = _qa(spark, sf)
    return q.select("qid", P.baseline_prompt("question").alias("prompt"))


def q_prompt_context(spark, sf):
    _, q, hits = _qa_hits(spark, sf, 4)
    ctx = CX.contexts(hits)
    return q.join(ctx, "qid", "left").select(
        "qid", P.context_prompt(CX.join_contexts(F.coalesce("contexts", F.array().cast("array<string>"))),
                                "question").alias("prompt"))


def q_prompt_reference(spark, sf):
    _, q, hits = _qa_hits(spark, sf, 3)
    ref = CX.scored_reference(hits)
    return q.join(ref, "qid", "left").select(
        "qid", P.reference_prompt("question", "reference_block").alias("prompt"))


def q_chat_messages(spark, sf):
    _, q, hits = _qa_hits(spark, sf, 3)
    docs = CX.numbered_documents(hits)
    msgs = q.join(docs, "qid", "left").select("qid", P.chat_messages("documents", "question").alias("m"))
    return msgs.select("qid", F.posexplode("m").alias("pos", "msg")).select(
        "qid", (F.col("pos") + 1).cast("int").alias("pos"), "msg.role", "msg.content")


def _given_docs(corpus):
    """Given documents of a question: the previous Q/A pair of its conversation (equi-join, no skew)."""
    prev = corpus.select("conv_id", (F.col("turn") + 2).alias("turn"),
                         F.lit(1).alias("rk"), "input", "output")
    return corpus.select(F.col("id").alias("qid"), "conv_id", "turn").join(prev, ["conv_id", "turn"]) \
        .select("qid", "rk", "input", "output")


def q_answer_routed(spark, sf):
    corpus, q = _qa(spark, sf)
    out = PA.answer(corpus, q, _given_docs(corpus), exclude_col="self_id")
    return out.select("qid", "source", "prompt", "answer")


def q_context_route(spark, sf):
    corpus, q = _qa(spark, sf)
    given = _given_docs(corpus)
    given_docs = CX.numbered_documents(given)
    # only questions without documents of their own are searched for
    need = q.join(given.select("qid").distinct(), "qid", "left_anti")
    hits = K.top_k(corpus, need, 4, exclude_col="self_id", payload=["input", "output"])
    retrieved = CX.contexts(hits).select("qid", CX.join_contexts("contexts").alias("contexts"))
    return CX.route(q, given_docs, retrieved)


def _answers(spark, sf):
    return _records(spark, sf).select("qid", "question", "reference", "contexts", "answer")


def q_refusal_flag(spark, sf):
    _, q = _qa(spark, sf)
    rag = _answers(spark, sf).select(F.lit("rag").alias("run_id"), "qid", "answer")
    base = R.baseline_records(q).select(F.lit("baseline").alias("run_id"), "qid", "answer")
    return rag.unionByName(base).select("run_id", "qid", P.refusal_flag("answer").alias("refusal"))


def q_generate_stand_in(spark, sf):
    return _answers(spark, sf).select("qid", "answer")


def q_eval_records(spark, sf):
    rec = _answers(spark, sf)
    return rec.select("qid", "question", "reference", F.size("contexts").cast("int").alias("n_contexts"),
                      CX.join_contexts("contexts").alias("context"), "answer")


def q_answer_similarity(spark, sf):
    return M.answer_similarity(_records(spark, sf)).withColumn("answer_similarity",
                                                                _r("answer_similarity", 6))


def _verdict_metric(spark, sf, name):
    rec = _records(spark, sf)
    m = M.verdict_metrics(J.stand_in_verdicts(rec))
    return rec.select("qid").join(m, "qid", "left").select("qid", _r(name, 6).alias(name))


def q_context_precision(spark, sf):
    return _verdict_metric(spark, sf, "context_precision")


def q_context_recall(spark, sf):
    return _verdict_metric(spark, sf, "context_recall")


def q_faithfulness(spark, sf):
    return _verdict_metric(spark, sf, "faithfulness")


def q_answer_relevancy(spark, sf):
    rec = _records(spark, sf)
    ar = M.answer_relevancy(rec)
    return rec.select("qid").join(ar, "qid", "left").select("qid", _r("answer_relevancy", 6)
                                                            .alias("answer_relevancy"))


def q_score_table(spark, sf):
    scores = M.rounded(M.score_table(_records(spark, sf)), 3)
    return scores.select("qid", *[(F.col(m) + F.lit(0.0)).alias(m) for m in M.METRICS])


def q_run_summary(spark, sf):
    corpus, q, hits = _qa_hits(spark, sf, max(R.SWEEP_KS))
    sweep = R.sweep_scores(q, hits)
    base = M.score_table(R.baseline_records(q)).withColumn("run_id", F.lit("baseline"))
    return R.run_summary(sweep.unionByName(base, allowMissingColumns=True))


def q_run_compare(spark, sf):
    _, q, hits = _qa_hits(spark, sf, 3)
    rag = M.score_table(EV.records(q, hits))
    base = M.score_table(R.baseline_records(q))
    return R.compare(rag, base, key="qid")


#: Runs of the model comparison: ks beside the baseline, and the run that the others are held against.
MODEL_KS, MODEL_BASE = (1, 3), "full/k=3"


def q_model_compare(spark, sf):
    """Three models at several k and without retrieval, with paired bootstrap intervals."""
    _, q, hits = _qa_hits(spark, sf, max(MODEL_KS))
    scores = MR.grid_scores(MR.grid_records(q, hits, ks=MODEL_KS))
    return MR.paired_bootstrap(scores, MODEL_BASE)


def q_stream_topk(spark, sf):
    vc = TD.vector_corpus(spark, sf)
    src = f"{sf.rstrip('/')}/embeddings.parquet"
    schema = spark.read.parquet(src).schema
    query, sink = ST.question_stream(
        spark, src, schema, vc, 5,
        prepare=lambda b: b.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"),
                                   F.col("vec_id").alias("self_id")),
        exclude_col="self_id")
    ST.run_to_end(query)
    return ST.read_sink(spark, sink).select("qid", "rk", "id", _r("score").alias("score"))


def q_stream_ingest(spark, sf):
    corpus_path = work_path(spark, "stream-corpus")
    load, existing = _docs_load(spark, sf)
    docs = TD.read_table(spark, sf, "documents")
    labelled = docs.join(TD.read_table(spark, sf, "labels"), "doc_id", "left_semi").select(
        C.content_id("text").alias("id"), F.col("doc_id").alias("load_seq"), "doc_id", "lang")
    C.insert_if_absent(labelled, corpus_path)          # the corpus before the stream
    src = f"{sf.rstrip('/')}/documents.parquet"
    query = ST.document_stream(
        spark, src, spark.read.parquet(src).schema, corpus_path,
        prepare=lambda b: b.select(C.content_id("text").alias("id"), F.col("doc_id").alias("load_seq"),
                                   "doc_id", "lang"))
    ST.run_to_end(query)
    return spark.read.parquet(corpus_path).select("id", "doc_id", "lang")


def q_stream_ingest_keyed(spark, sf):
    """ST2: the documents as a stream with the seen ids in keyed state; the corpus before the stream is known."""
    _, existing = _docs_load(spark, sf)
    before, sink = work_path(spark, "keyed-before"), work_path(spark, "keyed-corpus")
    existing.write.parquet(before)
    src = f"{sf.rstrip('/')}/documents.parquet"
    ST.run_to_end(KS.keyed_document_stream(
        spark, src, spark.read.parquet(src).schema, sink, existing=before,
        prepare=lambda b: b.select(C.content_id("text").alias("id"), F.col("doc_id").alias("load_seq"), "doc_id", "lang")))
    return spark.read.parquet(sink).select("id", "doc_id", "lang")


def q_topk_pruned(spark, sf):
    """R05 from a cluster index that skips folders and runs by angle bounds, and stays exact."""
    vc = TD.vector_corpus(spark, sf)
    hits = PR.search(PR.build_index(vc), TD.vector_queries(vc), 5, exclude_col="self_id")
    return hits.select("qid", "rk", "id", _r("score").alias("score"))


def q_raw_corpus_array(spark, sf):
    """K01 then S01: the Q/A pairs as one JSON array in one file, read by byte ranges."""
    path = work_path(spark, "raw-array")
    SP.write_json_array(TD.qa_pairs(spark, sf).select("input", "output", F.lit("case {[,]}").alias("casename")), path)
    return FS.read_raw_corpus(spark, path, split=True)


def q_answer_sheet_split(spark, sf):
    """K07 then S04: a sheet of answers with quoted newlines, read by byte ranges."""
    path = work_path(spark, "answer-sheet-split")
    sheet = _records(spark, sf).select(F.col("question").alias("user_input"), F.col("answer").alias("response"), "reference")
    FS.write_scores_csv(cut_lineage(sheet).coalesce(1), path)      # one task writes the file, many compute it
    return FS.read_answer_sheet(spark, path, split=True)


def q_raw_corpus_json(spark, sf):
    """K01 then S01: the Q/A pairs as a JSON corpus, written and read back."""
    path = work_path(spark, "raw-corpus")
    FS.write_json(TD.qa_pairs(spark, sf).select("input", "output", F.lit("case").alias("casename")), path)
    return FS.read_raw_corpus(spark, path, json_array=False)


def q_embedded_corpus_json(spark, sf):
    """K01 then S02: a corpus with vectors, written and read back."""
    path = work_path(spark, "embedded-corpus")
    vc = TD.vector_corpus(spark, sf)
    FS.write_json(vc.select(F.col("id").cast("string").alias("id"), F.lit("in").alias("input"),
                            F.lit("out").alias("output"), "embedding"), path)
    back = FS.read_embedded_corpus(spark, path, json_array=False)
    return back.select("id", "input", "output", F.size("embedding").cast("int").alias("dim"), _r(
        F.aggregate(V.as_double("embedding"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def q_eval_set_json(spark, sf):
    """The evaluation set, written and read back."""
    path = work_path(spark, "eval-set")
    FS.write_json(TD.qa_pairs(spark, sf).select("input", "output"), path)
    return FS.read_eval_set(spark, path, json_array=False)


def q_answer_sheet_csv(spark, sf):
    """K07 then S04: a sheet of answers as CSV with a BOM, written and read back."""
    path = work_path(spark, "answer-sheet")
    FS.write_scores_csv(_records(spark, sf).select(F.col("question").alias("user_input"),
                                                   F.col("answer").alias("response"), "reference"), path)
    return FS.read_answer_sheet(spark, path)


def q_embed_model(spark, sf):
    """The batch stage with a model object (the Python form of the hashing embedder)."""
    emb = E.embed(TD.qa_pairs(spark, sf).select("conv_id", "turn", "input"), "input", "embedding",
                  embedder=E.HashEmbedder(DIM))
    return emb.select("conv_id", "turn", *_vec_summary(F.col("embedding")))


def q_embed_distinct(spark, sf):
    """Each distinct text of the conversations is embedded once."""
    emb = E.embed_distinct(TD.read_table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text",
                           "embedding", embedder=E.HashEmbedder(DIM))
    return emb.select("conv_id", "turn", *_vec_summary(F.col("embedding")))


def q_embed_cached(spark, sf):
    """Vectors from a table that runs share; the second run finds all of them there."""
    conv, path = TD.read_table(spark, sf, "conversations").select("conv_id", "turn", "text"), work_path(spark, "vectors")
    for _ in range(2):
        emb = RU.embed_cached(conv, "text", "embedding", path, embedder=E.HashEmbedder(DIM), name="hash")
    return emb.select("conv_id", "turn", *_vec_summary(F.col("embedding")))


def q_generate_resumable(spark, sf):
    """Answers from a table keyed by the prompt, asked for in slices."""
    _, q = _qa(spark, sf)
    prompts = q.select("qid", P.baseline_prompt("question").alias("prompt"))
    out = RU.generate_resumable(prompts, work_path(spark, "answers"), generator=SI.ShortPrompts(), name="short", batch_size=1)
    return out.select("qid", "answer", "error")


def q_generate_errors(spark, sf):
    """A generator through the batch stage; its errors are values."""
    _, q = _qa(spark, sf)
    prompts = q.select("qid", P.baseline_prompt("question").alias("prompt"))
    return G.generate(prompts, "prompt", generator=SI.ShortPrompts(), batch_size=1).select("qid", "answer", "error")


def q_judge_errors(spark, sf):
    """The judge stage; records that the judge fails on keep null metrics."""
    out = J.judged_scores(_records(spark, sf), SI.StrictJudge())
    return out.select("qid", "error", *[_r(m, 6).alias(m) for m in M.METRICS])


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "qa_pairs": q_qa_pairs,
    "fill_output": q_fill_output,
    "positional_id": q_positional_id,
    "prune_columns": q_prune_columns,
    "rename_eval_columns": q_rename_eval_columns,
    "contract_report": q_contract_report,
    "insert_if_absent": q_insert_if_absent,
    "insert_bucketed": q_insert_bucketed,
    "load_report": q_load_report,
    "add_documents": q_add_documents,
    "hash_embed": q_hash_embed,
    "l2_normalise": q_l2_normalise,
    "dot_scores": q_dot_scores,
    "cosine_distance": q_cosine_distance,
    "vector_text_round_trip": q_vector_text_round_trip,
    "float32_cast": q_float32_cast,
    "dimension_check": q_dimension_check,
    "topk_single_rank": q_topk_single_rank,
    "topk_scored": q_topk_scored,
    "topk_no_id": q_topk_no_id,
    "topk_no_score": q_topk_no_score,
    "batched_topk": q_batched_topk,
    "topk_tiles": q_topk_tiles,
    "topk_pruned": q_topk_pruned,
    "topk_per_question_k": q_topk_per_question_k,
    "mmr": q_mmr,
    "contexts_joined": q_contexts_joined,
    "scored_reference": q_scored_reference,
    "numbered_documents": q_numbered_documents,
    "prompt_baseline": q_prompt_baseline,
    "prompt_context": q_prompt_context,
    "prompt_reference": q_prompt_reference,
    "chat_messages": q_chat_messages,
    "context_route": q_context_route,
    "answer_routed": q_answer_routed,
    "refusal_flag": q_refusal_flag,
    "generate_stand_in": q_generate_stand_in,
    "eval_records": q_eval_records,
    "answer_similarity": q_answer_similarity,
    "context_precision": q_context_precision,
    "context_recall": q_context_recall,
    "faithfulness": q_faithfulness,
    "answer_relevancy": q_answer_relevancy,
    "score_table": q_score_table,
    "run_summary": q_run_summary,
    "run_compare": q_run_compare,
    "model_compare": q_model_compare,
    "stream_topk": q_stream_topk,
    "stream_ingest": q_stream_ingest,
    "stream_ingest_keyed": q_stream_ingest_keyed,
    "raw_corpus_array": q_raw_corpus_array,
    "answer_sheet_split": q_answer_sheet_split,
    "raw_corpus_json": q_raw_corpus_json,
    "embedded_corpus_json": q_embedded_corpus_json,
    "eval_set_json": q_eval_set_json,
    "answer_sheet_csv": q_answer_sheet_csv,
    "embed_model": q_embed_model,
    "embed_distinct": q_embed_distinct,
    "embed_cached": q_embed_cached,
    "generate_errors": q_generate_errors,
    "generate_resumable": q_generate_resumable,
    "judge_errors": q_judge_errors,
}


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Every query first makes sure the workers can import the package."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_code(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the sf0.001 evaluation run (Q/A corpus -> embed -> top-3 -> prompt ->
    stand-in answer -> five metrics), one row per question."""
    return _prepared(q_score_table)(spark, SMOKE_DIR)


def _llm() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators; empty where the subpackage is not installed."""
    try:
        import corpus_pipeline
        from ragloom.llm import registry
    except ImportError:
        return {}, {}
    found, sql = dict(registry.QUERIES), dict(registry.ORACLE_SQL)
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(fn) for name, fn in {**_QUERIES, **_llm()[0]}.items()}


# ===========================================================================
# DuckDB oracle
# ===========================================================================

_REFUSAL = P.REFUSAL.replace("'", "''")


def _lit(s: str) -> str:
    """A Python string as a DuckDB literal (E'' style is not needed: chr(10) for newlines)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


def _tok(t: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')),"
            f" ' '), lambda w: w <> '')")


def _hvec(t: str) -> str:
    return (f"list_transform(range({DIM}), lambda i: len(list_filter(list_transform({_tok(t)}, "
            f"lambda w2: ('0x' || substr(md5(w2), 1, 4))::INT % {DIM}), lambda b: b = i))::DOUBLE)")


def _cos(a: str, b: str) -> str:
    den = f"(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
    return (f"(case when {den} > 0 then greatest(-1.0, least(1.0, "
            f"list_dot_product({a}, {b}) / sqrt({den}))) end)")


def _stmts(t: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({t}, '[.!?\\n]+'), lambda x: trim(x)),"
            f" lambda x: len({_tok('x')}) > 0)")


def _rd(x: str, n: int = 4) -> str:
    return f"(round({x}, {n}) + 0.0)"


_QA = """qa as (select u.conv_id, u.turn, u.text as input, a.text as output
        from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
        where u.role = 'user' and a.role = 'assistant')"""

_QC = _QA + f""",
qc as (select 'q_' || (row_number() over (order by conv_id, turn) - 1)::VARCHAR as id,
              conv_id, turn, input, output, {_hvec('input')} as v from qa)"""


def _hits_cte(k: int) -> str:
    return _QC + f""",
pr as (select q.id as qid, c.id, c.input, c.output, {_cos('q.v', 'c.v')} as score
       from qc q join qc c on c.id <> q.id),
hits as (select qid, id, input, output, score,
                (row_number() over (partition by qid order by score desc nulls last, id))::INTEGER as rk
         from pr qualify rk <= {k})"""


_VE = f"""ve as (select vec_id as id, embedding::DOUBLE[] as v from embeddings),
vp as (select q.id as qid, c.id, {_cos('q.v', 'c.v')} as score from ve q join ve c on c.id <> q.id)"""


def _vhits_cte(k: int) -> str:
    return _VE + f""",
vw as materialized (select qid, id, score,
              (row_number() over (partition by qid order by score desc nulls last, id))::INTEGER as rk
       from vp qualify rk <= {k}),
vh as (select vw.*, ve.v from vw join ve on ve.id = vw.id)"""


def _cited_sql(contexts: str) -> str:
    """The longest statement (the first of equals) of every context that has one."""
    longest = (f"list_reduce(list_prepend('', coalesce({_stmts('t')}, []::VARCHAR[])), "
               "lambda best, s2: case when length(s2) > length(best) then s2 else best end)")
    return f"list_filter(list_transform({contexts}, lambda t: {longest}), lambda t: t <> '')"


def _answer(contexts: str, question: str) -> str:
    """The stand-in answer: the question's statements, then the longest one of every context."""
    c = f"coalesce({contexts}, []::VARCHAR[])"
    cited = _cited_sql(c)
    return (f"case when len({c}) > 0 then array_to_string(list_concat({_stmts(question)}, {cited}), "
            f"{_lit(G.ANSWER_SEPARATOR)}) else '{_REFUSAL}' end")


def _rec_cte(k: int = 3) -> str:
    return _hits_cte(k) + f""",
ctx as (select qid, list(output order by rk) as contexts from hits group by qid),
rec as (select q.id as qid, q.input as question, q.output as reference,
               coalesce(ctx.contexts, []::VARCHAR[]) as contexts,
               {_answer('ctx.contexts', 'q.input')} as answer
        from qc q left join ctx on ctx.qid = q.id)"""


def _metric_ctes(src: str = "rec", sfx: str = "", keys: str = "qid") -> str:
    """CTEs ``rt{sfx}``, ``vd{sfx}``, ``mt{sfx}``: the five metrics of the records CTE ``src``."""
    tau = J.TAU
    return f"""rt{sfx} as (select *, list_distinct(flatten(list_transform(contexts, lambda c: {_tok('c')}))) as ct,
              list_distinct({_tok('reference')}) as rtk from {src}),
vd{sfx} as (select *,
         list_transform({_stmts('answer')}, lambda s: (len(list_intersect(list_distinct({_tok('s')}), ct))
                        / len(list_distinct({_tok('s')})) >= {tau})::INT) as fv,
         list_transform({_stmts('reference')}, lambda s: (len(list_intersect(list_distinct({_tok('s')}), ct))
                        / len(list_distinct({_tok('s')})) >= {tau})::INT) as rv,
         list_transform(contexts, lambda c: (case when len(rtk) = 0 then 0 else
                        (len(list_intersect(rtk, list_distinct({_tok('c')}))) / len(rtk) >= {J.RELEVANCE_TAU})::INT end))
           as pv,
         {_stmts('answer')} as gen
       from rt{sfx}),
mt{sfx} as (select {keys}, question, reference, answer,
         case when len(pv) = 0 then null when list_sum(pv) = 0 then 0.0
              else list_sum(list_transform(pv, lambda x, i: x * list_sum(list_slice(pv, 1, i)) / i))
                   / list_sum(pv) end as context_precision,
         list_avg(rv) as context_recall,
         list_avg(fv) as faithfulness,
         case when len(gen) = 0 then null when contains(answer, '{_REFUSAL}') then 0.0
              else list_avg(list_transform(gen, lambda g: {_cos(_hvec('question'), _hvec('g'))})) end
           as answer_relevancy,
         {_cos(_hvec('answer'), _hvec('reference'))} as answer_similarity
       from vd{sfx})"""


def _metrics_cte(k: int = 3) -> str:
    return _rec_cte(k) + ",\n" + _metric_ctes()


def _baseline_rec(name: str = "rec_b") -> str:
    """No-RAG records: no context, the stand-in refuses."""
    return f"""{name} as (select id as qid, input as question, output as reference, []::VARCHAR[] as contexts,
               '{_REFUSAL}' as answer from qc)"""


def _docs_cte() -> str:
    return """d as (select 'd_' || md5(text) as id, doc_id, lang, text from documents),
ex as (select distinct 'd_' || md5(text) as id from documents where doc_id in (select doc_id from labels)),
fst as (select id, doc_id, lang, text from d qualify row_number() over (partition by id order by doc_id) = 1),
ins as (select * from fst where id not in (select id from ex))"""


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["qa_pairs"] = f"with {_QA} select conv_id, turn, input, output from qa"
    s["fill_output"] = """select u.conv_id, u.turn, u.text as input, coalesce(a.text, '') as output
        from conversations u left join conversations a
          on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
        where u.role = 'user'"""
    s["positional_id"] = f"with {_QA} select 'q_' || (row_number() over (order by conv_id, turn) - 1)::VARCHAR as id, conv_id, turn from qa"
    s["prune_columns"] = f"with {_QC} select id, input from qc"
    s["rename_eval_columns"] = f"with {_rec_cte()} select qid, question, answer, reference from rec"
    s["contract_report"] = f"""with per as (select vec_id as id, count(*) as n,
            sum(case when embedding is null then 1 else 0 end) as null_vec,
            sum(case when embedding is not null and len(embedding) <> {DIM} then 1 else 0 end) as wrong_dim,
            sum(case when embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x)
                 or isinf(x))) > 0 then 1 else 0 end) as bad_elem
          from embeddings group by vec_id)
        select sum(n)::BIGINT as rows,
               coalesce(sum(case when id is null then n end), 0)::BIGINT as null_id,
               coalesce(sum(case when id is not null and n > 1 then n - 1 end), 0)::BIGINT as duplicate_id,
               coalesce(sum(wrong_dim), 0)::BIGINT as wrong_dim,
               coalesce(sum(null_vec), 0)::BIGINT as null_vector,
               coalesce(sum(bad_elem), 0)::BIGINT as bad_element
        from per"""
    s["insert_if_absent"] = f"with {_docs_cte()} select id, doc_id, lang from ins"
    s["insert_bucketed"] = s["insert_if_absent"]
    s["load_report"] = f"""with {_docs_cte()},
        per as (select id, count(*) as n from d group by id)
        select sum(n)::BIGINT as attempted, count(*)::BIGINT as distinct_ids,
               count(*) filter (where id in (select id from ex))::BIGINT as already_present,
               count(*) filter (where id not in (select id from ex))::BIGINT as inserted
        from per"""
    s["add_documents"] = f"""with {_docs_cte()},
        e as (select id, doc_id, {_hvec('text')} as v from ins)
        select id, doc_id, list_sum(v) as n_tokens, len(list_filter(v, lambda x: x > 0))::INTEGER as n_buckets,
               list_sum(list_transform(v, lambda x, i: x * i)) as weighted from e"""
    s["hash_embed"] = f"""with {_QC},
        tk as (select id, unnest({_tok('input')}) as w from qc)
        select id, (('0x' || substr(md5(w), 1, 4))::INT % {DIM})::INTEGER as bucket, count(*)::DOUBLE as n
        from tk group by all"""
    s["l2_normalise"] = f"""with ve as (select vec_id as id, embedding::DOUBLE[] as v,
              sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) as nrm from embeddings),
        u as (select id, nrm, case when nrm > 0 then list_transform(v, lambda x: x / nrm) end as uv from ve)
        select id, {_rd('nrm', 6)} as norm, {_rd('list_sum(uv)', 6)} as unit_sum,
               {_rd('sqrt(list_dot_product(uv, uv))', 6)} as unit_norm from u"""
    qv = f"""with {_QA}, qv as (select conv_id, turn, {_hvec('input')} as qv, {_hvec('output')} as av from qa)"""
    s["dot_scores"] = f"{qv} select conv_id, turn, list_dot_product(qv, av) as dot from qv"
    s["cosine_distance"] = (f"{qv} select conv_id, turn, {_rd(_cos('qv', 'av'))} as similarity, "
                            f"{_rd('1.0 - ' + _cos('qv', 'av'))} as distance from qv")
    s["vector_text_round_trip"] = """select vec_id as id, (embedding::VARCHAR)::FLOAT[] = embedding as same,
        len((embedding::VARCHAR)::FLOAT[])::INTEGER as dim from embeddings"""
    s["float32_cast"] = f"""select vec_id as id, (embedding::DOUBLE[])::FLOAT[] = embedding as same,
        {_rd('list_sum(((embedding::DOUBLE[])::FLOAT[])::DOUBLE[])', 6)} as total from embeddings"""
    s["dimension_check"] = f"""select vec_id as id, len(embedding)::INTEGER as dim,
        coalesce(len(embedding) = {DIM}, false) as ok from embeddings"""
    s["topk_single_rank"] = (f"with {_hits_cte(5)} select qid, rk as rank, id, {_rd('score')} as score, "
                             f"input as Q, output as A from hits")
    s["topk_scored"] = f"with {_hits_cte(3)} select qid, rk, id, input, output, {_rd('score')} as score from hits"
    s["topk_no_id"] = f"with {_hits_cte(3)} select qid, rk, input, output, {_rd('score')} as score from hits"
    s["topk_no_score"] = f"with {_hits_cte(4)} select qid, rk, input, output from hits"
    s["batched_topk"] = f"with {_vhits_cte(5)} select qid, rk, id, {_rd('score')} as score from vh"
    s["topk_tiles"] = s["topk_pruned"] = s["batched_topk"]
    s["topk_per_question_k"] = f"""with {_QC},
        qk as (select id as qid, case when len({_stmts('input')}) > 1 then len({_stmts('input')}) end as k from qc),
        pr as (select q.id as qid, c.id, {_cos('q.v', 'c.v')} as score from qc q join qc c on c.id <> q.id),
        hits as (select pr.*, (row_number() over (partition by qid order by score desc nulls last, id))::INTEGER as rk
                 from pr)
        select h.qid, h.rk, h.id, c.output from hits h join qk using (qid) join qc c on c.id = h.id
        where h.rk <= coalesce(qk.k, 3)"""
    s["mmr"] = _mmr_sql()
    s["contexts_joined"] = (f"with {_hits_cte(3)} select qid, array_to_string(list(output order by rk), "
                            f"{_lit(P.CONTEXT_SEPARATOR)}) as context from hits group by qid")
    s["scored_reference"] = (f"with {_hits_cte(3)} select qid, array_to_string(list(printf('[%.4f] %s → %s', "
                             f"score, input, output) order by rk), {_lit(P.REFERENCE_SEPARATOR)}) "
                             f"as reference_block from hits group by qid")
    doc = (f"printf({_lit(P.DOCUMENT_BLOCK)}, rk, coalesce(input, ''), coalesce(output, ''))")
    s["numbered_documents"] = (f"with {_hits_cte(3)} select qid, array_to_string(list({doc} order by rk), "
                               f"{_lit(P.REFERENCE_SEPARATOR)}) as documents from hits group by qid")
    s["prompt_baseline"] = f"with {_QC} select id as qid, {_fill_sql(P.BASELINE_TEMPLATE, question='input')} as prompt from qc"
    s["prompt_context"] = f"""with {_hits_cte(4)},
        cx as (select qid, array_to_string(list(output order by rk), {_lit(P.CONTEXT_SEPARATOR)}) as c
               from hits group by qid)
        select q.id as qid, {_fill_sql(P.CONTEXT_TEMPLATE, reference='cx.c', question='q.input')} as prompt
        from qc q left join cx on cx.qid = q.id"""
    s["prompt_reference"] = f"""with {_hits_cte(3)},
        rb as (select qid, array_to_string(list(printf('[%.4f] %s → %s', score, input, output) order by rk),
               {_lit(P.REFERENCE_SEPARATOR)}) as b from hits group by qid)
        select q.id as qid, {_fill_sql(P.REFERENCE_TEMPLATE, question='q.input', reference='rb.b')} as prompt
        from qc q left join rb on rb.qid = q.id"""
    s["chat_messages"] = f"""with {_hits_cte(3)},
        nd as (select qid, array_to_string(list({doc} order by rk), {_lit(P.REFERENCE_SEPARATOR)}) as d
               from hits group by qid),
        m as (select q.id as qid, {_fill_sql(P.DOCUMENTS_TEMPLATE, context='nd.d', question='q.input')} as u
              from qc q left join nd on nd.qid = q.id)
        select qid, 1::INTEGER as pos, 'system' as role, {_lit(P.SYSTEM_MESSAGE)} as content from m
        union all select qid, 2::INTEGER as pos, 'user' as role, u as content from m"""
    gdoc = f"printf({_lit(P.DOCUMENT_BLOCK)}, 1, coalesce(p.input, ''), coalesce(p.output, ''))"
    s["context_route"] = f"""with {_hits_cte(4)},
        g as (select q.id as qid, {gdoc} as gd from qc q join qc p on p.conv_id = q.conv_id and p.turn = q.turn - 2),
        r as (select qid, array_to_string(list(output order by rk), {_lit(P.CONTEXT_SEPARATOR)}) as rc
              from hits group by qid)
        select q.id as qid,
               case when coalesce(length(g.gd) > 0, false) then 'given'
                    when r.rc is not null then 'retrieved' else 'none' end as source,
               case when coalesce(length(g.gd) > 0, false) then g.gd else r.rc end as context
        from qc q left join g on g.qid = q.id left join r on r.qid = q.id"""
    s["answer_routed"] = _answer_routed_sql()
    s["refusal_flag"] = f"""with {_rec_cte()}
        select 'rag' as run_id, qid, contains(answer, '{_REFUSAL}') as refusal from rec
        union all select 'baseline' as run_id, id as qid, true as refusal from qc"""
    s["generate_stand_in"] = f"with {_rec_cte()} select qid, answer from rec"
    s["eval_records"] = (f"with {_rec_cte()} select qid, question, reference, len(contexts)::INTEGER as n_contexts, "
                         f"array_to_string(contexts, {_lit(P.CONTEXT_SEPARATOR)}) as context, answer from rec")
    for m in ("answer_similarity", "context_precision", "context_recall", "faithfulness", "answer_relevancy"):
        s[m] = f"with {_metrics_cte()} select qid, {_rd(m, 6)} as {m} from mt"
    s["score_table"] = (f"with {_metrics_cte()} select qid, " +
                        ", ".join(f"{_rd(m, 3)} as {m}" for m in M.METRICS) + " from mt")
    s["run_summary"] = _run_summary_sql()
    s["run_compare"] = _run_compare_sql()
    s["model_compare"] = _model_compare_sql()
    s["stream_topk"] = s["batched_topk"]
    s["stream_ingest"] = f"""with {_docs_cte()},
        lab as (select id, doc_id, lang from d where doc_id in (select doc_id from labels)
                qualify row_number() over (partition by id order by doc_id) = 1)
        select id, doc_id, lang from lab union all select id, doc_id, lang from ins"""
    s["stream_ingest_keyed"] = f"with {_docs_cte()} select id, doc_id, lang from ins"
    s["raw_corpus_array"] = f"with {_QA} select input, output from qa"
    s["raw_corpus_json"] = f"with {_QA} select input, output from qa"
    s["embedded_corpus_json"] = f"""select vec_id::VARCHAR as id, 'in' as input, 'out' as output,
        len(embedding)::INTEGER as dim, {_rd('list_sum(embedding::DOUBLE[])', 5)} as total from embeddings"""
    s["eval_set_json"] = f"with {_QA} select input as question, output as reference from qa"
    s["answer_sheet_csv"] = (f"with {_rec_cte()} select nullif(question, '') as question, "
                             f"nullif(answer, '') as answer, nullif(reference, '') as reference from rec")
    s["answer_sheet_split"] = s["answer_sheet_csv"]
    summary = """list_sum(v) as n_tokens, len(list_filter(v, lambda x: x > 0))::INTEGER as n_buckets,
               list_sum(list_transform(v, lambda x, i: x * i)) as weighted"""
    s["embed_model"] = f"""with {_QA}, e as (select conv_id, turn, {_hvec('input')} as v from qa)
        select conv_id, turn, {summary} from e"""
    s["embed_distinct"] = f"""with e as (select conv_id, turn, case when text is not null then {_hvec('text')} end as v
               from conversations) select conv_id, turn, {summary} from e"""
    s["embed_cached"] = s["embed_distinct"]
    long = f"length(prompt) > {SI.ShortPrompts.limit}"
    s["generate_errors"] = f"""with {_QC},
        p as (select id as qid, {_fill_sql(P.BASELINE_TEMPLATE, question='input')} as prompt from qc)
        select qid, case when {long} then {_lit(P.ERROR_PREFIX)} || 'prompt too long'
                    else left(prompt, 5) || '|' || right(prompt, 9) end as answer,
               case when {long} then 'prompt too long' end as error from p"""
    s["generate_resumable"] = s["generate_errors"]
    many = f"len({_stmts('answer')}) > {SI.StrictJudge.limit}"
    s["judge_errors"] = (f"with {_metrics_cte()} select qid, case when {many} then 'too many statements' end as error, "
                         + ", ".join(f"case when not {many} then {_rd(m, 6)} end as {m}" for m in M.METRICS) + " from mt")
    return s


def _fill_sql(template: str, **slots: str) -> str:
    out = []
    for kind, v in P.template_parts(template):
        out.append(_lit(v) if kind == "lit" else f"coalesce({slots[v]}, '')")
    return "(" + " || ".join(out) + ")"


def _mmr_steps(k: int, lam: float) -> str:
    """Greedy MMR unrolled into k steps over a candidate CTE ``c(qid, id, v, score, rk)``."""
    parts = [f"""g as materialized (select x.qid, x.rk, y.rk as rk2, {_cos('x.v', 'y.v')} as sim
                   from c x join c y on x.qid = y.qid),
s1 as (select qid, rk, 1 as pos from c where rk = 1)"""]
    for step in range(2, k + 1):
        prev = f"s{step - 1}"
        parts.append(f"""p{step} as materialized (select qid, rk, {step} as pos from (
      select c.qid, c.rk, row_number() over (partition by c.qid
             order by round({lam} * any_value(c.score) - {1 - lam} * max(g.sim), 9) desc, c.rk) as o
      from c join g on g.qid = c.qid and g.rk = c.rk join {prev} sp on sp.qid = c.qid and sp.rk = g.rk2
      where not exists (select 1 from {prev} z where z.qid = c.qid and z.rk = c.rk)
      group by c.qid, c.rk) where o = 1),
s{step} as materialized (select * from {prev} union all select * from p{step})""")
    return ",\n".join(parts)


def _mmr_sql(k: int = MMR.MMR_K, fetch_k: int = MMR.MMR_FETCH_K, lam: float = MMR.MMR_LAMBDA) -> str:
    """MMR on ``embeddings``: each question's top ``fetch_k`` as lists in rank order, one list expression per pick."""
    steps, picks = ["s1 as (select *, 1::BIGINT as p1 from c)"], ["p1"]
    for step in range(2, k + 1):
        near = ", ".join(_cos("vs[i]", f"vs[{p}]") for p in picks)
        steps.append(f"""o{step} as (select *, list_transform(range(1, len(ids) + 1), lambda i: case when i in ({', '.join(picks)})
             then null else round({lam} * sc[i] - {1 - lam} * greatest({near}), 9) end) as o from s{step - 1}),
s{step} as (select * exclude (o), list_position(o, list_max(o)) as p{step} from o{step})""")
        picks.append(f"p{step}")
    return (f"with {_vhits_cte(fetch_k)},\nc as (select qid, list(id order by rk) as ids, list(v order by rk) as vs, "
            f"list(score order by rk) as sc from vh group by qid),\n" + ",\n".join(steps) + "\n"
            + " union all ".join(f"select qid, {i + 1}::INTEGER as pos, ids[{p}] as id from s{k} where {p} is not null"
                                 for i, p in enumerate(picks)))


def _answer_routed_sql(k: int = MMR.MMR_K, fetch_k: int = MMR.MMR_FETCH_K,
                       lam: float = MMR.MMR_LAMBDA) -> str:
    doc = f"printf({_lit(P.DOCUMENT_BLOCK)}, 1, coalesce(p.input, ''), coalesce(p.output, ''))"
    given = "coalesce(length(gv.gd) > 0, false)"
    return f"""with {_QC},
gv as (select q.id as qid, {doc} as gd, p.output as gfirst
       from qc q join qc p on p.conv_id = q.conv_id and p.turn = q.turn - 2),
tp as (select q.id as qid, c.id, c.v, c.input, c.output, {_cos('q.v', 'c.v')} as score
       from qc q join qc c on c.id <> q.id where q.id not in (select qid from gv)),
c as materialized (select *, (row_number() over (partition by qid order by score desc nulls last, id))::INTEGER
                          as rk from tp qualify rk <= {fetch_k}),
{_mmr_steps(k, lam)},
mm as (select s.qid, s.pos, c.input, c.output from s{k} s join c using (qid, rk)),
ret as (select qid, array_to_string(list(input order by pos), {_lit(PA.CONTEXT_JOIN)}) as rt,
               arg_min(output, pos) as first_out from mm group by qid)
select q.id as qid,
       case when {given} then 'given' else 'retrieved' end as source,
       case when {given} then {_fill_sql(P.DOCUMENTS_TEMPLATE, context='gv.gd', question='q.input')}
            else {_fill_sql(P.CHAIN_TEMPLATE, context='ret.rt', question='q.input')} end as prompt,
       coalesce(case when {given} then gv.gfirst else ret.first_out end, '{_REFUSAL}') as answer
from qc q left join gv on gv.qid = q.id left join ret on ret.qid = q.id"""


def _run_summary_sql() -> str:
    ks = R.SWEEP_KS
    return f"""with {_hits_cte(max(ks))},
runs as (select unnest([{', '.join(str(k) for k in ks)}]) as kk),
ctx as (select 'k=' || kk::VARCHAR as run_id, qid, list(output order by rk) as contexts
        from hits join runs on hits.rk <= runs.kk group by all),
rec as (select 'k=' || kk::VARCHAR as run_id, q.id as qid, q.input as question, q.output as reference,
               coalesce(ctx.contexts, []::VARCHAR[]) as contexts,
               {_answer('ctx.contexts', 'q.input')} as answer
        from qc q join runs on true left join ctx on ctx.qid = q.id and ctx.run_id = 'k=' || kk::VARCHAR
        union all
        select 'baseline' as run_id, id as qid, input as question, output as reference,
               []::VARCHAR[] as contexts, '{_REFUSAL}' as answer from qc),
{_metric_ctes(keys="run_id, qid")}
select run_id, count(*)::BIGINT as questions, """ + ", ".join(
        f"{_rd(f'avg({m})', 6)} as {m}" for m in M.METRICS) + f""",
       {_rd(f"avg(contains(answer, '{_REFUSAL}')::DOUBLE)", 6)} as refusal_rate
from mt group by run_id"""


def _model_compare_sql() -> str:
    said, cited = f"coalesce({_stmts('r.question')}, []::VARCHAR[])", _cited_sql("r.contexts")
    answers = {"full": f"list_concat({said}, {cited})", "cited": cited, "brief": f"({cited})[1:1]"}
    records = "\n        union all ".join(
        f"""select '{name}/' || r.run as run_id, r.qid, r.question, r.reference, r.contexts,
               case when len(r.contexts) > 0 then array_to_string({said_}, {_lit(G.ANSWER_SEPARATOR)}) else '{_REFUSAL}' end
               as answer from asked r""" for name, said_ in answers.items())
    weight = " + ".join(f"(u >= {step})::INTEGER" for step in MR.POISSON_STEPS)
    long = (f"select run_id, qid, unnest({list(M.METRICS)}) as metric, "
            f"unnest([{', '.join(f'{m}::DOUBLE' for m in M.METRICS)}]) as v from mt")
    return f"""with {_hits_cte(max(MODEL_KS))},
runs as (select unnest([{', '.join(str(k) for k in MODEL_KS)}]) as kk),
ctx as (select kk, qid, list(output order by rk) as contexts from hits join runs on hits.rk <= runs.kk group by all),
asked as (select 'k=' || runs.kk::VARCHAR as run, q.id as qid, q.input as question, q.output as reference,
                 coalesce(ctx.contexts, []::VARCHAR[]) as contexts
          from qc q join runs on true left join ctx on ctx.qid = q.id and ctx.kk = runs.kk
          union all select 'baseline' as run, id as qid, input as question, output as reference, []::VARCHAR[] as contexts from qc),
rec as ({records}),
{_metric_ctes(keys="run_id, qid")},
long as materialized (select * from ({long}) where v is not null),
pairs as materialized (select l.run_id, l.metric, l.qid, l.v, b.v as b from long l join long b on b.qid = l.qid and b.metric = l.metric
          and b.run_id = '{MODEL_BASE}' where l.run_id <> '{MODEL_BASE}'),
means as (select run_id, metric, count(*) as questions, avg(v) as mean_run, avg(b) as mean_base from pairs group by all),
drawn as (select qid, rep, {weight} as w from (
            select qid, rep, ('0x' || substr(md5(qid::VARCHAR || ':' || rep::VARCHAR), 1, 8))::BIGINT as u
            from (select distinct qid from pairs), unnest(range({MR.REPLICATES})) as t(rep))),
deltas as (select run_id, metric, rep, sum(w * (v - b)) / sum(w) as delta from pairs join drawn using (qid)
           where w > 0 group by all),
ends as (select run_id, metric, quantile_cont(delta, {MR.INTERVAL[0]}) as low, quantile_cont(delta, {MR.INTERVAL[1]}) as high
         from deltas group by all)
select run_id, metric, questions, {_rd('mean_run', 6)} as mean_run, {_rd('mean_base', 6)} as mean_base,
       {_rd('mean_run - mean_base', 6)} as delta, {_rd('low', 6)} as low, {_rd('high', 6)} as high
from means left join ends using (run_id, metric)"""


def _run_compare_sql() -> str:
    return f"""with {_rec_cte()},
{_baseline_rec()},
{_metric_ctes()},
{_metric_ctes("rec_b", "_b")}
select coalesce(a.qid, b.qid) as qid, {_rd('a.answer_similarity', 6)} as answer_similarity_a,
       {_rd('b.answer_similarity', 6)} as answer_similarity_b,
       {_rd('a.answer_similarity - b.answer_similarity', 6)} as delta
from mt a full join mt_b b on a.qid = b.qid"""


def oracle_sql() -> dict[str, str]:
    return {**_sql(), **_llm()[1]}


if __name__ == "__main__":  # pragma: no cover - manual smoke run
    from ragloom.session import build_session
    spark = build_session()
    entry(spark).show(5, truncate=60)
    print(os.getcwd())
