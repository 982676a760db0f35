"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label; the labels of neighbouring words are tied
by learned transitions, so a stretch in another language (code switching) is
labelled as such. Emission scores are sums of learned weights of affix,
character n-gram and lexicon features; forward-backward gives each word's
posterior over the languages. A document's prediction is the language with
the largest share of its words (mean posterior), and that share is its score.

Training (driver, numpy) uses a bounded sample of labelled rows: up to
``TRAIN_DOCS`` documents per language and ``TRAIN_WORDS`` words of each,
chosen by hash. Half of the chains join stretches of two documents in
different languages, which is what the transitions learn switching from. The
likelihood and its gradient are exact (forward-backward), the optimiser is
Adam over full batches.

A run of more than ``PIECE`` letters (unsegmented scripts, text without blanks)
is several consecutive words of at most so many letters, all of which count.

Prediction is a ``mapInArrow`` over whole texts, without a shuffle. Chains
restart every ``CHAIN`` words, so that memory is bounded for very long texts.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
without any labelled row every document is ``und``; ties go to the first
language in alphabetical order; repeated rows are judged one by one; extra
columns pass through, and columns named like an output are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_documents

UNDETERMINED = "und"
TRAIN_DOCS = 500
TRAIN_WORDS = 120
LEXICON = 2000
BUCKETS = 1 << 16
CHAIN = 128
#: Longest word in letters; a longer run of letters is cut into words of this length.
PIECE = 40
EPOCHS = 40
RATE = 0.1
DECAY = 1e-5
SLICE_ROWS = 64
#: Words whose features are hashed at once.
WORDS_AT_ONCE = 8192
#: Words whose scores a worker keeps (workers outlive their tasks, so later stages live beside this memory).
MEMO_WORDS = 100_000
#: Hashes of training documents that are broadcast to find their texts (24 bytes and the language each).
MAX_BROADCAST_PICKS = 500_000
#: Pipeline: a document is rejected if no language has this share of its words.
MIN_SCORE = 0.3
WORD = re.compile(r"[^\W\d_]+")


def _letters(run: str) -> list[str]:
    """Runs of letters in a run of letters and other numbers (fractions, circled digits, Roman numerals)."""
    return "".join(c if c.isalpha() else " " for c in run).split()


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; a run of more than ``PIECE`` letters in consecutive pieces."""
    runs = WORD.findall((text or "").lower())
    return [run[i:i + PIECE] for found in runs for run in ([found] if found.isalpha() else _letters(found))
            for i in range(0, len(run), PIECE)]


class Features:
    """Feature indices of a word: affixes, n-grams, lexicon; hashed into ``BUCKETS``."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon

    def of(self, word: str) -> list[int]:
        w = f"<{word}>"
        names = [w[i:i + 2] for i in range(len(w) - 1)] + [w[i:i + 3] for i in range(len(w) - 2)]
        names += ["p" + w[1:4], "s" + w[-4:-1], "s" + w[-5:-1]]
        known = self.lexicon.get(word)
        if known is not None:
            names += [f"l={known}", "w" + word]
        return [zlib.crc32(n.encode()) % BUCKETS for n in names]


    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``of`` of many words at once: all indices in a row, and the number of each word's."""
        data = np.frombuffer("".join([f"<{w}>" for w in words]).encode(), np.uint8)
        # byte offsets of the characters, and characters (with < and >) of each word
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        n = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(n) - n
        known = [(i, w) for i, w in enumerate(words) if w in self.lexicon]
        sizes = 2 * n
        sizes[[i for i, _ in known]] += 2
        to = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)

        def put(where, lo, hi, state=_EMPTY):
            out[where] = _crc32(data, at[lo], at[hi], state)

        for width, before in ((2, 0), (3, n - 1)):
            grams = n - width + 1
            nth = np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
            lo = np.repeat(first, grams) + nth
            put(np.repeat(to + before, grams) + nth, lo, lo + width)
        end, rest = first + n, to + 2 * n - 3
        put(rest, first + 1, np.minimum(first + 4, end), _AFTER_P)
        put(rest + 1, np.maximum(first, end - 4), end - 1, _AFTER_S)
        put(rest + 2, np.maximum(first, end - 5), end - 1, _AFTER_S)
        for i, w in known:
            out[rest[i] + 3:rest[i] + 5] = [zlib.crc32(f"l={self.lexicon[w]}".encode()), zlib.crc32(f"w{w}".encode())]
        return out % BUCKETS, sizes


def _crc32_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC32 = _crc32_table()
_EMPTY = np.uint32(0xFFFFFFFF)


def _crc32(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: np.uint32) -> np.ndarray:
    """``zlib.crc32`` of many short stretches of bytes that go on from the state behind a common start."""
    crc = np.full(len(lo), state, np.uint32)
    live, j = np.arange(len(lo)), 0
    while len(live):
        if j:
            more = lo[live] + j < hi[live]
            live = live if more.all() else live[more]
        if len(live) == len(crc):
            crc = _CRC32[(crc ^ data[lo + j]) & 0xFF] ^ (crc >> 8)
        elif len(live):
            own = crc[live]
            crc[live] = _CRC32[(own ^ data[lo[live] + j]) & 0xFF] ^ (own >> 8)
        j += 1
    return ~crc


_AFTER_P, _AFTER_S = (~np.uint32(zlib.crc32(c)) for c in (b"p", b"s"))


def emissions(weights: np.ndarray, features: Features, words: list[str]) -> np.ndarray:
    """Sum of the weights of each word's features."""
    flat, sizes = features.flat(words)
    return np.add.reduceat(weights[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)


def forward_backward(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: np.ndarray, sums: bool = True):
    """Posteriors ``(chains, steps, labels)``, summed transition posteriors and log-likelihood terms.
    Without ``sums``, which only learning needs, the last two are left out.

    ``scores`` are emission scores, ``mask`` marks the words (a prefix of each chain).
    Beside the scores two arrays of their size are held: the posteriors take the place of ``alpha``.
    """
    n, steps, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e = scores - top
    np.exp(e, out=e)
    del scores
    move, first = np.exp(trans), np.exp(start)
    alpha, norm = np.empty_like(e), np.ones((n, steps))
    for t in range(steps):
        a = first * e[:, 0] if t == 0 else (alpha[:, t - 1] @ move) * e[:, t]
        s = a.sum(axis=1)
        live = mask[:, t]
        norm[:, t] = np.where(live, s, 1.0)
        alpha[:, t] = np.where(live[:, None], a / s[:, None], alpha[:, t - 1] if t else 1.0 / k)
    beta, post = np.ones((n, k)), alpha
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        b = beta * e[:, t + 1] / norm[:, t + 1, None]
        live = mask[:, t + 1]
        beta = np.where(live[:, None], b @ move.T, 1.0)
        if sums:
            pairs += move * (alpha[live, t].T @ b[live])
        post[:, t] *= beta
    post /= post.sum(axis=2, keepdims=True)
    post *= mask[:, :, None]
    log_z = (np.log(norm) + top[:, :, 0] * mask).sum() if sums else None
    return post, pairs, log_z


def train(samples: list[tuple[str, list[str]]]) -> dict | None:
    """Fit the model to ``(language, words)`` rows; None without rows."""
    samples = sorted((lang, words) for lang, words in samples if words)
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    k, number = len(langs), {lang: i for i, lang in enumerate(langs)}
    counts = [Counter() for _ in langs]
    for lang, words in samples:
        counts[number[lang]].update(words)
    lexicon: dict[str, int] = {}
    for i, c in enumerate(counts):
        for word, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n >= 3 and n >= 0.8 * sum(other[word] for other in counts):
                lexicon[word] = i
    # chains: stretches of one document, and of two in different languages
    half = CHAIN // 2
    stretches = [(number[lang], words[i:i + half]) for lang, words in samples for i in range(0, len(words), half)]
    order = np.random.default_rng(7).permutation(len(stretches))
    chains, labels = [], []
    for a, b in zip(order[::2], [*order[1::2], order[0]], strict=False):
        (la, wa), (lb, wb) = stretches[a], stretches[b]
        if la == lb:
            chains += [wa, wb]
            labels += [[la] * len(wa), [lb] * len(wb)]
        else:
            chains.append(wa + wb)
            labels.append([la] * len(wa) + [lb] * len(wb))
    types = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(chains)))}
    feats, names = Features(lexicon), list(types)
    # pieces of the types bound what hashing and summing hold beside the features
    pieces = [slice(lo, lo + WORDS_AT_ONCE) for lo in range(0, len(names), WORDS_AT_ONCE)]
    flat, sizes = zip(*(feats.flat(names[p]) for p in pieces), strict=True)
    sizes = np.concatenate(sizes)
    used = np.unique(np.concatenate([np.unique(f) for f in flat]))
    compact = np.concatenate([np.searchsorted(used, f) for f in flat])
    del flat
    owner = np.repeat(np.arange(len(names), dtype=np.int32), sizes)
    first = np.cumsum(sizes) - sizes
    steps = max(map(len, chains))
    ids, gold, mask = (np.zeros((len(chains), steps), t) for t in (np.int64, np.int64, bool))
    for i, (c, y) in enumerate(zip(chains, labels, strict=True)):
        ids[i, :len(c)], gold[i, :len(c)], mask[i, :len(c)] = [types[w] for w in c], y, True
    gold_pairs = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    gold_start = np.bincount(gold[:, 0], minlength=k)
    params = {"w": np.zeros((len(used), k)), "trans": np.zeros((k, k)), "start": np.zeros(k)}
    moment = {n: (np.zeros_like(p), np.zeros_like(p)) for n, p in params.items()}
    scale = 1.0 / mask.sum()
    word_ids, word_gold = ids[mask], gold[mask]
    by_type = np.empty((len(names), k))
    for epoch in range(1, EPOCHS + 1):
        for p in pieces:
            own = first[p]
            features = compact[own[0]:own[-1] + sizes[p][-1]]
            by_type[p] = np.add.reduceat(params["w"][features], own - own[0], axis=0)
        post, pairs, _ = forward_backward(by_type[ids], mask, params["trans"], params["start"])
        off = post[mask]
        off[np.arange(len(off)), word_gold] -= 1
        per_type = np.stack([np.bincount(word_ids, off[:, j], len(types)) for j in range(k)], axis=1)
        per_feature = np.stack([np.bincount(compact, per_type[owner, j], len(used)) for j in range(k)], axis=1)
        grads = {"w": per_feature * scale + DECAY * params["w"], "trans": (pairs - gold_pairs) * scale,
                 "start": (post[:, 0].sum(axis=0) - gold_start) * scale}
        del post, off
        for n, g in grads.items():
            m, v = moment[n]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            params[n] -= RATE * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.99 ** epoch)) + 1e-9)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = params["w"]
    return {"langs": langs, "weights": weights, "trans": params["trans"], "start": params["start"],
            "lexicon": lexicon}


class Labeller:
    """Applies a model to batches of texts; keeps a bounded memo of word scores."""

    def __init__(self, model: dict):
        self.model, self.features = model, Features(model["lexicon"])
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 16, len(self.model["langs"])), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > MEMO_WORDS:
            self._clear()
        rows = self.rows
        missing = [w for w in dict.fromkeys(words) if w not in rows]
        if missing:
            first, need = len(rows), len(rows) + len(missing)
            while need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for lo in range(0, len(missing), WORDS_AT_ONCE):
                part = missing[lo:lo + WORDS_AT_ONCE]
                self.table[first + lo:first + lo + len(part)] = emissions(self.model["weights"], self.features, part)
            rows.update(zip(missing, range(first, need), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def word_posteriors(self, words: list[str]) -> np.ndarray:
        """Posterior of every word; the words form one text."""
        return self.posteriors([words])[0]

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        ids = self._ids(list(chain.from_iterable(texts)))
        sizes = np.array([len(t) for t in texts], np.int64)
        # cut every text into chains of CHAIN words
        starts, lengths, base = [], [], 0
        for n in sizes:
            for lo in range(0, n, CHAIN):
                starts.append(base + lo)
                lengths.append(min(CHAIN, n - lo))
            base += n
        if not starts:
            return [np.zeros((0, self.table.shape[1])) for _ in texts]
        starts, lengths = np.array(starts), np.array(lengths)
        out = np.empty((len(ids), self.table.shape[1]))
        order = np.argsort(lengths, kind="stable")
        for lo in range(0, len(order), 2048):
            own = order[lo:lo + 2048]
            steps = np.arange(lengths[own].max())
            mask = steps < lengths[own][:, None]
            at = np.where(mask, starts[own][:, None] + steps, 0)
            post, _, _ = forward_backward(self.table[ids[at]].astype(float), mask, self.model["trans"],
                                          self.model["start"], sums=False)
            out[at[mask]] = post[mask]
        return np.split(out, np.cumsum(sizes)[:-1])


_LABELLER: list[Labeller] = []


def _labeller(model: dict | None) -> Labeller | None:
    """One labeller per worker process and model."""
    if model is None:
        return None
    if not _LABELLER or _LABELLER[0].model is not model:
        _LABELLER[:] = [Labeller(model)]
    return _LABELLER[0]


def training_rows(labelled: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang",
                  docs_per_language: int = TRAIN_DOCS, words_per_doc: int = TRAIN_WORDS):
    """A bounded sample of ``(language, words)``: per language the documents with the smallest hash of ``key``."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key).alias("h"),
                F.xxhash64(text_col).alias("t"))
    # only hashes are ranked (a bounded number of each task); the texts picked stay in place until they are cut
    pick = rows.select("lang", "h", "t").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))) \
        .where(F.col("rn") <= docs_per_language).select("lang", "h", "t").distinct()
    if pick.count() <= MAX_BROADCAST_PICKS:
        pick = F.broadcast(pick)

    def cut(batches):
        for batch in batches:
            out = []
            for lang, text, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                at = h % max(1, len(words) - words_per_doc + 1)
                out.append((lang, h, t, words[at:at + words_per_doc]))
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([r[0] for r in out], pa.string()), "h": pa.array([r[1] for r in out], pa.int64()),
                "t": pa.array([r[2] for r in out], pa.int64()), "words": pa.array([r[3] for r in out], pa.list_(pa.string()))})

    found = rows.join(pick, ["lang", "h", "t"], "left_semi").select("lang", "text", "h", "t") \
        .mapInArrow(cut, "lang string, h long, t long, words array<string>")
    # repeated rows count once
    once = found.groupBy("lang", "h", "t").agg(F.any_value("words").alias("words")).orderBy("lang", "h", "t")
    return [(r["lang"], r["words"]) for r in once.collect()]


def identify(df: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``languages`` (share of the words by language)."""
    outputs = [("lang_pred", T.StringType()), ("score", T.DoubleType()),
               ("languages", T.MapType(T.StringType(), T.DoubleType()))]
    kept = [f for f in df.schema.fields if f.name.lower() not in {n for n, _ in outputs}]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in outputs])
    src = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text_col).alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = _labeller(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                pred, score, shares = [], [], []
                texts = [words_of(t) for t in part.column(part.num_columns - 1).to_pylist()]
                posts = labeller.posteriors(texts) if labeller else [()] * len(texts)
                for post in posts:
                    if not len(post):
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                        shares.append([])
                        continue
                    mean, langs = post.mean(axis=0), labeller.model["langs"]
                    best = int(np.argmax(mean))
                    pred.append(langs[best])
                    score.append(float(min(1.0, mean[best])))
                    shares.append(list(zip(langs, map(float, mean), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=schema.names)

    return src.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model of this operator learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> dict | None:
    """A model from the labelled documents that are not held out."""
    learn = docs.where(~held_out() & F.col("doc_id").isNotNull())
    return train(training_rows(learn, F.col("doc_id")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = read_documents(spark, sf_dir)
    model = fit(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model) \
        .select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents without letters and those where no language reaches ``MIN_SCORE``."""
    found = identify(docs.withColumn("__body", F.col("text")), fit(docs.select("doc_id", "text", "lang")),
                     text_col="__body")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)
