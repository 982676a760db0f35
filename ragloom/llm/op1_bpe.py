"""BPE encoding and decoding by per-prefix dynamic programming.

For a pre-token of n bytes the encoder stores, for each prefix, the unique
last token of the BPE encoding of that prefix. An automaton over the
vocabulary reports all tokens that end at a position (the suffix matches of
the prefix); a token t is the last one exactly if it is a token that BPE can
make and the pair (last token of what is left before t, t) is compatible,
that is, no merge crosses their border earlier than the merges inside them.
Following the back-pointers from the end emits the exact ids. Work is linear
in the text times the matches per position; no merge loop runs.

Interface
---------
``encode(df, spec, text_col)`` adds ``ids array<int>`` (and the decoded text
of these ids with ``decoded_col``); ``decode(df, spec, ids_col)`` adds the
text of an id array. Both run as ``mapInArrow`` over whole texts: no shuffle,
tasks are independent and can be repeated after a lost executor. The
vocabulary (bounded: one file) is read once by the driver and broadcast.

Defined cases: null text counts as empty (no ids, empty decoded text); null
id arrays decode to null; repeated rows and ties are independent rows; extra
columns pass through, a column with the name of an output is replaced; very
long pre-tokens are never cut (they only bypass the word cache).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_documents

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.json"
CACHE_WORDS = 250_000
CACHE_CHARS = 64
SLICE_ROWS = 64


def byte_alphabet() -> list[str]:
    """The printable stand-in character of each byte, by the byte-level rule."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in set(keep):
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class _PairMemo(dict):
    """``left << 20 | right`` -> whether the two tokens fit; bounded."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, key: int) -> bool:
        if len(self) > 1_000_000:
            self.clear()
        got = self[key] = self.model.fits(key >> 20, key & 0xFFFFF)
        return got


class _Generations(dict):
    """Bounded memo of a function of a string: two generations, the older one is dropped when full."""

    def __init__(self, fn, size: int):
        super().__init__()
        self.fn, self.size, self.old = fn, size, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.fn(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class BpeModel:
    """Tables of one byte-level BPE vocabulary and the prefix encoder."""

    def __init__(self, spec: str):
        import regex
        data = json.loads(spec)
        model = data["model"]
        if data.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in data["added_tokens"])], default=-1) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in text)
        self.special: dict[str, int] = {}
        for t in data["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens with stripping are not supported")
            self.special[t["content"]] = t["id"]
            self.token_bytes[t["id"]] = t["content"].encode()
        #: pair of ids -> rank of the merge; the parts of each made token
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            made = vocab[a + b]
            if made in self.parts:
                raise ValueError("a token is made by two merges")
            self.pair_rank[vocab[a], vocab[b]] = rank
            self.parts[made] = (vocab[a], vocab[b], rank)
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._fits = _PairMemo(self)
        stable: dict[int, bool] = {}
        for i in sorted(vocab.values(), key=lambda i: len(self.token_bytes[i])):
            if i in self.special.values():
                continue
            if i in self.parts:
                a, b, _ = self.parts[i]
                stable[i] = stable[a] and stable[b] and not self._crosses(a, b)
            else:
                stable[i] = len(self.token_bytes[i]) == 1
        self.length = [len(t) for t in self.token_bytes]
        self._build_machine([i for i, ok in stable.items() if ok])
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.special_split = regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = _Generations(self.encode_word, CACHE_WORDS)
        self.chunks = _Generations(self._encode_chunk, CACHE_WORDS)
        self.after_blank = _Generations(lambda part: self._encode_chunk(" " + part), CACHE_WORDS)
        self.two_blanks = re.compile(r"\s\s").search

    def _build_machine(self, tokens: list[int]) -> None:
        """Automaton over the tokens: per state its longest token suffix, per token the next shorter one."""
        step: dict[int, int] = {}
        names, depth_order, ends = 1, [], {}
        for i in tokens:
            state = 0
            for c in self.token_bytes[i]:
                key = state << 8 | c
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = names
                    names += 1
                    depth_order.append((len(depth_order), state, c, nxt))
                state = nxt
            ends[state] = i
        children: dict[int, list[tuple[int, int]]] = {}
        for _, parent, c, child in depth_order:
            children.setdefault(parent, []).append((c, child))
        fail, longest, self.shorter = [0] * names, [-1] * names, [-1] * len(self.token_bytes)
        level = [0]
        while level:
            following = []
            for state in level:
                for c, child in children.get(state, ()):
                    back = fail[state]
                    if state:
                        while back and (back << 8 | c) not in step:
                            back = fail[back]
                        back = step.get(back << 8 | c, 0)
                    fail[child] = back
                    longest[child] = longest[back]
                    if child in ends:
                        self.shorter[ends[child]] = longest[back]
                        longest[child] = ends[child]
                    following.append(child)
            level = following
        self.step, self.fail, self.longest = step, fail, longest

    def _go(self, state: int, c: int) -> int:
        """Transition by failure links; the result is kept."""
        at, step = state, self.step
        while at and (at << 8 | c) not in step:
            at = self.fail[at]
        got = step.get(at << 8 | c, 0)
        if len(step) < 2_000_000:
            step[state << 8 | c] = got
        return got

    # -- pair compatibility ------------------------------------------------

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge of ``token`` over time, with the rank of the merge that ends each."""
        memo = self._right if side else self._left
        got = memo.get(token)
        if got is None:
            got, at, ends = [], token, float("inf")
            while True:
                got.append((at, ends))
                if at not in self.parts:
                    break
                ends = self.parts[at][2]
                at = self.parts[at][side]
            got.reverse()
            memo[token] = got
        return got

    def _crosses(self, a: int, b: int) -> bool:
        """Whether a merge joins an edge of a with an edge of b before both are complete."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while i < len(left) - 1 or j < len(right) - 1:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.pair_rank.get((x, y))
            # among equal ranks the leftmost pair merges first: inside a, then across, then inside b
            if rank is not None and rank < x_ends and rank <= y_ends:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        return False

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE keeps a and b as neighbouring tokens of the joined text."""
        return (a, b) not in self.pair_rank and not self._crosses(a, b)

    # -- encoding ----------------------------------------------------------

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: the last token of each prefix, then back-pointers."""
        state, last = 0, [-1]
        step, longest, shorter, length, fits = self.step, self.longest, self.shorter, self.length, self._fits
        for at, c in enumerate(word.encode(), 1):
            got = step.get(state << 8 | c)
            state = self._go(state, c) if got is None else got
            token = longest[state]
            while token >= 0:
                size = length[token]
                if size == at or fits[last[at - size] << 20 | token]:
                    break
                token = shorter[token]
            else:
                raise ValueError(f"no token for a byte of {word[:40]!r}")
            last.append(token)
        out, at = [], len(last) - 1
        while at:
            token = last[at]
            out.append(token)
            at -= length[token]
        out.reverse()
        return tuple(out)

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.split(chunk))))

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        A blank between two characters that are not white space always starts
        a pre-token, so the text is dealt into chunks there; other blanks stay
        inside a chunk.
        """
        if not self.two_blanks(text):
            first, *rest = text.split(" ")
            return [*self.chunks[first], *chain.from_iterable(map(self.after_blank.__getitem__, rest))]
        chunks, held = [], ""
        for i, part in enumerate(text.split(" ")):
            if i == 0:
                held = part
            elif held and part and not held[-1].isspace() and not part[0].isspace():
                chunks.append(held)
                held = " " + part
            else:
                held += " " + part
        chunks.append(held)
        return list(chain.from_iterable(map(self.chunks.__getitem__, chunks)))

    def encode(self, text: str) -> list[int]:
        if not self.special_split or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self._plain(part))
        return out

    def decode(self, ids) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", errors="replace")


_MODELS: dict[str, BpeModel] = {}


def _model(spec) -> BpeModel:
    """One model per worker process and vocabulary."""
    if spec.value not in _MODELS:
        _MODELS.clear()
        _MODELS[spec.value] = BpeModel(spec.value)
    return _MODELS[spec.value]


@dataclass
class Vocabulary:
    """A tokenizer file read by the driver and broadcast (bounded by the file)."""
    broadcast: object

    @staticmethod
    def load(spark: SparkSession, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as fh:
            return Vocabulary(spark.sparkContext.broadcast(fh.read()))


def _with(schema: T.StructType, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n.lower() for n, _ in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names]
                        + [T.StructField(n, t) for n, t in fields])


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """Add the exact ids of ``text_col``; with ``decoded_col`` also the text that these ids decode to."""
    fields = [(ids_col, T.ArrayType(T.IntegerType()))] + ([(decoded_col, T.StringType())] if decoded_col else [])
    schema, spec = _with(df.schema, fields), vocabulary.broadcast
    keep = [f.name for f in schema.fields[:-len(fields)]]
    src = df.withColumn("__text", F.col(text_col)).select(*[F.col(f"`{c}`") for c in keep], "__text")

    def run(batches):
        model = _model(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = [model.encode(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                if decoded_col:
                    cols.append(pa.array([model.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of an id array (special tokens included; invalid UTF-8 becomes U+FFFD)."""
    schema, spec = _with(df.schema, [(text_col, T.StringType())]), vocabulary.broadcast
    keep = [f.name for f in schema.fields[:-1]]
    src = df.withColumn("__ids", F.col(ids_col)).select(*[F.col(f"`{c}`") for c in keep], "__ids")

    def run(batches):
        model = _model(spec)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1).to_pylist()
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols.append(pa.array([None if x is None else model.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and its ids decoded; digests of both."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    enc = encode(docs, Vocabulary.load(spark, vocabulary_path()), decoded_col="decoded")
    return enc.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
