"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf gives the pieces, scores, normaliser and byte fallback; from these a tokenizers model is rebuilt that
encodes whole texts in multithreaded batches and decodes ids. Very long texts are taken in segments that begin at a
space after another character: no piece holds the white-space mark behind another character, so nothing ever merges
across such a border. Each text's ids are held against those that SentencePiece itself, with the model as it is, gives
for the raw text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A model file is shipped to the workers whole; larger ones are refused.
MODEL_BYTES = 64 << 20
#: Runs of byte pieces that a worker remembers the characters of.
KEPT = 50_000
#: Characters of a text, or ids, that are taken at a time.
SEGMENT = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Pieces:
    """A SentencePiece model rebuilt on tokenizers."""

    def __init__(self, proto: bytes, verify: bool = True, threads: int = 1):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer, decoders, models, normalizers

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        train, norm = model.trainer_spec, model.normalizer_spec
        if train.model_type not in (UNIGRAM, BPE) or train.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with a leading white-space mark can be rebuilt")
        self.pieces = [(p.piece, p.score, p.type or NORMAL) for p in model.pieces]
        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if train.model_type == UNIGRAM:
            rebuilt = models.Unigram([(p, s) for p, s, _ in self.pieces], unk, train.byte_fallback)
        else:
            rebuilt = models.BPE(vocab, self._merges(vocab), unk_token=self.pieces[unk][0], fuse_unk=True, byte_fallback=train.byte_fallback)
        self.prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        steps = [normalizers.Replace(" ", MARK)]
        if norm.precompiled_charsmap:
            steps.insert(0, normalizers.Precompiled(norm.precompiled_charsmap))
        self.rewrites = bool(norm.precompiled_charsmap)
        self.tokenizer = Tokenizer(rebuilt)
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        usable = [p for p, _, t in self.pieces if t in (NORMAL, USER)]
        self.splits = train.escape_whitespaces if hasattr(train, "escape_whitespaces") else True
        self.splits = self.splits and not self.rewrites and not any(MARK in p.lstrip(MARK) for p in usable) and not any(t == USER for *_, t in self.pieces)
        self.border = re.compile("[^ ](?= )")
        self.is_byte = np.array([t == BYTE for *_, t in self.pieces])
        one = self.tokenizer.decode_batch([[i] for i in range(len(self.pieces))], skip_special_tokens=False)
        self.shown = ["" if t == CONTROL else train.unk_surface if t == UNKNOWN else x for x, (*_, t) in zip(one, self.pieces, strict=True)]
        self.met: dict[bytes, str] = {}
        self.threads = threads
        self.pool = ThreadPoolExecutor(threads)  # both libraries let other threads run while they encode
        self.true = self.plain = None
        if verify:
            self.true = SentencePieceProcessor(model_proto=proto)
            model.normalizer_spec.add_dummy_prefix = False
            model.normalizer_spec.remove_extra_whitespaces = False
            self.plain = SentencePieceProcessor(model_proto=model.SerializeToString())

    def _merges(self, vocab: dict[str, int]) -> list[tuple[str, str]]:
        """A BPE model's pieces in order of their scores say which pair of shorter pieces is joined first; of pairs that make the same piece, the one whose left is longer."""
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                for k in range(1, len(piece)):
                    a, b = vocab.get(piece[:k]), vocab.get(piece[k:])
                    if a is not None and b is not None and self.pieces[a][2] == NORMAL == self.pieces[b][2]:
                        found.append((-score, -k, a, b))
        return [(self.pieces[a][0], self.pieces[b][0]) for *_, a, b in sorted(found)]

    def normalised(self, text: str) -> str:
        """White space as the model's normaliser leaves it; the mark itself counts as a space."""
        text = text.replace(MARK, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return f" {text}" if self.prefix and text else text

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, bool]]:
        """Of each text the ids as int32, the normalised text, and whether SentencePiece gives the same ids; where it doesn't, the ids are its own."""
        whole = [self.normalised(t) for t in texts]
        short = [i for i, t in enumerate(whole) if len(t) <= SEGMENT]
        parts = [short[k :: self.threads] for k in range(self.threads)]
        spread = self.pool.map if self.threads > 1 else map
        own = dict(chain.from_iterable(spread(lambda part: zip(part, (e.ids for e in self.tokenizer.encode_batch_fast([whole[i] for i in part], add_special_tokens=False)), strict=True), parts)))
        true = dict(chain.from_iterable(spread(lambda part: zip(part, self.true.encode([texts[i] for i in part], num_threads=1), strict=True), parts))) if self.true else own
        for i, text in enumerate(whole):
            if i in own:
                ids, known = own[i], true[i]
                yield np.array(ids if ids == known else known, np.int32), text, ids == known
                continue
            found, parity = [], True
            for segment in self.segments(text):  # as the model that neither adds nor drops spaces encodes them
                ids = self.tokenizer.encode(segment, add_special_tokens=False).ids
                known = self.plain.encode(segment) if self.plain else ids
                found.append(np.array(known, np.int32))
                parity = parity and ids == known
            yield np.concatenate(found), text, parity

    def segments(self, whole: str) -> Iterator[str]:
        """A long text in segments that begin at a space after another character."""
        at = 0
        while at < len(whole):
            m = self.border.search(whole, at + SEGMENT) if self.splits and len(whole) - at > SEGMENT else None
            end = m.end() if m else len(whole)
            yield whole[at:end]
            at = end

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids by the library's decoder: marks become spaces, byte pieces bytes, the leading space goes. Bytes that are no UTF-8 become U+FFFD.

        A piece that is no byte is shown alike wherever it stands, so the decoder is asked for each once, and for runs of bytes.
        """
        out, at = [], 0
        byte = self.is_byte[ids]
        if byte.any():
            turns = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for end in [*turns.tolist(), len(ids)]:
                out.append(self._run(ids[at:end]) if byte[at] else "".join(map(self.shown.__getitem__, ids[at:end].tolist())))
                at = end
        else:
            out = [self.shown[i] for k in range(0, len(ids), SEGMENT) for i in ids[k : k + SEGMENT].tolist()]
        text = "".join(out)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _run(self, ids: np.ndarray) -> str:
        key = ids.tobytes()
        if (got := self.met.get(key)) is None:
            if len(self.met) >= KEPT:
                self.met.clear()
            got = self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
            if len(ids) <= 16:
                self.met[key] = got
        return got


_BUILT: dict[str, Pieces] = {}


def built(proto: bytes, verify: bool, threads: int = 1) -> Pieces:
    """One model a worker process."""
    key = f"{hashlib.sha256(proto).hexdigest()} {verify} {threads}"
    if key not in _BUILT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # threads are ours: the library's own wait for work at a processor's full cost
        _BUILT.clear()
        _BUILT[key] = Pieces(proto, verify, threads)
    return _BUILT[key]


def encode(docs: DataFrame, model: bytes, text: str = "text", keep_ids: bool = True, verify: bool = True, chunk_chars: int = 1_000_000, threads: int | None = None) -> DataFrame:
    """``docs`` without ``text``'s own column, with n_tokens, ids (if ``keep_ids``), ids_sha256, decoded_sha256, round_trip and parity.

    ids_sha256 is over the ids as little-endian int32, decoded_sha256 over the decoded UTF-8. round_trip: decoding gives
    the normalised text. parity: the rebuilt model gives the ids that SentencePiece gives for the raw text (of a text over
    SEGMENT characters, for its normalised segments); where it doesn't, the ids are SentencePiece's. Without ``verify``
    parity is true and untested. A batch is encoded by ``threads``, as many as a task has processors (spark.task.cpus) if
    not given; more would take other tasks' time. A null text counts as empty: no ids, round_trip true. Repeated rows each get their row;
    an empty table gives an empty one. Other columns pass through; columns of the names above are replaced.
    """
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model has {len(model)} bytes, more than {MODEL_BYTES}")
    threads = threads or int(docs.sparkSession.conf.get("spark.task.cpus", "1"))
    made = ["n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip", "parity"]
    docs = docs.select(*[c for c in docs.columns if c not in made])
    rest = [c for c in docs.columns if c != text]
    kinds = [f.simpleString() for f in docs.select(*rest).schema]
    schema = ", ".join([*(f"`{k.partition(':')[0]}` {k.partition(':')[2]}" for k in kinds), "n_tokens bigint", *["ids array<int>"] * keep_ids, "ids_sha256 string", "decoded_sha256 string", "round_trip boolean", "parity boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = built(model, verify, threads)

        def part(batch: pa.RecordBatch, at: int, texts: list[str]) -> pa.RecordBatch:
            n, ids, shas, back, same, parity = [], [], [], [], [], []
            for got, whole, equal in pieces.encode(texts):
                decoded = pieces.decode(got)
                n.append(len(got))
                parity.append(equal)
                if keep_ids:
                    ids.append(got)
                shas.append(hashlib.sha256(got.tobytes()).hexdigest())
                back.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                same.append(decoded == (whole[1:] if pieces.prefix else whole))
            own = batch.slice(at, len(texts))
            cols = [own.column(c) for c in rest] + [pa.array(n, pa.int64())]
            names = [*rest, "n_tokens"]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())))
                names.append("ids")
            cols += [pa.array(shas, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())]
            return pa.RecordBatch.from_arrays(cols, names=[*names, "ids_sha256", "decoded_sha256", "round_trip", "parity"])

        for batch in batches:
            col, at, texts, chars = batch.column(text), 0, [], 0
            for i in range(batch.num_rows):
                texts.append(col[i].as_py() or "")
                chars += len(texts[-1])
                if chars >= chunk_chars:
                    yield part(batch, at, texts)
                    at, texts, chars = i + 1, [], 0
            if texts:
                yield part(batch, at, texts)

    return docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, schema)
