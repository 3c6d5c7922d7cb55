"""SentencePiece encoding and decoding with the ``tokenizers`` library.

The model's protobuf is parsed and rebuilt as a tokenizer: its normaliser
(compiled character map, white-space rules, dummy prefix), the metaspace
marker, unigram scores or byte-pair merges in score order, and byte fallback.
Each worker builds it once, checks it against the ``sentencepiece`` library
on fixed probe texts, and encodes batches on ``threads`` threads.

Cases: a null text stays null (null ids, 0 tokens, null round trip); an empty
one has no ids.  Texts of any length are encoded whole.  Repeated rows are
encoded each.  Only the id and text columns are read, so other columns cannot
clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gauntlet.llm.common import lean

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6   # fixed values of the model format
UNIGRAM, BPE = 1, 2
BATCH_BYTES = 1 << 20
AT_ONCE = 1 << 15                 # words encoded at once, as the library keeps more of each than its ids
CACHE_WORDS = 150_000             # words that a worker keeps with their ids, besides those of the batch

#: Fixed probe texts for the parity check: white space, other scripts, bytes without a piece, marks.
PROBES = ("", " ", "a", "  two  spaces ", "line\nbreak\tand tab", "Ärger über ñandú, él’s", "你好 مرحبا",
          "\U0001f600 emojí", "aaaaaaa abababab", "x" * 300, "1234567890 3.14", "<s> </s> <unk> <0x41>", "▁marker", "!!!###|||")


def parse_model(path: str):
    """The model's protobuf message."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(path, "rb") as f:
        return schema.ModelProto.FromString(f.read())


def _merges(scores: dict[str, float]) -> list[tuple[str, str]]:
    """Pairs of pieces whose concatenation is a piece, best score first."""
    found = [(-score, piece[:k], piece[k:]) for piece, score in scores.items()
             for k in range(1, len(piece)) if piece[:k] in scores and piece[k:] in scores]
    return [(left, right) for _, left, right in sorted(found, key=lambda m: (m[0], len(m[1])))]


def build_tokenizer(path: str):
    """The model as a ``tokenizers.Tokenizer``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = parse_model(path)
    trainer, rules = proto.trainer_spec, proto.normalizer_spec
    pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
    unknown = next((p for p, _, kind in pieces if kind == UNKNOWN), None)
    if trainer.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=trainer.unk_id, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == BPE:
        usable = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        model = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, _merges(usable), unk_token=unknown,
                           fuse_unk=True, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor byte-pair")
    steps = []
    if rules.precompiled_charsmap:
        steps.append(normalizers.Precompiled(rules.precompiled_charsmap))
    if rules.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if rules.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if rules.escape_whitespaces else " "))
    if rules.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer = Tokenizer(model)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARKER in p[1:].lstrip(MARKER) for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED)):
        # no piece spans a word boundary, so words can be encoded (and cached) one by one
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if rules.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return tokenizer


def verify_parity(tokenizer, path: str, texts) -> None:
    """Raise unless the tokenizer (or ``Coder``) gives the ids of the ``sentencepiece`` library on every text."""
    import sentencepiece

    own = (tokenizer(list(texts))[0] if isinstance(tokenizer, Coder)
           else [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)])
    other = sentencepiece.SentencePieceProcessor(model_file=path).encode(list(texts), num_threads=1)
    for text, a, b in zip(texts, own, other):
        if a != b:
            raise ValueError(f"tokenizer differs from sentencepiece on {text[:80]!r}: {a[:20]} {b[:20]}")


class Coder:
    """Encodes and decodes batches.  If no piece spans words, each distinct word is encoded and decoded once
    and kept, and a text's ids are those of its words; else texts are encoded as they are."""

    def __init__(self, path: str):
        self.tokenizer = build_tokenizer(path)
        rules = parse_model(path).normalizer_spec
        self.prefix, self.by_word = rules.add_dummy_prefix, self.tokenizer.pre_tokenizer is not None
        self.plain = rules.add_dummy_prefix and rules.escape_whitespaces and not (
            rules.precompiled_charsmap or rules.remove_extra_whitespaces)
        self.ids: dict[str, list[int]] = {}
        self.texts: dict[str, str] = {}
        if self.by_word:
            from tokenizers import decoders

            self.word = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
            self.words = build_tokenizer(path)
            self.words.normalizer = self.words.pre_tokenizer = None
            self.words.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()])
        # both ways to the ids: whole texts, and the words that batches are made of
        verify_parity(self.tokenizer, path, PROBES)
        verify_parity(self, path, PROBES)

    def _words_of(self, text: str) -> list[str]:
        if not text:
            return []
        normal = MARKER + text.replace(" ", MARKER) if self.plain else self.tokenizer.normalizer.normalize_str(text)
        return self.word.findall(normal)

    def __call__(self, texts: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids of each text, and the text they decode to."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.texts = {}, {}
        lists = [self._words_of(t) for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(lists)) if w not in self.ids]
        for i in range(0, len(new), AT_ONCE):
            part = new[i:i + AT_ONCE]
            ids = [e.ids for e in self.words.encode_batch_fast(part, add_special_tokens=False)]
            self.ids.update(zip(part, ids))
            self.texts.update(zip(part, self.words.decode_batch(ids, skip_special_tokens=False)))
        back = ["".join(map(self.texts.__getitem__, own)) for own in lists]
        if self.prefix:
            back = [b.removeprefix(" ") for b in back]
        return [list(chain.from_iterable(map(self.ids.__getitem__, own))) for own in lists], back


def task_cores(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.task.cpus", "1"))


_built: dict[str, Coder] = {}


def coder_for(path: str, threads: int) -> Coder:
    """The worker's coder for a model, built and verified at its first use."""
    if path not in _built:
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        _built[path] = Coder(path)
    return _built[path]


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, list]]:
    """The texts in parts of about ``limit`` bytes, each with its first row; the others stay in Arrow meanwhile."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if size and size + n > limit:
            yield start, texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, texts.slice(start).to_pylist()


def _encode(coder: Coder, texts: list) -> pa.Table:
    ids, back = map(iter, coder([t for t in texts if t is not None]))
    ids = [None if t is None else np.array(next(ids), np.int32) for t in texts]
    same = [None if t is None else next(back) == t for t in texts]
    return pa.table({"n_tokens": pa.array([0 if i is None else len(i) for i in ids], pa.int64()),
                     "round_trip": pa.array(same, pa.bool_()), "ids": pa.array(ids, pa.list_(pa.int32()))})


def encode_texts(docs: DataFrame, *, model_path: str = MODEL_PATH, threads: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, round_trip (decoding gives the text again), ids.

    ``model_path`` must exist on every executor.  Batches are encoded on
    ``threads`` threads, by default the cores that Spark reserves for a task
    (spark.task.cpus).
    """
    threads = threads or task_cores(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = coder_for(model_path, threads)
            for i, texts in _slices(batch.column("text"), BATCH_BYTES):
                made = _encode(coder, texts)
                yield from made.add_column(0, "id", batch.column("id").slice(i, len(texts))).to_batches()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(lean(run), "id long, n_tokens long, round_trip boolean, ids array<int>")
    return made.withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, *, model_path: str = MODEL_PATH, threads: int | None = None,
               id_col: str = "doc_id") -> DataFrame:
    """One row per document: id and the text that its ids stand for (null ids: null)."""
    threads = threads or task_cores(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            back = coder_for(model_path, threads).tokenizer.decode_batch([x or [] for x in lists], skip_special_tokens=False)
            texts = [None if x is None else b for x, b in zip(lists, back)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), "ids")
    return rows.mapInArrow(lean(run), "id long, text string").withColumnRenamed("id", id_col)
