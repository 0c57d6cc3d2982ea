"""Token ids of whole texts with a public tokenizer, and their storage as Parquet list columns."""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import field, table_path, type_of, utf8
from attestra.sources.shared import spread

#: Words whose ids a worker keeps; beyond it, its store is emptied and refilled.
WORDS_KEPT = 1_100_000
#: Texts whose new words are encoded in one call.
TEXTS_TOGETHER = 64
#: A word's letters and a run of ASCII signs after them that no contraction rule can claim.
_TAIL = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]+)\Z")


def _folded(text: bytes) -> bytes:
    """A-Z to lower case, unless a combining mark (U+0300 to U+036F) follows somewhere: only these make one character with an ASCII letter, and not for both cases alike."""
    return text if b"\xcc" in text or b"\xcd" in text else text.lower()


class _Words(dict):
    """Ids of words, each made once while it is kept.

    Lower-case ASCII letters reach the model unchanged, so where the tokenizer marks word ends the model
    is asked alone; letters and the signs after them are made from the ids of both. Other words are
    noted, to be encoded many at a time.
    """

    def __init__(self, model) -> None:
        self.model, self.wanted = model, []

    def __missing__(self, word: bytes) -> bytes | None:
        folded = word.lower() if word.isascii() else word
        if self.model is not None and folded.isalpha():
            ids = array("I", [x.id for x in self.model.tokenize(folded.decode())]).tobytes()
        elif cut := None if folded.isalpha() else _TAIL.match(folded):
            letters, signs = self[cut[1]], self[cut[2]]
            ids = None if letters is None or signs is None else letters + signs
        else:
            ids = None
        if ids is None:
            self.wanted.append(word)
        else:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of a text, word by word.

    For a tokenizer whose pre-tokenizer parts at white space and drops it, the ids of a text are the
    ids of its words in turn, so each distinct word is encoded by the library once while it is kept.
    The tokenizer must fold case, as ``word_bpe_49k.json`` does; another is refused.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = self.tokenizer.encode("Ab  cD\nE.f", add_special_tokens=False).ids
        if probe != [x for w in ("ab", "cd", "e.f") for x in self.tokenizer.encode(w, add_special_tokens=False).ids]:
            raise ValueError(f"{path} does not fold case and drop white space")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = {k for word, k in self.tokenizer.get_vocab().items() if word.endswith(suffix)} if suffix else None
        self.words = _Words(self.tokenizer.model if suffix else None)

    def _encode(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """The ids of each word; words of letters are encoded many at a time and parted at the marks of word ends."""
        rest, letters = [], []
        for word in words:
            (letters if self.ends is not None and word.decode().isalpha() else rest).append(word)
        groups = [letters[k : k + 50] for k in range(0, len(letters), 50)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = got.ids
            cuts = [k + 1 for k, x in enumerate(ids) if x in self.ends]
            if len(cuts) == len(group):  # each word has one end at least
                yield from zip(group, (ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True)
            else:
                rest += group
        for word, got in zip(rest, self.tokenizer.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False), strict=True):
            yield word, got.ids

    def _learn(self, wanted: list[bytes]) -> dict[bytes, bytes]:
        """The ids of the noted words: of their parts first, where they have two."""
        parts = {w: cut.groups() if (cut := None if w.isalpha() else _TAIL.match(w.lower() if w.isascii() else w)) else (w,) for w in wanted}
        words = self.words
        fresh = {p for some in parts.values() for p in some if p not in words}
        words.update({p: array("I", ids).tobytes() for p, ids in self._encode([*fresh])})
        made = {w: b"".join([words[p] for p in some]) for w, some in parts.items()}
        words.update(made)
        return made

    def encode_all(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = self.words
        for k in range(0, len(texts), TEXTS_TOGETHER):
            split = [_folded(x).split() if x else [] for x in texts[k : k + TEXTS_TOGETHER]]
            found, gaps = [], []
            for some in split:
                before = len(words.wanted)
                found.append([*map(words.__getitem__, some)])
                gaps.append(len(words.wanted) > before)
            made = self._learn([*{*words.wanted}]) if words.wanted else {}
            words.wanted.clear()
            if len(words) > WORDS_KEPT:
                words.clear()
            for some, ids, gap in zip(split, found, gaps, strict=True):
                yield b"".join([made[w] if x is None else x for w, x in zip(some, ids, strict=True)] if gap else ids)

    def encode(self, text: bytes | None) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, kept from task to task. Its store holds no cycles, so the worker looks for them less often."""
    gc.set_threshold(200_000, 50, 100)
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 0, capacity: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most ``capacity`` ids: (id, piece, start, length, ids_crc32[, ids]).

    Every document ends with ``end_id``; only documents of more than ``capacity`` ids are cut, and
    only their last piece may be shorter. A null or empty text is one piece of one id. No documents
    give no pieces; repeated rows give repeated pieces; other columns are not carried.
    """
    tail, width = np.uint32(end_id).astype("<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            rows, piece, start, made = [], [], [], []
            for k, ids in enumerate(code.encode_all(utf8(batch.column(1)))):
                ids += tail
                for number, at in enumerate(range(0, len(ids), width)):
                    rows.append(k)
                    piece.append(number)
                    start.append(at // 4)
                    made.append(ids[at : at + width])
            out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array([zlib.crc32(x) for x in made], pa.int64())]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in made], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    schema = f"id {type_of(docs, id_col)}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return spread(docs).select(field(id_col).alias("id"), field(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: Bytes of input that go into one token file, about, where the session's partitions would make larger ones.
FILE_BYTES = 256 << 20
#: Settings of the token files: row groups, pages and rows a page are held small enough that the page
#: index leads to a few pages; token ids take the dictionary, ordered numbers delta encoding.
FILE_OPTIONS = {
    "compression": "lz4_raw", "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#local_start": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.dictionary.page.size": str(1 << 20),
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Write all documents' ids in ascending order of ``id_col`` as Parquet files.

    Columns: doc_id, file (number of the file in order), local_start (ids before the document in its
    file), n_tokens (with the end id), tokens (array<int>). Texts are range-partitioned before they
    are encoded, so ids are made once, in order, and never shuffled. Equal ids are ordered by the
    text's checksum and length, and may be cut between files; null ids come first; null text is
    empty, so only its end id is stored. No documents give one file without rows or none.
    """
    spark = docs.sparkSession
    kind = type_of(docs, id_col)
    text = F.coalesce(field(text_col).cast("string"), F.lit(""))
    base = docs.select(field(id_col).alias("id"), text.alias("text"), F.crc32(text).alias("crc"), F.octet_length(text).alias("size"))
    keys = ["id", "crc", "size"]
    if files is None:
        whole = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files; far too large where it is not known
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole // FILE_BYTES) if whole < 1 << 60 else 0)
    base = base.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    base.mapInArrow(_numbered_tokens(tokenizer, end_id), f"doc_id {kind}, file int, local_start bigint, n_tokens bigint, tokens array<int>").write.options(**FILE_OPTIONS).parquet(path)


def _numbered_tokens(tokenizer: str, end_id: int):
    tail = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                got = [x + tail for x in code.encode_all(utf8(batch.column(1)))]
                sizes = np.array([len(x) // 4 for x in got], np.int64)
                ends = np.cumsum(sizes)
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(got))])
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(got), part, np.int32)), pa.array(before + ends - sizes), pa.array(sizes), tokens], names=["doc_id", "file", "local_start", "n_tokens", "tokens"])
                before += int(ends[-1])

    return run


def read_token_files(spark, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before it), n_tokens, tokens.

    Starts come from each file's metadata columns alone: one row per file is summed, no token is read
    unless it is selected.
    """
    stored = spark.read.parquet(path)
    last = stored.groupBy("file").agg(F.sum("n_tokens").alias("n")).orderBy("file").collect()  # a row for each file
    sums = np.concatenate([[0], np.cumsum([r.n for r in last])])
    bases = spark.createDataFrame([(r.file, int(s)) for r, s in zip(last, sums, strict=False)], "file int, base bigint")
    return stored.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def checked(stored: DataFrame) -> DataFrame:
    """Token rows with the checksum of their ids in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            flat, ends = np.ascontiguousarray(tokens.flatten().to_numpy(), "<i4"), np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())])
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, f"doc_id {type_of(stored, 'doc_id')}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the token files into the shared folder, read them back, and return what they hold."""
    path = table_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return checked(read_token_files(docs.sparkSession, path))
