"""Quality classifier: word perplexity under interpolated modified Kneser-Ney models of trusted text.

The model is a bigram model over whole words (runs without ASCII white space) between a start and an
end mark, one for each language and, where a language has too little trusted text, one of all. Its
vocabulary is open: tables grow with the trusted text. Trusted texts are dealt into two folds by
their hash and every document is scored by the model of the fold that its text is not in, so trusted
documents are judged like any others and the language's quantile is a held-out one.

The log probability of a text is a sum over its grams. With ``lo(v)`` the back-off weight of a
context, ``p1`` the continuation probability and ``own`` the discounted share of a seen bigram,

    log p(w | v) = log lo(v) + log p1(w) + [v w is seen] * log(1 + own / (lo(v) * p1(w)))

so every word has one value, every seen bigram has one, and other bigrams add nothing. Scoring is a
join of all grams of all documents with the table of values, sharded by the gram's key. What goes
into it is packed: a task sorts the grams of some 10**6 words (a group) and sends each shard the distinct
keys once, six bytes each, with two bytes for each place that has them; a shard sends back one row
for each group, with a sum for each of its texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import words
from attestra.llm.common import field, utf8, written
from attestra.sources.shared import drop_written, spread

POOLED = "*"
#: Marks at the ends of a text; words hold no space.
START, END = b" <", b" >"
#: Words counted or sent together, and texts that fifteen bits can number.
TOGETHER, MOST_TEXTS = 1 << 20, 1 << 15
#: 64-bit words of the filter that keeps most untrusted texts out of the shuffle: one megabyte, whatever the labels.
FILTER_WORDS = 1 << 17


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of bigrams; ``xxhash64(v, w)`` in SQL."""
    with np.errstate(over="ignore"):
        return words.mixed(w, words.mixed(v, np.full(1, 42, np.uint64)))


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode())


def word_key(lang: str, word: bytes) -> int:
    """The key of a word, or of a mark: bytes with a space in front, which no word has."""
    if word[:1] == b" ":
        with np.errstate(over="ignore"):
            return int(words.mixed(words.mixed(np.frombuffer(word.ljust(8), "<u8"), np.full(1, 11, np.uint64)), np.uint64(_seed(lang)))[0])
    return int(words.hashes(word + b" ", _seed(lang))[0][0])


def word_keys(lang: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words of the texts in one run, and how many words each text has."""
    return words.of_texts(texts, _seed(lang))


def bigrams(lang: str, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of all bigrams of texts, marks included: a text of n words has n + 1."""
    ends = np.cumsum(sizes + 1)
    v, w = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64), np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    last, first = np.zeros(len(w), bool), np.zeros(len(w), bool)
    last[ends - 1], first[ends - 1 - sizes] = True, True
    w[~last], w[last] = keys, word_key(lang, END)
    v[~first], v[first] = keys, word_key(lang, START)
    return v, w


def count(trusted: DataFrame, order: list[str]) -> DataFrame:
    """(l, v, w, c): the bigrams of ``trusted`` (l: number of the language in ``order``, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for l, some in held.items():
                v, w = (np.concatenate(x) for x in zip(*some, strict=True))
                _, at, many = np.unique(pair_keys(v, w), return_index=True, return_counts=True)
                for k in range(0, len(at), 100_000):
                    here = at[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), l, np.int32)), pa.array(v[here].view(np.int64)), pa.array(w[here].view(np.int64)), pa.array(many[k : k + 100_000].astype(np.int64))], names=["l", "v", "w", "c"])
            held.clear()

        for batch in batches:
            for l, _, texts in _by_language(batch.column(0), batch.column(1)):
                for some in _some(texts):
                    held.setdefault(l, []).append(bigrams(order[l], *word_keys(order[l], some)))
                    size += len(held[l][-1][0])
                    if size >= TOGETHER:
                        yield from out()
                        size = 0
        yield from out()

    each = trusted.select("l", "text").mapInArrow(run, "l int, v bigint, w bigint, c bigint")
    parts = int(trusted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # most bigrams of a group are met once: they are summed after the exchange alone
    return each.repartition(parts, "v", "w").groupBy("v", "w").agg(F.max("l").alias("l"), F.sum("c").alias("c"))


def _by_language(langs: pa.Array, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(language, rows, texts) for each language of a batch."""
    of, all_texts = langs.to_numpy(zero_copy_only=False), utf8(texts)
    for l in np.unique(of).tolist():
        rows = np.flatnonzero(of == l)
        yield l, rows, [all_texts[k] for k in rows]


def _some(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of bounded size."""
    at = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= words.SPAN or k + 1 - at >= MOST_TEXTS // 2:
            yield texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def _cuts(n: list[int]) -> list[float]:
    """The three discounts, from the numbers of entries that were counted once, twice, three and four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for j in (1, 2, 3):
        value = j - (j + 1) * y * n[j] / n[j - 1] if n[0] and n[j - 1] else -1.0
        # where a count of counts is zero, or the estimate leaves its range, a middle value serves
        out.append(value if 0 < value < j else j / 2)
    return out


def _counts_of(table: DataFrame, c: str) -> dict[int, tuple[list[int], int, int]]:
    """For each language: entries by count (1 to 4), entries, sum of counts."""
    rows = table.groupBy("l").agg(*(F.count_if(F.col(c) == j).alias(f"n{j}") for j in range(1, 5)), F.count(F.lit(1)).alias("entries"), F.sum(c).alias("total")).collect()  # a row for each language
    return {r.l: ([r.n1, r.n2, r.n3, r.n4], r.entries, r.total) for r in rows}


def _cut(l: Column, c: Column, cuts: dict[int, list[float]]) -> Column:
    """The discount of a count."""
    table = F.create_map(*(x for k, d in sorted(cuts.items()) for x in (F.lit(k), F.array(*map(F.lit, d)))))
    return F.get(F.element_at(table, l), F.least(c, F.lit(3)).cast("int") - 1)


class Model:
    """Values of words and seen bigrams (key, value), and each language's terms for unseen words and the marks."""

    def __init__(self, counts: DataFrame, order: list[str], blocks: int) -> None:
        """The values are worked out in ``blocks`` blocks of words, one after the other, so that the joins hold a part of the table on disk."""
        counts = written(counts, "bigrams")
        high = _counts_of(counts, "c")
        self.values: list[DataFrame] = []
        self.unseen: dict[int, float] = {}
        self.marks: dict[int, float] = {}
        if not high:
            return
        counted = counts.withColumn("d", _cut(F.col("l"), F.col("c"), {l: _cuts(n) for l, (n, *_) in high.items()}))
        after = counted.groupBy("l", "v").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("lo"))
        before = written(counts.groupBy("l", "w").agg(F.count(F.lit(1)).alias("c1")), "continuations")
        low = _counts_of(before, "c1")
        cuts, base = {}, {}
        for l, (n, entries, total) in low.items():
            cuts[l] = _cuts(n)
            left = sum(d * k for d, k in zip(cuts[l], [n[0], n[1], entries - n[0] - n[1]], strict=True)) / total
            base[l] = left / (entries + 1)
        self.unseen = {l: math.log(x) for l, x in base.items()}
        number = lambda some: F.element_at(F.create_map(*(x for k, value in sorted(some.items()) for x in (F.lit(k), F.lit(value)))), F.col("l"))
        each = before.select("l", "w", ((F.col("c1") - _cut(F.col("l"), F.col("c1"), cuts)) / number({l: total for l, (_, _, total) in low.items()}) + number(base)).alias("p1"))
        both = each.join(after.select("l", F.col("v").alias("w"), "lo", "total"), ["l", "w"], "full")
        each = written(both.withColumn("value", F.coalesce(F.ln("p1") - number(self.unseen), F.lit(0.0)) + F.coalesce(F.ln("lo"), F.lit(0.0))), "word-values")
        ends = {l: [np.uint64(word_key(order[l], x)).astype(np.int64).item() for x in (START, END)] for l in high}
        for r in each.where(reduce(lambda a, b: a | b, (F.col("w") == x for pair in ends.values() for x in pair))).select("l", "value").collect():  # two rows for each language
            self.marks[r.l] = self.marks.get(r.l, 0.0) + r.value
        self.marks = {l: x + self.unseen[l] for l, x in self.marks.items()}
        self.bits = max(6, (sum(entries for some in (high, low) for _, entries, _ in some.values()) // 2_000_000).bit_length())  # a shard has some two million values at most
        of_context, of_word = each.select(F.col("w").alias("v"), "lo", "total"), each.select("w", "p1")
        own = (F.col("c") - _cut(F.col("l"), F.col("c"), {l: _cuts(n) for l, (n, *_) in high.items()})) / F.col("total")
        self._pack(each.select(F.col("w").alias("key"), "value"))
        for block in range(blocks):
            seen = counts.where(F.pmod(F.shiftright("w", 7), F.lit(blocks)) == block)
            seen = seen.join(of_context.hint("shuffle_hash"), "v").select("v", "w", (own / F.col("lo")).alias("share"))  # a part of the words fits a task
            seen = seen.join(of_word.hint("shuffle_hash"), "w")
            self._pack(seen.select(F.xxhash64("v", "w").alias("key"), F.log1p(F.col("share") / F.col("p1")).alias("value")))
        drop_written(counts)
        drop_written(before)
        drop_written(each)

    def _pack(self, values: DataFrame) -> None:
        """Write values shard by shard: (shard, keys, values), a million or so a row."""
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held, size = -1, [], 0

            def out() -> pa.RecordBatch:
                keys, some = (np.concatenate(x) for x in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_packed(keys, bits)], pa.binary()), pa.array([some.astype("<f4").tobytes()], pa.binary())], names=["shard", "keys", "some"])

            for batch in batches:
                shards = batch.column(0).to_numpy()
                edges = np.flatnonzero(np.diff(shards)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shards)], strict=True):
                    if a == b:
                        continue
                    if held and (shards[a] != shard or size >= 1 << 20):
                        yield out()
                        held, size = [], 0
                    shard = int(shards[a])
                    held.append((batch.column(1).slice(a, b - a).to_numpy().view(np.uint64).copy(), batch.column(2).slice(a, b - a).to_numpy().copy()))
                    size += b - a
            if held:
                yield out()

        parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = values.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("shard"), "key", F.col("value").cast("float").alias("value")).repartition(parts, "shard").sortWithinPartitions("shard")
        self.values.append(written(dealt.mapInArrow(run, "shard int, keys binary, some binary"), "values"))

    def drop(self) -> None:
        for table in self.values:
            drop_written(table)


def _packed(keys: np.ndarray, bits: int) -> bytes:
    """Six bytes of each key, from below the bits that name its shard."""
    low = keys << np.uint64(bits) >> np.uint64(16)
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def score(docs: DataFrame, model: Model, order: list[str]) -> DataFrame:
    """(key, l, s, n) of every text of ``docs`` (key, l, text), once for each key: the sum of its grams' values, and its words. Texts without words are left out.

    Rows of equal key must be equal. Two keys of a shard that agree in six bytes share a value, about
    once in 10**8 lookups.
    """
    if not model.values:
        return docs.sparkSession.createDataFrame([], "key bigint, l int, s double, n bigint")
    parts, bits = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), model.bits
    # kind 0: keys and values of a shard; 1: keys that a group asks for, and the places of each; 2: keys, words and languages of the group's texts
    schema = "shard int, kind int, team bigint, one binary, two binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        team = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []  # grams, and the text of each
        owners: list[np.ndarray] = []
        told: list[np.ndarray] = []
        size = texts_held = 0

        def out() -> pa.RecordBatch:
            grams, places = (np.concatenate(x) for x in zip(*held, strict=True))
            turn = np.argsort(grams)
            grams, places = grams[turn], places[turn]
            fresh = np.concatenate([[True], grams[1:] != grams[:-1]])
            places |= fresh.astype(np.uint16) << np.uint16(15)  # the top bit starts the next key
            cuts = np.searchsorted(grams, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
            rows = [(hash(team) & ((1 << bits) - 1), 2, team, np.concatenate(owners).tobytes(), np.concatenate(told).tobytes())]
            rows += [(shard, 1, team, _packed(grams[a:b][fresh[a:b]], bits), places[a:b].tobytes()) for shard, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(grams)], strict=True)) if a < b]
            for x in (held, owners, told):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for l, rows_, texts in _by_language(batch.column(1), batch.column(2)):
                at = 0
                for some in _some(texts):
                    if texts_held + len(some) > MOST_TEXTS:
                        yield out()
                        team, size, texts_held = team + 1, 0, 0
                    grams, sizes = word_keys(order[l], some)
                    v, w = bigrams(order[l], grams, sizes)
                    place = np.arange(texts_held, texts_held + len(some), dtype=np.uint16)
                    held.append((np.concatenate([grams, pair_keys(v, w)]), np.concatenate([np.repeat(place, sizes), np.repeat(place, sizes + 1)])))
                    owners.append(keys[rows_[at : at + len(some)]])
                    told.append(sizes << 16 | l)
                    at += len(some)
                    size += len(w)
                    texts_held += len(some)
                    if size >= TOGETHER:
                        yield out()
                        team, size, texts_held = team + 1, 0, 0
        if held:
            yield out()

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        table: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                where, kind, team, one, two = (batch.column(c)[row].as_py() for c in range(5))
                if where != shard:
                    shard, held, table = where, [], None
                if kind == 0:
                    held.append((_unpacked(one), np.frombuffer(two, "<f4")))
                    continue
                if kind == 1:
                    if table is None:
                        keys, values = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.float32))
                        turn = np.argsort(keys)
                        table, held = (keys[turn], values[turn]), []
                    one, two = _sums(_unpacked(one), np.frombuffer(two, np.uint16), *table)
                yield pa.RecordBatch.from_arrays([pa.array([team]), pa.array([kind], pa.int32()), pa.array([one], pa.binary()), pa.array([two], pa.binary())], names=["team", "kind", "one", "two"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(batch.column(c)[k].as_py() for c in range(4)) for batch in batches for k in range(batch.num_rows))
        for _, some in groupby(rows, key=lambda x: x[0]):
            sums = np.zeros(MOST_TEXTS)
            for _, kind, one, two in some:
                if kind == 1:
                    sums[np.frombuffer(one, np.uint16)] += np.frombuffer(two, "<f8")
                else:
                    keys, told = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array((told & 0xFFFF).astype(np.int32)), pa.array(sums[: len(keys)]), pa.array(told >> 16)], names=["key", "l", "s", "n"])

    asked = docs.select("key", "l", "text").mapInArrow(ask, schema)
    known = reduce(DataFrame.unionByName, model.values).select("shard", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("team"), F.col("keys").alias("one"), F.col("some").alias("two"))
    dealt = known.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    answers = dealt.mapInArrow(serve, "team bigint, kind int, one binary, two binary").repartition(parts, "team").sortWithinPartitions("team")
    sums = answers.mapInArrow(add, "key bigint, l int, s double, n bigint").where("n > 0")
    return sums.groupBy("key").agg(F.max("l").alias("l"), F.max("s").alias("s"), F.max("n").alias("n"))


def _sums(asked: np.ndarray, marked: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """The texts that have any of the keys, and the sum of values for each; a mark in the top bit of a place starts the next key."""
    places = marked & np.uint16(0x7FFF)
    if not len(keys):
        return b"", b""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    found = np.where(keys[at] == asked, values[at], 0.0)
    sums = np.bincount(places, found[np.cumsum(marked >> np.uint16(15)) - 1])
    here = np.flatnonzero(sums)
    return here.astype(np.uint16).tobytes(), sums[here].tobytes()


def trusted_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The ids all of whose labels are 1."""
    return labels.select(field(id_col).alias("id"), field(label_col).alias("good")).groupBy("id").agg(F.min("good").alias("low"), F.count_if(F.col("good").isNull()).alias("unknown")).where("low = 1 and unknown = 0 and id is not null").select("id")


def _trusted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``; a filter of fixed size keeps most others out of the shuffle."""
    place = lambda: F.pmod(F.xxhash64("id"), F.lit(FILTER_WORDS * 64))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))
    word = lambda at: F.floor(at / 64).cast("int")
    marked = ids.select(place().alias("at")).groupBy(word(F.col("at")).alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("bits"))
    likely = docs.withColumn("word", word(place())).join(F.broadcast(marked), "word").where(F.col("bits").bitwiseAND(bit(place())) != 0).drop("word", "bits")
    return likely.join(ids.hint("merge"), "id")  # one plan at every size: labels grow with the documents


def perplexities(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", least_docs: int = 20, blocks: int = 2, word_blocks: int = 4) -> tuple[DataFrame, list[str]]:
    """(key, l, log): the mean log probability of a word, end mark included, of every text that has words and a model; and the languages by number.

    ``key`` is that of ``text_key``. Each fold is scored in ``blocks`` blocks, one after the other, and
    its model made in ``word_blocks``, so that what a join holds on disk is a part of the input.
    """
    narrow = spread(docs).select(field(id_col).alias("id"), F.coalesce(field(lang_col).cast("string"), F.lit("")).alias("lang"), field(text_col).cast("string").alias("text"), text_key(docs, id_col, text_col, lang_col).alias("key")).where("text != ''")
    fold = F.xxhash64("text").bitwiseAND(1).cast("int")
    ids = written(trusted_ids(labels, id_col, label_col), "trusted-ids")
    mark = narrow.select("id", "lang", fold.alias("fold"))
    many: dict[str, dict[int, int]] = {}
    for r in _trusted(mark, ids).groupBy("lang", "fold").count().collect():  # two rows for each language
        many.setdefault(r["lang"], {})[r["fold"]] = r["count"]
    order = [POOLED, *sorted(x for x, n in many.items() if x != POOLED and sum(n.values()) >= least_docs and len(n) == 2)]
    l = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(order) for x in (name, k))), F.col("lang")), F.lit(0))
    narrow = narrow.withColumn("l", l)
    pooled = bool(narrow.where("l = 0").limit(1).count())
    found = None
    for f in (0, 1):
        train = _trusted(narrow.where(fold != f).select("id", "l", "text"), ids)
        numbers = F.array_distinct(F.array("l", F.lit(0))) if pooled else F.array("l")
        model = Model(count(train.select(F.explode(numbers).alias("l"), "text"), order), order, word_blocks)
        terms = narrow.sparkSession.createDataFrame([(k, model.unseen[k], model.marks[k]) for k in model.marks], "l int, unseen double, marks double")
        for block in range(blocks):
            part = narrow.where((fold == f) & (F.pmod(F.shiftright(F.xxhash64("text"), 1), F.lit(blocks)) == block))
            sums = score(part, model, order).join(F.broadcast(terms), "l")
            logs = (F.col("s") + F.col("n") * F.col("unseen") + F.col("marks")) / (F.col("n") + 1)
            got = written(sums.select("key", "l", logs.alias("log")), "scores")
            found = got if found is None else found.unionByName(got)
        model.drop()
    return found, order


def text_key(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Column:
    return F.xxhash64(field(id_col), field(lang_col).cast("string"), field(text_col).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = 0.99, **options) -> DataFrame:
    """``docs`` with ``perplexity``, ``threshold`` and ``accepted`` (columns that must not clash).

    Trusted are the documents whose labels all say ``label_col`` = 1. Perplexity is per word. The
    threshold of a language is the ``quantile`` of its trusted documents' held-out perplexities, read
    from a histogram over all of them in steps of 0.001 of its logarithm. Languages with fewer than
    ``least_docs`` trusted documents, or with all of them in one fold, and null languages take the
    model and the threshold of all trusted text. Texts without words (null and empty ones too) have no
    perplexity and are not accepted. Where the other fold has no trusted text nothing can be judged:
    perplexity is null and every document with words is accepted. Repeated rows stay.
    """
    if clash := {"perplexity", "threshold", "accepted"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"documents already have {sorted(clash)}")
    logs, order = perplexities(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, label_col=label_col, **options)
    given = [field(c) for c in docs.columns]
    base = docs.select(F.struct(*given).alias("row"), text_key(docs, id_col, text_col, lang_col).alias("key"), field(id_col).alias("id"), F.coalesce(field(lang_col).cast("string"), F.lit("")).alias("lang"), field(text_col).cast("string").alias("text"))
    ids = trusted_ids(labels, id_col, label_col)
    trusted = base.select("id", "key").join(ids, "id").join(logs, "key")
    steps = written(trusted.groupBy("l", F.floor(-F.col("log") * 1000).cast("bigint").alias("step")).count(), "steps")
    steps = steps.where("l != 0").unionByName(steps.groupBy("step").agg(F.sum("count").alias("count")).withColumn("l", F.lit(0)))
    upto, whole = F.sum("count").over(Window.partitionBy("l").orderBy("step")), F.sum("count").over(Window.partitionBy("l"))
    cuts = steps.withColumns({"upto": upto, "whole": whole}).where(F.col("upto") >= F.col("whole") * quantile).groupBy("l").agg(F.min("step").alias("step")).collect()  # a row for each language
    found = {r.l: math.exp((r.step + 1) / 1000) for r in cuts}
    own = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(order) if k in found or k == 0 for x in (name, k))), F.col("lang")), F.lit(0))
    threshold = F.element_at(F.create_map(*(F.lit(x) for k in sorted(found) for x in (k, found[k]))), own) if found else F.lit(None).cast("double")
    perplexity = F.exp(-F.col("log"))
    any_word = F.coalesce(F.regexp_like("text", F.lit("[^\\x09-\\x0D\\x20]")), F.lit(False))
    judged = base.withColumns({"threshold": threshold, "any_word": any_word}).join(logs.select("key", "log"), "key", "left")
    accepted = F.col("any_word") & F.coalesce(perplexity <= F.col("threshold"), F.lit(True))
    return judged.select("row.*", perplexity.alias("perplexity"), "threshold", accepted.alias("accepted"))
