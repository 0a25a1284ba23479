"""Token ids of whole texts as ORC files in document order, read back by stripes.

The rows are range-partitioned by id and sorted, each task encodes its texts and writes one file.
ORC keeps the ids as run-length encoded integers, with an index every ``ROW_INDEX`` rows and
Bloom filters on the document id, so that a reader splits files by stripes and skips what a filter
on the id rules out. Reading needs no Python: ``read_tokens`` is a plain scan.

Defined results: a NULL or empty text has only the end id. Rows are written in ascending id
order, a NULL id first; rows of equal ids follow the hash of their text. An empty table gives
files without rows. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.shingles import mix, powers
from dialoom.session import materialize, scratch_dir

END_ID = 2
ROW_INDEX = 1_000
STRIPE_BYTES = 16 << 20
#: Words, and as many of their parts, that a worker remembers, some 45 bytes each.
REMEMBERED = 200_000
#: Bytes of text that a worker encodes at a time.
SLICE_BYTES = 2 << 20
_MARK = "|"


#: Blanks for Python that the tokenizer takes for characters.
_NOT_BLANK = "[\x1c-\x1f]"


def _cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts in a row, and how many each text has. Empty words may be among them."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, _NOT_BLANK)).as_py():
        cut = lambda t: re.split(r"[ \t\n\r]+", t) if re.search(_NOT_BLANK, t) else t.split()
        lists = pa.array([cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Before marks that end a word: the tokenizer cuts between these in any case.
_SPLIT = r"[\p{L}\p{N}]\z"
#: May hold a special token, matched as it stands, or the one letter whose small form is two characters.
_WHOLE = r"<\||\x{130}"
#: Letters that Arrow and the tokenizer lower alike.
_LOWERED = r"^[\x{0}-\x{24F}]*$"


def _ends(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last ``sizes`` bytes of the words."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words), words.offset * 4 + 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(starts), pa.py_buffer(raw[_ranges(ends - sizes, sizes)]))


def _cores_and_tails(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The numbers of every word's core and tail, and the distinct parts that they number.

    A word's ids are its core's, the word without its closing marks, and then its tail's, these
    marks. The tokenizer lowers letters, so cores come lowered and fewer of them are encoded.
    """
    core = pc.ascii_rtrim(words, characters=_MARKS)
    split = pc.and_(pc.match_substring_regex(core, _SPLIT), pc.invert(pc.match_substring_regex(words, _WHOLE)))
    core = pc.if_else(split, core, words)
    tail = _ends(words, pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy().astype(np.int64))
    core = pc.if_else(pc.and_(split, pc.match_substring_regex(core, _LOWERED)), pc.utf8_lower(core), core)
    numbered = pa.concat_arrays([core, tail]).dictionary_encode()
    number = numbered.indices.to_numpy().astype(np.int64)
    return number[: len(words)], number[len(words) :], numbered.dictionary


class _Hash:
    """128-bit hashes of many short texts at once, over their bytes."""

    bases = 0x100000001B3, 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.tables = [(np.empty(0, np.uint64), np.empty(0, np.uint64)) for _ in self.bases]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
        starts, sizes = at[:-1] - at[0], np.diff(at)
        raw = raw.astype(np.uint64) + np.uint64(1)
        out = []
        for k, base in enumerate(self.bases):
            if len(self.tables[k][0]) <= len(raw):
                inverse, size = pow(base, -1, 1 << 64), max(len(raw) + 1, 1 << 16)
                self.tables[k] = powers(np.uint64(base), size), powers(np.uint64(inverse), size)
            up, down = self.tables[k]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)))
            out.append(mix((sums[starts + sizes] - sums[starts]) * down[starts] + sizes.astype(np.uint64) * np.uint64(base)))
        return out[0], out[1]


class _Table:
    """Ids of texts, found by 128-bit hashes: sorted arrays, some 30 bytes and the ids for each text."""

    def __init__(self) -> None:
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)  # sorted by the first
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, np.int32)

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which texts are known, and the places of these."""
        if not len(self.first):
            return np.zeros(len(first), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        known = (self.first[at] == first) & (self.second[at] == second)
        return known, at[known]

    def add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New texts with their ids in a row; beyond ``REMEMBERED`` none is added."""
        if len(self.first) + len(first) > REMEMBERED:
            return
        both = np.concatenate((self.first, first))
        order = np.argsort(both, kind="stable")
        self.first, self.second = both[order], np.concatenate((self.second, second))[order]
        start = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        self.start = np.concatenate((self.start, start))[order]
        self.size = np.concatenate((self.size, size.astype(np.int32)))[order]
        self.flat = np.concatenate((self.flat, ids))


class WordEncoder:
    """Ids of whole texts, with a bounded memory of what is already encoded.

    The tokenizer never joins characters across a blank (its patterns stop there and the blanks
    themselves give no ids), so a text's ids are its words' ids in order, and a word's are those of
    its core and its tail. Only the distinct words of many texts are looked up, in a table of
    hashes; new ones are cut into parts, which are looked up likewise; new parts are encoded many at
    a time, separated by a mark with an id of its own, and parts with that mark alone. The first
    ``REMEMBERED`` words and parts stay in the tables, later ones serve their slice only.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.ids(_MARK)
        if len(mark) != 1:
            raise ValueError("the mark must be one token")
        self.mark, self.hash = mark[0], _Hash()
        self.words, self.parts = _Table(), _Table()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts in a row, and how many each has."""
        marked = pc.match_substring(parts, _MARK).to_numpy(zero_copy_only=False)
        sizes, flats = np.zeros(len(parts), np.int64), []
        others = np.flatnonzero(~marked)
        runs = [others[k : k + 500] for k in range(0, len(others), 500)]
        cuts = np.array([*range(0, len(others), 500), len(others)], np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), parts.take(pa.array(others))), f" {_MARK} ").to_pylist()
        for run, found in zip(runs, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.int32)
            marks = ids == self.mark
            sizes[run] = np.diff(np.concatenate(([-1], np.flatnonzero(marks), [len(ids)]))) - 1
            flats.append(ids[~marks])
        alone = np.flatnonzero(marked)
        for k in alone:
            ids = self.ids(parts[k].as_py())
            sizes[k] = len(ids)
            flats.append(np.array(ids, np.int32))
        # The ids lie in the order of the runs; put them into the order of the parts.
        flat = np.concatenate([np.empty(0, np.int32), *flats])
        order = np.concatenate((others, alone))
        starts = np.empty(len(parts), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return (flat if not len(alone) else flat[_ranges(starts, sizes)]), sizes

    def _ids_of(self, table: _Table, texts: pa.Array, made) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, and how many each has; ``made`` encodes those not in the table."""
        first, second = self.hash(texts)
        known, at = table.find(first, second)
        start, size = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        start[known], size[known] = table.start[at], table.size[at]
        flat, new = table.flat, np.flatnonzero(~known)
        if len(new):
            ids, sizes = made(texts.take(pa.array(new)))
            start[new], size[new] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate((flat, ids))
            table.add(first[new], second[new], ids, sizes)
        return flat[_ranges(start, size)], size

    def _from_parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cores, tails, parts = _cores_and_tails(words)
        flat, size = self._ids_of(self.parts, parts, self._encode)
        both = np.stack((cores, tails), axis=1).ravel()
        return flat[_ranges((np.cumsum(size) - size)[both], size[both])], size[cores] + size[tails]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text with the end id, and the number of ids of each."""
        counts, words = _cut(texts)
        numbered = words.dictionary_encode()
        at, distinct = numbered.indices.to_numpy(), numbered.dictionary
        ids, length = self._ids_of(self.words, distinct, self._from_parts)
        begin = np.cumsum(length) - length
        # The place of every word's ids in the output: behind the words and end ids before it.
        text_of = np.repeat(np.arange(len(counts)), counts)
        lengths = length[at]
        sizes = np.bincount(text_of, lengths, minlength=len(counts)).astype(np.int64) + 1
        out = np.full(int(sizes.sum()), END_ID, np.int32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(sizes) - 1] = False
        out[keep] = ids[_ranges(begin[at], lengths)]
        return out, sizes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers ``start ... start + size - 1``, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _encoder_of_worker(path: str) -> WordEncoder:
    """The worker's encoder, so that its tasks share what it has learned.

    Functions travel by value and are new in each task; an imported module lasts.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _release_memory() -> None:
    """Give back to the system what earlier tasks of this worker have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has the call
        ctypes.CDLL(None).malloc_trim(0)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release_memory()
        encoder, row = _encoder_of_worker(path), 0
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            bytes_ = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            slices = np.flatnonzero(np.diff((np.cumsum(bytes_, dtype=np.int64) - bytes_) // SLICE_BYTES, prepend=-1))
            for begin, end in zip(slices, [*slices[1:], batch.num_rows], strict=True):
                flat, sizes = encoder.encode_all(texts.slice(begin, end - begin))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin),
                        pa.array(np.arange(row, row + len(sizes), dtype=np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                    ],
                    ["doc_id", "row", "ids"],
                )
                row += len(sizes)

    return run


SCHEMA = "doc_id bigint, row bigint, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode and write all documents to a folder of ORC files, in ascending id order."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # Rows of one id are told apart, so that an id with very many rows does not land in one task.
    keyed = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row")
    encoded = placed.select("doc_id", "text").mapInArrow(_encode(tokenizer_path), SCHEMA)
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", str(ROW_INDEX))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "snappy")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, row, ids``: the files' rows; a filter on ``doc_id`` skips files, stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
            ["doc_id", "row", "_file", "n_tokens", "ids_crc32"],
        )


def summary(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents in the files.

    Files follow each other in the order of their part numbers. Starts are sums within a file,
    shifted by the sizes of the files before it: one row per file.
    """
    tokens = read_tokens(spark, path).select("doc_id", "row", F.col("_metadata.file_name").alias("_file"), "ids")
    # Written once, a narrow row per document: both the sums and the starts read it.
    checked = materialize(
        tokens.mapInArrow(_checks, "doc_id bigint, row bigint, _file string, n_tokens bigint, ids_crc32 bigint")
    )
    part = F.regexp_extract("_file", r"^part-([0-9]+)", 1).cast("long")
    before = Window.partitionBy("_file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    within = checked.withColumn("_within", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = checked.groupBy("_file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return within.join(F.broadcast(files), "_file").select(
        "doc_id", (F.col("_before") + F.col("_within")).alias("start"), "n_tokens", "ids_crc32"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the documents' ids below the shared checkpoint folder and sum up the files read back."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tokens"
    write_tokens(docs, path, tokenizer_path or default_tokenizer())
    return summary(spark, path)
