"""Token ids as flat unsigned integer files with 64-bit document offsets.

Layout under one folder (every file is written by Spark's committer, so a
retried task leaves no second copy, and any Hadoop file system can hold it):

* ``kind=ids/part=P/chunk=C/*``: nothing but little-endian unsigned integers
  (16 bits when the vocabulary allows it, else 32), document after document,
  each closed by the end id;
* ``kind=idx/part=P/chunk=C/*``: n doc_ids (int64), n + 1 offsets into the ids
  file (int64), n validity bytes (0: the doc_id is null), then a trailer of 8
  bytes that starts with n (uint32).

P and C ascend with doc_id. The base of a chunk, the number of ids ahead of it,
is the prefix sum of the chunk totals; it is kept in the manifest, not in the
chunk, so chunks are written without knowing each other. The text writer ends
each row with the bytes of the end id, which closes a chunk's last document.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, scratch, slices, tokenizer_path
from .pretok import LETTER, NUMBER, OTHER, WHITE_MORE, classes

#: ids of one chunk (a longer document is a chunk of its own)
CHUNK_IDS = 4 << 20
#: distinct pre-tokens a process remembers before it forgets those not met lately
CACHE = 600_000
END_ID = 2
# Texts of these characters are cut here; all others, and those that may hold a
# special string, go through the library whole.
NOT_PLAIN = re.compile("[^\t\n\x0b\x0c\r -~\xa0-įı-ɏ]|<\\|")


# fixed values: the steps before the model that ``WordEncoder.cut`` stands for
CUT_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_as_here(tokenizer: dict) -> bool:
    """Whether a tokenizer file's normaliser, pre-tokeniser and post-processor are those of ``WordEncoder.cut``."""
    norm, pre = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    steps, parts = norm.get("normalizers") or [], pre.get("pretokenizers") or []
    if [s.get("type") for s in steps] != CUT_NORMALIZERS or [s.get("type") for s in parts] != ["Split", "ByteLevel"] or tokenizer.get("post_processor"):
        return False
    blank, split, bytes_ = steps[1], parts[0], parts[1]
    return (blank.get("pattern") == {"Regex": "\\s+"} and blank.get("content") == " " and split.get("pattern") == {"Regex": CUT_PATTERN}
            and (split.get("behavior"), split.get("invert")) == ("Removed", True) and not bytes_.get("add_prefix_space") and not bytes_.get("use_regex")
            and (tokenizer.get("model") or {}).get("type") == "BPE" and not tokenizer["model"].get("dropout"))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """The tokenizers library over distinct pre-tokens: texts are lower-cased and
    cut in numpy, the library's BPE model merges each distinct pre-token once. With a
    file whose steps are others (``cuts_as_here``) every text goes through the library whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = cuts_as_here(json.loads(self.tokenizer.to_str()))
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")

    def _model(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(shown)], self.dtype).tobytes()

    @staticmethod
    def cut(texts: list[str]) -> list[list[str]]:
        """Pre-tokens of lower-cased plain texts: letter runs, single numbers, runs of
        anything else but white space, and contractions where such a run would start."""
        joined = " ".join(texts) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        c = classes()[points]
        prev = np.empty_like(c)
        prev[0], prev[1:] = WHITE_MORE, c[:-1]
        edge = (c != prev) | (c == NUMBER)
        for i in np.flatnonzero((points == 0x27) & (prev != OTHER)):
            two, three = joined[i + 1:i + 2], joined[i + 1:i + 3]
            n = 3 if three in ("re", "ve", "ll") else 2 if two and two in "stmd" else 0
            if n:
                edge[i + 1] = False
                edge[i + n] = True
        at = np.flatnonzero(edge)
        word = c[at] != WHITE_MORE
        starts = at[word].tolist()
        ends = np.append(at[1:], len(points))[word].tolist()
        words = [joined[a:b] for a, b in zip(starts, ends)]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = np.searchsorted(at[word], first).tolist()
        return [words[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without special tokens, as bytes of ``dtype``."""
        out: list = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and self.known and not NOT_PLAIN.search(t)]
        for k in set(range(len(texts))).difference(plain):
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.dtype).tobytes() if texts[k] else b""
        if not plain:
            return out
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        cut, cache = self.cut([texts[k].lower() for k in plain]), self.cache
        for w in set(chain.from_iterable(cut)).difference(cache):
            cache[w] = self.old[w] if w in self.old else self._model(w)
        for k, words in zip(plain, cut):
            out[k] = b"".join(map(cache.__getitem__, words))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _chunk(ids: list[bytes], doc_ids: list, width: int, end: bytes) -> tuple[bytes, bytes]:
    n = len(ids)
    offsets = np.zeros(n + 1, np.int64)
    offsets[1:] = np.cumsum([len(x) // width for x in ids])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + offsets.astype("<i8").tobytes() + known.tobytes()
    trailer = np.uint32(n).tobytes().ljust(8 - len(end), b"\0")
    return b"".join(ids)[:-len(end)], index + trailer  # the writer adds ``end`` to both


def read_index(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and validity of one index file."""
    n = int(np.frombuffer(blob[-8:-4], "<u4")[0])
    doc_ids = np.frombuffer(blob, "<i8", n)
    offsets = np.frombuffer(blob, "<i8", n + 1, 8 * n)
    return doc_ids, offsets, np.frombuffer(blob, np.uint8, n, 16 * n + 8)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
          chunk_ids: int = CHUNK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write ids and offsets in ascending doc_id order (null ids
    first). One shuffle, by ranges of doc_id and, so that many rows of one id (or without
    one) are many tasks, a hash of the text. Each byte of ``end_id`` must be below 128,
    since Spark's text writer ends the rows with it."""
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    wide = encoder(tokenizer).wide
    end = int(end_id).to_bytes(4 if wide else 2, "little")
    if max(end) > 127:
        raise ValueError(f"end_id {end_id} has the byte {max(end)}, which the text writer would not keep")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, chunk = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        doc_ids: list = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(["ids", "idx"]), pa.array([part, part], pa.int32()), pa.array([chunk, chunk], pa.int32()),
                 pa.array(_chunk(ids, doc_ids, enc.dtype.itemsize, end), pa.binary())], ["kind", "part", "chunk", "value"])

        for b in slices(batches):
            for d, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                if ids and size + len(x) > chunk_ids * enc.dtype.itemsize:
                    yield out()
                    ids, doc_ids, size, chunk = [], [], 0, chunk + 1
                ids.append(x + end)
                doc_ids.append(d)
                size += len(x) + len(end)
        if ids:
            yield out()

    keys = ["doc_id", F.xxhash64("text")]
    ordered = id_text(docs, id_col, text_col).repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    packed = ordered.mapInArrow(pack, "kind string, part int, chunk int, value binary")
    (packed.withColumn("value", F.col("value").cast("string")).write.partitionBy("kind", "part", "chunk")
     .option("lineSep", end.decode("latin-1")).option("compression", "none").text(path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, chunk, n_docs, n_ids, base) of every chunk. One row per chunk of millions
    of ids, so the single-task prefix sum stays small."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read_index(x.as_py())[1] for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(o) - 1 for o in got], pa.int64()),
                 pa.array([int(o[-1]) for o in got], pa.int64())], ["part", "chunk", "n_docs", "n_ids"])

    index = spark.read.format("binaryFile").load(f"{path}/kind=idx").select("part", "chunk", "content")
    order = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (index.mapInArrow(totals, "part int, chunk int, n_docs long, n_ids long")
            .withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))))


def read(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Where the folder is a mounted one (``file:``) a worker maps the ids file into
    memory and touches only its own pages; elsewhere Spark reads the file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not _exists(spark, f"{path}/kind=idx"):
        return spark.createDataFrame([], schema)
    dtype = "<u4" if wide else "<u2"
    files = spark.read.format("binaryFile")
    ids = files.load(f"{path}/kind=ids").select("part", "chunk", F.col("path").alias("ids_path"), F.col("content").alias("ids"))
    mapped = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getScheme() in (None, "file")
    if mapped:
        ids = ids.drop("ids")
    index = files.load(f"{path}/kind=idx").select("part", "chunk", F.col("content").alias("index"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (index.join(manifest(spark, path).select("part", "chunk", "base"), ["part", "chunk"])
            .join(ids, ["part", "chunk"]).repartition(n, "part", "chunk")
            .select("base", "index", "ids_path", F.lit(None).cast("binary").alias("ids") if mapped else "ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            doc_ids, offsets, known = read_index(row["index"])
            flat = np.memmap(unquote(urlparse(row["ids_path"]).path), dtype, "r") if mapped else np.frombuffer(row["ids"], dtype)
            crc = [zlib.crc32(flat[a:b].astype("<u4")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64(), mask=known == 0), pa.array(row["base"] + offsets[:-1]), pa.array(np.diff(offsets)),
                 pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, schema)


def write_and_read(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, **how) -> DataFrame:
    """Write the files (a new folder in the shared one unless ``path`` is given) and read them back."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    path = path or scratch(spark, "flat-ids")
    write(docs, path, tokenizer, **how)
    return read(spark, path, encoder(tokenizer).wide)
