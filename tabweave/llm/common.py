"""Shared pieces: the folder all machines see, staged tables, and word hashing over Arrow buffers."""

import re
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; longer texts are handled alone.
PIECE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is named, a temporary one is set if all runs on one machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="tabweave-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id, n: int = 5):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def row_key(docs: DataFrame):
    """128 bits of all of a row's columns and of which are null: only equal rows share them, and a task that is run twice gives the same."""
    cells = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *cells).alias("h"), F.xxhash64(F.lit(2), *cells).alias("g"))


def put_file(uri: str, parts: list) -> None:
    """Writes arrays one after another, under a name of the attempt's own and then moved; of a task that is run twice, either's file stays, as they are the same."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        for part in parts:
            out.write(np.ascontiguousarray(part).view(np.uint8).data)
    try:
        fs.move(tmp, path)
    except OSError:  # some stores don't move onto a file that is there
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(tmp)


_mapped: OrderedDict[str, np.ndarray] = OrderedDict()
_read: OrderedDict[str, np.ndarray] = OrderedDict()
#: Files kept by a worker that maps them (systems bound how many may be), and by one that must read them whole.
MAPS, KEPT = 1000, 32


def mapped(uri: str, kind=np.uint64) -> np.ndarray:
    """The file as an array, empty where there is none: memory-mapped where the shared folder is mounted, the last MAPS of them; elsewhere read, and the last KEPT kept."""
    for kept in (_mapped, _read):
        if uri in kept:
            kept.move_to_end(uri)
            return kept[uri]
    while len(_mapped) >= MAPS:
        _mapped.popitem(last=False)  # its memory is let go when no array looks into it
    fs, path = pafs.FileSystem.from_uri(uri)
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            _mapped[uri] = np.frombuffer(pa.memory_map(path).read_buffer(), kind)
            return _mapped[uri]
        with fs.open_input_file(path) as f:
            _read[uri] = np.frombuffer(f.read_buffer(), kind)
    except FileNotFoundError:  # nothing of that shard was written
        _mapped[uri] = np.zeros(0, kind)
        return _mapped[uri]
    if len(_read) > KEPT:
        _read.popitem(last=False)
    return _read[uri]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For words of letters and digits alone: any other ASCII byte parts them, and bytes of longer characters belong to words.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POW = np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64).cumprod(dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.full(1 << n.bit_length(), 0x9E3779B97F4A7C15 | 1, np.uint64).cumprod(dtype=np.uint64)
    return _POW


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), and where each begins, with the end."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


class Words:
    """The words (runs of bytes that aren't ASCII white space, A-Z lower-cased) of some texts.

    data: lowered bytes; start, end: of each word; of: first word of each text, with the end; hash: 64 bits.
    """

    def __init__(self, texts: pa.Array, parting: np.ndarray = _SPACE):
        raw, off = text_bytes(texts)
        self.data, self.off = data, _ = _LOWER[raw], off
        self.solid = solid = np.concatenate([[False], ~parting[data], [False]])
        if len(data):
            first = solid[1:-1] & ~solid[:-2]
            edge = off[:-1][off[:-1] < off[1:]]
            first[edge] = solid[1:-1][edge]
            last = solid[1:-1] & ~solid[2:]
            edge = edge[1:] - 1
            last[edge] = solid[1:-1][edge]
            self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.of = np.searchsorted(self.start, off)
        if len(self.start):
            s = self.start[0]
            lens = np.diff(np.append(self.start, len(data)))
            at = np.arange(s, len(data)) - np.repeat(self.start, lens)
            value = np.where(solid[s + 1 : -1], _BYTE[data[s:]], np.uint64(0)) * _powers(int(lens.max()) + 1)[at]
            self.hash = mix(np.add.reduceat(value, self.start - s))
        else:
            self.hash = np.zeros(0, np.uint64)


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES):
    """Slices of a batch that hold about so many bytes of text."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
