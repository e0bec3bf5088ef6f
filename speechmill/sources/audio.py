"""Audio files: header probes, samples, and a sink that joins segments to WAV files.

Files are read by Spark's ``binaryFile``; a probe sends only the first ``HEADER_BYTES`` of each to Python. The sink is a
Python data source: each task writes an item's segments, in order and as they come, to files under other names,
and the driver renames them when all tasks have succeeded; if one fails, they are deleted. So no half file is ever
under its own name, and a task that runs again writes under a name of its own. Paths are opened through Arrow's file
systems, so they may lie in any store that all executors reach.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

HEADER_BYTES = 65_536
# WAV format codes, and the largest sample of 16 bits.
PCM, FLOAT, EXTENSIBLE, FULL_SCALE = 1, 3, 0xFFFE, 32767


@dataclass
class Header:
    rate: int
    channels: int
    bits: int
    code: int
    frames: int
    data_at: int = 0


def wav_header(head: bytes, length: int) -> Header | None:
    """What the chunks before the samples say; a size that is open or beyond the file counts as the rest of it."""
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head):
            code, channels, rate, _, width, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            if code == EXTENSIBLE and at + 34 <= len(head):
                code = struct.unpack_from("<H", head, at + 32)[0]
            form = (code, channels, rate, width, bits)
        if name == b"data":
            if form is None or not form[2] or not form[3]:
                return None
            return Header(form[2], form[1], form[4], form[0], min(size, length - at - 8) // form[3], at + 8)
        at += 8 + size + size % 2
    return None


def flac_header(head: bytes) -> Header | None:
    if head[:4] != b"fLaC" or len(head) < 26:
        return None
    packed = int.from_bytes(head[18:26], "big")  # 20 bits of rate, 3 of channels, 5 of bits, 36 of frames
    rate = packed >> 44
    return Header(rate, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, 0, packed & ((1 << 36) - 1)) if rate else None


def probe(files: DataFrame) -> DataFrame:
    """path, seconds, rate, channels of ``binaryFile`` rows, from their headers; seconds are -1 where none can be read.

    ``binaryFile`` itself passes over empty files, so these have no row.
    """
    given = files.select("path", F.col("length").cast("long").alias("length"), F.substring("content", 1, HEADER_BYTES).alias("head"))

    def probed(batches):
        for batch in batches:
            out = []
            for path, length, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = head or b""
                found = wav_header(head, length) or flac_header(head)
                out.append({"path": path, "seconds": found.frames / found.rate if found else -1.0, "rate": found and found.rate, "channels": found and found.channels})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("seconds", pa.float64()), ("rate", pa.int32()), ("channels", pa.int32())]))

    return given.mapInArrow(probed, "path string, seconds double, rate int, channels int")


def durations(spark: SparkSession, path: str, glob: str = "*.{wav,flac}") -> DataFrame:
    return probe(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def decoded(content: bytes) -> tuple[int, np.ndarray] | None:
    """Rate and samples (-1 to 1, channels averaged) of a WAV file of 16 or 32 bits, whole numbers or floats."""
    found = wav_header(content[:HEADER_BYTES], len(content))
    kinds = {(PCM, 16): "<i2", (PCM, 32): "<i4", (FLOAT, 32): "<f4", (FLOAT, 64): "<f8"}
    if found is None or (found.code, found.bits) not in kinds:
        return None
    raw = np.frombuffer(content, kinds[found.code, found.bits], found.frames * found.channels, found.data_at).astype(np.float64)
    scale = 1.0 if found.code == FLOAT else float(2 ** (found.bits - 1) - 1)
    return found.rate, raw.reshape(-1, found.channels).mean(axis=1) / scale


def waves(files: DataFrame) -> DataFrame:
    """path, rate, wave of ``binaryFile`` rows; rate and wave are null where the samples can't be read. A file is one row."""
    schema = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("wave", pa.list_(pa.float64()))])

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = decoded(content.as_py() or b"")
                yield pa.RecordBatch.from_pylist([{"path": path, "rate": found and found[0], "wave": None if found is None else found[1]}], schema)

    return files.select("path", "content").mapInArrow(read, "path string, rate int, wave array<double>")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.rate = options["path"].rstrip("/"), int(options["rate"])

    def _store(self):
        store, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        return store, root.rstrip("/")

    def write(self, iterator) -> Written:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        mark, files, item, out, left = uuid.uuid4().hex, [], None, None, 0

        def close():
            if out is not None:
                out.close()
                if left:
                    raise ValueError(f"{item}: {left} samples fewer than announced")

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["item"] != item:
                        close()
                        item, left = row["item"], row["total"]
                        files.append((f"{root}/.{item}.{mark}", f"{root}/{item}.wav"))
                        out = store.open_output_stream(files[-1][0])
                        out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * left, b"WAVE", b"fmt ", 16, PCM, 1, self.rate, 2 * self.rate, 2, 16, b"data", 2 * left))
                    samples = np.array(row["samples"], np.float64)
                    out.write(np.rint(samples * FULL_SCALE).clip(-FULL_SCALE, FULL_SCALE).astype("<i2").tobytes())
                    out.write(bytes(2 * row["silence"]))
                    left -= len(samples) + row["silence"]
            close()
        except Exception:
            if out is not None and not out.closed:
                out.close()
            _delete(store, [f for f, _ in files])
            raise
        return Written(files)

    def commit(self, messages) -> None:
        store, _ = self._store()
        for message in messages:
            for aside, final in message.files if message else ():
                store.move(aside, final)

    def abort(self, messages) -> None:
        store, _ = self._store()
        _delete(store, [aside for m in messages if m for aside, _ in m.files])


def _delete(store, paths: list[str]) -> None:
    for path in paths:
        if store.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
            store.delete_file(path)


class WavSink(DataSource):
    """``format("wavs")``: rows (item, total, samples, silence), sorted by item and place in each partition."""

    @classmethod
    def name(cls) -> str:
        return "wavs"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_wavs(segments: DataFrame, folder: str, rate: int) -> None:
    """One file ITEM.wav of 16 bits for each item of (item, pos, samples, silence_after_ms): its segments and silences in order.

    An item is written by one task, which holds one segment at a time.
    """
    segments.sparkSession.dataSource.register(WavSink)
    silence = F.floor(F.greatest(F.coalesce("silence_after_ms", F.lit(0)), F.lit(0)) * F.lit(rate) / 1000).cast("long")
    rows = segments.select(F.col("item").cast("string").alias("item"), "pos", F.coalesce(F.col("samples").cast("array<double>"), F.array().cast("array<double>")).alias("samples"), silence.alias("silence"))
    totals = rows.groupBy("item").agg(F.sum(F.size("samples") + F.col("silence")).alias("total"))
    ready = rows.join(totals, "item").repartition("item").sortWithinPartitions("item", "pos")
    ready.select("item", "total", "samples", "silence").write.format("wavs").mode("append").option("path", folder).option("rate", str(rate)).save()
