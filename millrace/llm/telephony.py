"""Telephony audio: mu-law and A-law expansion, ADPCM blocks, resampled PCM.

Companded samples are expanded by lookup tables that a rule builds. IMA ADPCM blocks are
decoded by numpy across all blocks of a batch: one step of the decoder runs for every block
at once. Media are WAV files, kept whole in a binary column, beside the PCM that they expand
to, resampled. The PCM is stored losslessly by lifting: every other sample as it is, and the others as
what they differ from the mean of their neighbours, which after a doubling of the rate is nothing.
``media_table`` writes both to the shared folder and gives WAV files back; features are computed
from what is read back, after decoding.

Defined cases: null bytes are empty; an empty payload is one unit of zeros; rows with equal
ids are stored each, so equal rows give equal rows; a very long text is one clip, in a batch
of its own; an empty table gives no rows; bytes that are no WAV file of a known format raise
an error that names it; other columns are kept by ``store`` and ``expand``, except ``media``
and, where it is made, ``pcm``, which are replaced; ``digests`` ignores all but id and text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, fresh, stored
from .textops import slices

UNIT, RATE = 64, 8000
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17

#: Fixed values of the IMA ADPCM format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code: sign, three bits of exponent, four of mantissa, inverted."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code: even bits inverted, then sign, exponent and mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    power, size = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(power > 0, (size + 0x100) << np.maximum(power - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks (a row each): the header's sample, then two a byte."""
    n, width = blocks.shape
    out = np.empty((n, 1 + 2 * (width - 4)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEP) - 1)
    out[:, 0] = value
    for k in range(width - 4):
        byte = blocks[:, 4 + k].astype(np.int32)
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            step = STEP[index]
            move = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
            value = np.clip(value + np.where(nibble & 8, -move, move), -32768, 32767)
            index = np.clip(index + INDEX_STEP[nibble], 0, len(STEP) - 1)
            out[:, 1 + 2 * k + half] = value
    return out


def resample_double(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; a clip's last sample is repeated. ``starts``:
    where clips start in ``pcm``."""
    after = np.append(pcm[1:], pcm[-1:])
    last = np.append(starts[1:], len(pcm)) - 1
    after[last] = pcm[last]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def wav(data: bytes, kind: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file of 8-bit companded samples, 16-bit PCM, or ADPCM blocks."""
    bits = {PCM: 16, IMA: 4}.get(kind, 8)
    align = {PCM: 2, IMA: block}.get(kind, 1)
    per = 1 + 2 * (block - 4)
    each = rate * align // per if kind == IMA else rate * align
    fmt = struct.pack("<HHIIHHH", kind, 1, rate, each, align, bits, 2 if kind == IMA else 0) + (struct.pack("<H", per) if kind == IMA else b"")
    pad = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and head:
            return head[0], head[2], head[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without format or data")


def expand_wav(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit PCM of a mono WAV file of one of the four formats."""
    kind, rate, block, data = read_wav(media)
    if kind == PCM:
        return rate, np.frombuffer(data, "<i2")
    if kind in (MULAW, ALAW):
        return rate, (MULAW_PCM if kind == MULAW else ALAW_PCM)[np.frombuffer(data, np.uint8)]
    if kind == IMA:
        return rate, decode_adpcm(np.frombuffer(data, np.uint8).reshape(-1, block)).ravel()
    raise ValueError(f"WAV format {kind} isn't known")


def resampled(media: bytes, rate: int) -> bytes:
    """The PCM WAV file of ``rate`` (a doubling of the stored one as often as needed)."""
    own, pcm = expand_wav(media)
    while own < rate and len(pcm):
        pcm, own = resample_double(pcm, np.zeros(1, np.int64)), 2 * own
    return wav(pcm.astype("<i2").tobytes(), PCM, own)


LIFTED = struct.Struct("<4sIIB")


def lift(media: bytes) -> bytes:
    """A PCM WAV file as its even samples, and what the odd ones differ from the mean of their
    neighbours (the last even one being its own neighbour); nothing for those if none differs."""
    _, rate, _, data = read_wav(media)
    pcm = np.frombuffer(data, "<i2")
    even, odd = pcm[0::2], pcm[1::2]
    rest = (odd - _between(even)[: len(odd)]).astype("<i2")
    return LIFTED.pack(b"LIFT", rate, len(pcm), bool(rest.any())) + even.tobytes() + (rest.tobytes() if rest.any() else b"")


def unlift(lifted: bytes) -> bytes:
    """The PCM WAV file that ``lift`` was given."""
    mark, rate, n, differs = LIFTED.unpack_from(lifted)
    if mark != b"LIFT":
        raise ValueError("not lifted PCM")
    even = np.frombuffer(lifted, "<i2", (n + 1) // 2, LIFTED.size)
    pcm = np.empty(n, "<i2")
    pcm[0::2] = even
    pcm[1::2] = _between(even)[: n // 2]
    if differs:
        pcm[1::2] += np.frombuffer(lifted, "<i2", n // 2, LIFTED.size + even.nbytes)
    return wav(pcm.tobytes(), PCM, rate)


def _between(even: np.ndarray) -> np.ndarray:
    wide = even.astype(np.int32)
    return ((wide + np.append(wide[1:], wide[-1:])) >> 1).astype(np.int16)


def store(docs: DataFrame, column: str = "text", kind: int = MULAW, unit: int = UNIT, rate: int | None = None, lifted: bool = False) -> DataFrame:
    """``docs`` with ``media``: the column's bytes, padded to whole units, as a WAV file; with
    ``rate`` also ``pcm``, what it expands to at that rate, as a WAV file or ``lifted``."""
    form = lift if lifted else bytes
    made = ["media"] if rate is None else ["media", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, payload, 1 << 22):
                media = []
                for x in pc.fill_null(part.column(payload), b"").to_pylist():
                    media.append(wav(x + b"\0" * (max(unit, -(-len(x) // unit) * unit) - len(x)), kind, block=unit))
                own = [media] if rate is None else [media, [form(resampled(m, rate)) for m in media]]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(o, pa.binary()) for o in own)], names=[*names, *made])

    names = [n for n in docs.columns if n not in made]
    (payload,) = fresh(docs, "__payload")
    arrow_rows(docs.sparkSession)
    schema = T.StructType([docs.schema[n] for n in names] + [T.StructField(n, T.BinaryType()) for n in made])
    return docs.select(*names, F.col(column).cast("binary").alias(payload)).mapInArrow(run, schema)


def media_files(docs: DataFrame, column: str = "text", kind: int = MULAW, unit: int = UNIT, rate: int = 16000) -> DataFrame:
    """``docs`` with ``media`` and, lifted, ``pcm``, written to the shared folder. Pages are large, as a
    page is what a codec sees at once."""
    options = {"parquet.page.size": str(8 << 20), "parquet.block.size": str(64 << 20), "parquet.enable.dictionary": "false"}
    return stored(store(docs, column, kind, unit, rate, lifted=True), "media", **options)


def media_table(docs: DataFrame, column: str = "text", kind: int = MULAW, unit: int = UNIT, rate: int = 16000) -> DataFrame:
    """``docs`` with ``media`` and ``pcm``, written to the shared folder and read back as WAV files."""
    kept = media_files(docs, column, kind, unit, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "pcm", 1 << 22):
                whole = pa.array([unlift(x) for x in part.column("pcm").to_pylist()], pa.binary())
                yield part.set_column(part.schema.get_field_index("pcm"), "pcm", whole)

    return kept.mapInArrow(run, kept.schema)


def expand(media: DataFrame, rate: int = 16000) -> DataFrame:
    """``media`` with ``media`` replaced by a PCM WAV file of ``rate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 1 << 22):
                out = [resampled(x, rate) for x in part.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, "media"])

    names = [n for n in media.columns if n != "media"]
    return media.select(*names, "media").mapInArrow(run, T.StructType([media.schema[n] for n in [*names, "media"]]))


def _per_clip(pcm: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Root mean square (rounded down), peak and zero crossings of each clip."""
    wide = pcm.astype(np.int64)
    n = np.diff(np.append(starts, len(pcm)))
    cross = np.append((wide[1:] < 0) != (wide[:-1] < 0), False).astype(np.int64)
    cross[np.append(starts[1:], len(pcm)) - 1] = 0
    power = np.add.reduceat(wide * wide, starts)
    return [np.sqrt(power // n).astype(np.int64), np.maximum.reduceat(np.abs(wide), starts), np.add.reduceat(cross, starts)]


def features(media: DataFrame, lifted: bool = False) -> DataFrame:
    """``media`` without ``pcm``, with payload (read back from ``media``) and feature. A feature holds, for the payload
    as mu-law, as A-law and as ADPCM blocks of a unit, RMS, peak and zero crossings, and the
    crc32 of the ``pcm`` samples, decoded where they are ``lifted``."""
    whole = unlift if lifted else bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                data = [read_wav(m)[3] for m in part.column("media").to_pylist()]
                sizes = np.fromiter(map(len, data), np.int64, len(data))
                starts = np.cumsum(sizes) - sizes
                code = np.frombuffer(b"".join(data), np.uint8)
                adpcm = decode_adpcm(code.reshape(-1, UNIT))
                told = [*_per_clip(MULAW_PCM[code], starts), *_per_clip(ALAW_PCM[code], starts), *_per_clip(adpcm.ravel(), starts // UNIT * adpcm.shape[1])]
                crc = [zlib.crc32(read_wav(whole(m))[3]) for m in part.column("pcm").to_pylist()]
                feature = [":".join(map(str, x)) for x in zip(*(t.tolist() for t in told), crc, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(data, pa.binary()), pa.array(feature)], names=[*names, "payload", "feature"])

    names = [n for n in media.columns if n not in ("pcm", "payload", "feature")]
    schema = T.StructType([media.schema[n] for n in names] + [T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())])
    arrow_rows(media.sparkSession, 64)
    return media.select(*names, "pcm").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """The features, with digests of what was stored and read back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("media"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = features(media_files(rows, "media"), lifted=True)
    tail = F.substring("payload", -UNIT, UNIT)
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
