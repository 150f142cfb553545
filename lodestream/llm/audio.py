"""Media columns for telephony audio.

Mu-law and A-law samples are expanded by lookup tables, ADPCM blocks are decoded with numpy across blocks (each step of the codec handles
the same sample of all blocks at once), and audio is stored as resampled PCM in WAV form, beside the coded samples, which are lossless.

Defined results: null and empty texts are stored as one block of padding; a file with an unknown or broken header raises; no samples give
features of zero; equal texts give equal files and features; a row without an id is stored like any other; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, slices

UNIT = 192
RATE = 8_000
#: Rate of the PCM that is stored beside the coded samples.
PCM_RATE = RATE // 2
#: Format codes of the WAV container (fixed values).
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: Index steps of the IMA ADPCM codec by nibble (fixed values).
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
#: The 89 step sizes of the IMA ADPCM codec (fixed values).
STEP_SIZES = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767,
)


@lru_cache(maxsize=2)
def expansion(law: int) -> np.ndarray:
    """The 256 linear 16-bit samples of mu-law or A-law codes."""
    code = np.arange(256)
    if law == MULAW:
        turned = ~code & 0xFF
        size = ((((turned & 0x0F) << 3) + 0x84) << ((turned >> 4) & 7)) - 0x84
        return np.where(turned & 0x80, -size, size).astype(np.int16)
    turned = code ^ 0x55
    segment, low = (turned >> 4) & 7, (turned & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(turned & 0x80, size, -size).astype(np.int16)


def expand(codes: np.ndarray, law: int) -> np.ndarray:
    return expansion(law)[codes]


def compress(samples: np.ndarray, law: int) -> np.ndarray:
    """The code of the nearest expanded sample (the smaller code of equals): the inverse of :func:`expand` up to rounding."""
    table = expansion(law).astype(np.int32)
    order = np.argsort(table, kind="stable")
    steps = table[order]
    right = np.clip(np.searchsorted(steps, samples), 1, 255)
    left = right - 1
    nearer = np.where(samples - steps[left] <= steps[right] - samples, left, right)
    return order[nearer].astype(np.uint8)


def decode_adpcm(data: np.ndarray, block: int) -> np.ndarray:
    """Linear samples of IMA ADPCM blocks of one channel, one row per block: the header's sample, then two per byte, low nibble first."""
    blocks = data.reshape(-1, block)
    sizes = np.array(STEP_SIZES, np.int32)
    moves = np.array(INDEX_STEPS * 2, np.int32)
    predicted = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(sizes) - 1)
    # by step and nibble: what the nibble adds
    nibbles = np.arange(16)
    adds = (sizes[:, None] >> 3) + (nibbles & 1) * (sizes[:, None] >> 2) + ((nibbles >> 1) & 1) * (sizes[:, None] >> 1) + ((nibbles >> 2) & 1) * sizes[:, None]
    adds = np.where(nibbles & 8, -adds, adds).astype(np.int32).ravel()
    after = np.clip(np.arange(len(sizes))[:, None] + moves[nibbles], 0, len(sizes) - 1).astype(np.int32).ravel()
    out = np.empty((1 + 2 * (block - 4), len(blocks)), np.int16)
    out[0] = predicted
    coded = np.ascontiguousarray(blocks[:, 4:].T)
    at = 1
    for byte in coded:
        for nibble in (byte & 15, byte >> 4):
            cell = (index << 4) | nibble
            predicted += adds[cell]
            np.clip(predicted, -32768, 32767, out=predicted)
            index = after[cell]
            out[at] = predicted
            at += 1
    return out.T


def encode_adpcm(samples: np.ndarray, block: int) -> np.ndarray:
    """IMA ADPCM blocks of 16-bit samples, the last one padded with its last sample; across blocks like the decoder."""
    per = 1 + 2 * (block - 4)
    count = max(1, -(-len(samples) // per))
    padded = np.concatenate([samples, np.full(count * per - len(samples), samples[-1] if len(samples) else 0, np.int16)]).reshape(count, per).astype(np.int32)
    sizes, moves = np.array(STEP_SIZES, np.int32), np.array(INDEX_STEPS, np.int32)
    predicted, index = padded[:, 0].copy(), np.zeros(count, np.int32)
    blocks = np.zeros((count, block), np.uint8)
    blocks[:, :2] = predicted.astype("<i2").view(np.uint8).reshape(count, 2)
    for k in range(1, per):
        step, gap = sizes[index], padded[:, k] - predicted
        size = np.minimum((np.abs(gap) * 4) // step, 7)
        added = (step >> 3) + (size & 1) * (step >> 2) + ((size >> 1) & 1) * (step >> 1) + ((size >> 2) & 1) * step
        predicted = np.clip(predicted + np.where(gap < 0, -added, added), -32768, 32767)
        index = np.clip(index + moves[size], 0, len(sizes) - 1)
        code = (size | np.where(gap < 0, 8, 0)).astype(np.uint8)
        blocks[:, 4 + (k - 1) // 2] |= code if k % 2 else code << 4
    return blocks.ravel()


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate, in integers, so that every machine gives the same samples."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    if 2 * to == rate:  # the mean of each two samples
        wide = samples[: len(samples) // 2 * 2].astype(np.int32).reshape(-1, 2)
        return (wide.sum(axis=1) >> 1).astype(np.int16)
    if to == 2 * rate:  # each sample and the middle between it and the next
        wide = samples.astype(np.int32)
        out = np.empty(2 * len(samples), np.int16)
        out[::2] = samples
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
        return out
    places = np.arange(len(samples) * to // rate, dtype=np.int64) * rate
    left, part = np.minimum(places // to, len(samples) - 1), places % to
    right = np.minimum(left + 1, len(samples) - 1)
    wide = samples.astype(np.int64)
    return ((wide[left] * (to - part) + wide[right] * part) // to).astype(np.int16)


def wav(data: bytes, code: int, rate: int, bits: int, block: int) -> bytes:
    """A WAV file of one channel around coded samples."""
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if code == IMA_ADPCM else b"" if code == PCM else struct.pack("<H", 0)
    per_second = rate * block // (1 + 2 * (block - 4)) if code == IMA_ADPCM else rate * block
    form = struct.pack("<HHIIHH", code, 1, rate, per_second, block, bits) + extra
    fact = b"" if code == PCM else struct.pack("<4sII", b"fact", 4, len(data) // block * (1 + 2 * (block - 4)) if code == IMA_ADPCM else len(data))
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format code, rate, block size and coded samples of a WAV file of one channel."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, code, rate, block = 12, 0, 0, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            code, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1:
                raise ValueError("only one channel is supported")
        elif name == b"data":
            if at + 8 + size > len(media):
                raise ValueError("the file breaks off")
            return code, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("the file has no samples")


def samples_of(media: bytes) -> tuple[np.ndarray, int]:
    """Linear 16-bit samples and rate of a WAV file in any of the four codings."""
    code, rate, block, data = unwav(media)
    if code == PCM:
        return np.frombuffer(data, "<i2"), rate
    if code in (MULAW, ALAW):
        return expand(np.frombuffer(data, np.uint8), code), rate
    if code == IMA_ADPCM:
        return decode_adpcm(np.frombuffer(data, np.uint8), block).ravel(), rate
    raise ValueError(f"unknown coding {code}")


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """The text with spaces up to a positive multiple of ``unit`` bytes."""
    return text + b" " * (max(unit, -(-len(text) // unit) * unit) - len(text))


def measured(samples: np.ndarray) -> tuple[int, int, int]:
    """Root mean square (rounded down), peak, and sign changes; in integers."""
    if not len(samples):
        return 0, 0, 0
    wide = samples.astype(np.int64)
    negative = samples < 0
    return int(np.sqrt(np.dot(wide, wide) // len(wide))), int(np.abs(wide).max()), int(np.count_nonzero(negative[1:] != negative[:-1]))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, rate: int = RATE, to: int = PCM_RATE) -> DataFrame:
    """``doc_id, n_bytes, media, pcm``: each text's bytes, padded, as the mu-law samples of a WAV file, and these expanded, as PCM at the rate ``to``."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = byte_values(rows.column("text"))
                payloads = [padded(t, unit) for t in texts]
                media = [wav(p, MULAW, rate, 8, 1) for p in payloads]
                pcm = [wav(resample(expand(np.frombuffer(p, np.uint8), MULAW), rate, to).astype("<i2").tobytes(), PCM, to, 16, 2) for p in payloads]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], names=["doc_id", "n_bytes", "media", "pcm"]
                )

    selected = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return selected.mapInArrow(store, "doc_id long, n_bytes long, media binary, pcm binary")


def resampled(media: DataFrame, media_col: str = "media", to: int = 2 * RATE) -> DataFrame:
    """Replaces a media column by PCM at the rate ``to``, whatever coding its files are in; other columns stay."""

    def convert(column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in slices(batch, column):
                    at = rows.schema.get_field_index(column)
                    out = []
                    for value in rows.column(column):
                        if value.as_py() is None:
                            out.append(None)
                            continue
                        samples, rate = samples_of(value.as_py())
                        out.append(wav(resample(samples, rate, to).astype("<i2").tobytes(), PCM, to, 16, 2))
                    yield rows.set_column(at, rows.schema.field(at), pa.array(out, rows.schema.field(at).type))

        return run

    return media.mapInArrow(convert(media_col), media.schema)


def features(media: DataFrame) -> DataFrame:
    """Reads ``media`` and ``pcm`` back: payload, hashes, and features of the decoded samples and of the resampled PCM.

    The coded samples are described under each of the codings they could be heard in: mu-law, A-law, and ADPCM blocks.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "media"):
                out = []
                files = byte_values(rows.column("media"))
                parts = [unwav(m) for m in files]
                # the blocks of all rows are decoded together
                codes = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
                blocks = decode_adpcm(codes, UNIT)
                at = 0
                for media_file, pcm_file, (code, _, _, payload) in zip(files, byte_values(rows.column("pcm")), parts, strict=True):
                    count = len(payload) // UNIT
                    own = np.frombuffer(payload, np.uint8)
                    pcm, _ = samples_of(pcm_file)
                    described = {
                        "pcm": measured(pcm),
                        "mulaw": measured(expand(own, code)),
                        "alaw": measured(expand(own, ALAW)),
                        "adpcm": measured(blocks[at : at + count].ravel()),
                    }
                    at += count
                    text = ";".join(f"{k}={r},{p},{z}" for k, (r, p, z) in described.items()) + f";crc={zlib.crc32(pcm_file):08x}"
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media_file), hashlib.sha256(media_file).hexdigest(), text))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media.mapInArrow(describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
