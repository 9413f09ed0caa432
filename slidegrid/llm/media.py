"""Media columns: bytes stored as progressive JPEGs, read back as coefficients and as RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm import jpeg
from slidegrid.llm.common import STEP, quoted, steps, text_bytes


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def tensors(images: list[jpeg.Image]) -> Iterator[np.ndarray]:
    """RGB tensors of the images; those that are one unit wide go through the transform together."""
    narrow = [i for i in images if i.width == 16 and [(c.h, c.v, c.quant) for c in i.components] == [(2, 2, 0), (1, 1, 0), (1, 1, 0)] and i.height % 16 == 0]
    if len(narrow) < 2 or any((i.quants[0] != narrow[0].quants[0]).any() for i in narrow):
        narrow = []
    tall = None
    if narrow:
        parts = [jpeg.Component(c.h, c.v, c.quant, c.across, 0, c.whole_across, np.concatenate([i.components[k].coefficients for i in narrow])) for k, c in enumerate(narrow[0].components)]
        tall = jpeg.rgb(jpeg.Image(sum(i.height for i in narrow), 16, parts, narrow[0].quants))
    at, together = 0, set(map(id, narrow))
    for i in images:
        if id(i) in together:
            yield tall[at : at + i.height]
            at += i.height
        else:
            yield jpeg.rgb(i)


def feature(tensor: np.ndarray) -> str:
    """Height, width, and for each colour the sum of its samples, of their squares and of the steps down the image."""
    level = np.arange(256)
    counts = [np.bincount(tensor[:, :, k].ravel(), minlength=256) for k in range(3)]
    down = abs(np.diff(tensor.astype(np.int16), axis=0))
    parts = ([int(n @ level) for n in counts], [int(n @ (level * level)) for n in counts], [int(down[:, :, k].sum(dtype=np.int64)) for k in range(3)])
    return ";".join([f"{tensor.shape[0]}x{tensor.shape[1]}", *(",".join(map(str, p)) for p in parts)])


def encode(docs: DataFrame, data_col: str = "data", id_col: str = "doc_id") -> DataFrame:
    """id, media: each row's bytes (null: none), padded to a positive multiple of 64, as a progressive JPEG."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(jpeg.store_all([padded(x.as_py() or b"") for x in b.column(1)]), pa.binary())], ["id", "media"])

    kept = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(data_col)).cast("binary").alias("data"))
    return kept.mapInArrow(work, f"id {kept.schema['id'].dataType.simpleString()}, media binary")


def decode(stored: DataFrame, media_col: str = "media", id_col: str = "id") -> DataFrame:
    """id, payload, height, width, rgb: the stored bytes and the full-resolution tensor of each JPEG (row by row, 3 bytes a sample).

    Null media give nulls. Tensors of JPEGs that encode() did not write are given too, with a null payload.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                image = jpeg.decode(y.as_py()) if y.as_py() is not None else None
                tensor = jpeg.rgb(image) if image else None
                own = jpeg.payload(image) if image and image.comment.startswith(b"payload=") else None
                columns = ([own], [image.height if image else None], [image.width if image else None], [tensor.tobytes() if image else None])
                kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], b.column(0).type), *map(pa.array, columns, kinds)], ["id", "payload", "height", "width", "rgb"])

    kept = stored.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(media_col)).alias("media"))
    return kept.mapInArrow(work, f"id {kept.schema['id'].dataType.simpleString()}, payload binary, height int, width int, rgb binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and digests of each text's payload as read back from its JPEG, of the JPEG, and of its RGB tensor.

    Stores, reads and transforms as encode() and decode() do, in one pass, so that media stay in the
    task. Null and empty texts are 64 zero bytes; repeated rows each stay; an empty table gives no rows.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows: list[tuple] = []
            for a, b in steps(offsets, STEP // 8):
                whole = data[offsets[a] : offsets[b]].tobytes()
                cut = (offsets[a : b + 1] - offsets[a]).tolist()
                media = jpeg.store_all([padded(whole[x:y]) for x, y in zip(cut, cut[1:], strict=False)])
                images = list(map(jpeg.decode, media))
                for k, (m, image, tensor) in enumerate(zip(media, images, tensors(images), strict=True)):
                    back = jpeg.payload(image)
                    rows.append((
                        cut[k + 1] - cut[k], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]),
                        len(m), hashlib.sha256(m).hexdigest(), feature(tensor),
                    ))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    kept = docs.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return kept.mapInArrow(work, "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
