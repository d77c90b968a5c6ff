"""Pictures: decoding, thumbnails, hashes and embeddings over rows of image files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filequarry.functions import images
from filequarry.sources import xmp

#: Decoders by the first bytes of a file: bytes -> (RGB array, truncated). A library for other formats is registered here.
DECODERS: dict[bytes, Callable[[bytes], tuple[np.ndarray, bool]]] = {b"\x89PNG": lambda data: (images.from_png(data), False)}


def _pillow(data: bytes) -> tuple[np.ndarray, bool]:
    import io

    from PIL import Image

    with Image.open(io.BytesIO(data)) as image:
        try:
            return np.asarray(image.convert("RGB")), False
        except OSError:
            from PIL import ImageFile

            ImageFile.LOAD_TRUNCATED_IMAGES = True
            try:
                with Image.open(io.BytesIO(data)) as again:
                    return np.asarray(again.convert("RGB")), True
            finally:
                ImageFile.LOAD_TRUNCATED_IMAGES = False


def decode(data: bytes, decoders: dict | None = None) -> tuple[np.ndarray, bool]:
    """An RGB array and whether the file is truncated; by a registered decoder, else by Pillow where it is installed."""
    for mark, decoder in (decoders or DECODERS).items():
        if data.startswith(mark):
            return decoder(data)
    try:
        return _pillow(data)
    except ImportError as e:
        raise ValueError("no decoder for this format") from e


def thumbnails(files: DataFrame, key: str = "id") -> DataFrame:
    """key, thumbarray (npy, 224 x 224 x 3), phash, truncated, xmp, error for each row of key and content. A broken image is a row with error set.

    Set spark.sql.execution.arrow.maxRecordsPerBatch low (16 or so) where images are large: a task holds one batch at a time.
    """
    decoders = dict(DECODERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [_thumbnail(data, decoders) for data in batch["content"]]
            columns = dict(zip(("thumbarray", "phash", "truncated", "error"), zip(*out, strict=True), strict=True)) if out else {}
            yield pd.DataFrame({key: batch[key], **{n: list(c) for n, c in columns.items()}, "xmp": [xmp.flat(data) for data in batch["content"]]})

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInPandas(run, f"`{key}` {kind}, thumbarray binary, phash binary, truncated boolean, error string, xmp map<string,string>")


def _thumbnail(data, decoders: dict) -> tuple:
    if data is None:
        return None, None, None, "no content"
    try:
        image, truncated = decode(bytes(data), decoders)
        small = images.thumbnail(image)
        return images.to_npy(small), images.phash(small), truncated, None
    except Exception as e:  # noqa: BLE001  a broken image is one row, not the end of the run
        return None, None, None, f"{type(e).__name__}: {e}"[:500]


def spark_images(spark: SparkSession, root: str) -> DataFrame:
    """Images that the JVM decodes (JPEG, PNG, GIF, BMP, TIFF) as path, content (PNG, RGB) and error: for formats without a Python decoder."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, w, c, data in zip(batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                if h < 0:
                    out.append((None, "not an image"))
                    continue
                array = np.frombuffer(data, np.uint8).reshape(h, w, c)
                out.append((images.to_png(np.repeat(array, 3, axis=2) if c == 1 else array[:, :, 2::-1]), None))
            yield pd.DataFrame({"path": batch["origin"], "content": [o[0] for o in out], "error": [o[1] for o in out]})

    return rows.mapInPandas(run, "path string, content binary, error string")


def phash_column(thumbarray: Column) -> Column:
    """The perceptual hash of stored thumbnails; null for null."""

    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else images.phash(images.from_npy(bytes(a))))

    return F.pandas_udf(run, "binary")(thumbarray)


def png_column(thumbarray: Column) -> Column:
    """Stored thumbnails as PNG files."""

    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else images.to_png(images.from_npy(bytes(a))))

    return F.pandas_udf(run, "binary")(thumbarray)


def delivered(failed: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Failures that no later try delivered: failed left anti done."""
    return failed.join(done.select(key), key, "left_anti")


def embeddings(pictures: DataFrame, make_predict: Callable, key: str = "id", batch_size: int = 100) -> DataFrame:
    """key and vector for pictures with thumbnails. make_predict() -> (n x 224 x 224 x 3 uint8 array -> n x d array) loads a model once a worker.

    Batches stream through a task; no more than batch_size images are held as arrays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                some = batch.iloc[start : start + batch_size]
                vectors = np.asarray(predict(np.stack([images.from_npy(bytes(a)) for a in some["thumbarray"]])), np.float32).reshape(len(some), -1)
                yield pd.DataFrame({key: some[key].to_numpy(), "vector": list(vectors)})

    rows = pictures.where(F.col("thumbarray").isNotNull()).select(key, "thumbarray")
    return rows.mapInPandas(run, f"`{key}` {pictures.schema[key].dataType.simpleString()}, vector array<float>")


def grid_model(cells: int = 8, channels: int = 3) -> Callable:
    """A model without weights, for trying the pipeline: mean colours of a grid of cells, centred; with 4 channels their mean as well."""

    def make():
        def predict(batch: np.ndarray) -> np.ndarray:
            n, h, w, c = batch.shape
            means = batch.reshape(n, cells, h // cells, cells, w // cells, c).mean(axis=(2, 4)) / 255.0
            means = np.concatenate([means, means.mean(axis=3, keepdims=True)], axis=3)[..., :channels].reshape(n, -1)
            return means - means.mean(axis=1, keepdims=True)

        return predict

    return make


def onnx_model(path: str, output: str = "pooler_output") -> Callable:
    """A model in the ONNX format, from a file that every executor sees: it takes pixel values (n x 3 x 224 x 224) and gives a vector each.

    output names the result that is taken; if the model has none of this name, its last one is, of a sequence the first entry.
    """

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        entrance, names = session.get_inputs()[0].name, [o.name for o in session.get_outputs()]

        def predict(batch: np.ndarray) -> np.ndarray:
            found = session.run([output if output in names else names[-1]], {entrance: images.pixel_values(batch)})[0]
            return found[:, 0] if found.ndim == 3 else found

        return predict

    return make


def transformers_model(folder: str, device: str = "cpu") -> Callable:
    """A vision model of the transformers library, from a folder that every executor sees; its pooled output is the vector."""

    def make():
        import torch
        from transformers import AutoModel

        model = AutoModel.from_pretrained(folder).to(device).eval()

        def predict(batch: np.ndarray) -> np.ndarray:
            with torch.inference_mode():
                return model(pixel_values=torch.from_numpy(images.pixel_values(batch)).to(device)).pooler_output.cpu().numpy()

        return predict

    return make
