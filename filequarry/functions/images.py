"""Images as arrays: codecs, thumbnails and perceptual hashes, in numpy."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

EDGE = 224
HASH_EDGE, HASH_FACTOR = 8, 2


def to_npy(image: np.ndarray | None) -> bytes | None:
    """An array in the npy format, never pickled."""
    if image is None:
        return None
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.load(io.BytesIO(data), allow_pickle=False)


def to_png(image: np.ndarray) -> bytes:
    """A grey or RGB image of 8 bits as PNG."""
    image = np.ascontiguousarray(image, np.uint8)
    height, width = image.shape[:2]
    rows = np.hstack([np.zeros((height, 1), np.uint8), image.reshape(height, -1)]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def to_jpeg(image: np.ndarray, quality: int = 90) -> bytes:
    """An RGB image as JPEG; needs Pillow."""
    from PIL import Image

    out = io.BytesIO()
    Image.fromarray(np.ascontiguousarray(image, np.uint8)).save(out, format="JPEG", quality=quality)
    return out.getvalue()


def from_png(data: bytes) -> np.ndarray:
    """An RGB array of a PNG of 8 bits a channel, not interlaced: grey, RGB, palette, with or without alpha (which is dropped)."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("unsupported PNG")
    width, height, _, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    image = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y, line in enumerate(lines):
        image[y] = above = _unfiltered(int(line[0]), line[1:], above, channels)
    image = image.reshape(height, width, channels)
    if colour == 3:
        return palette[image[:, :, 0]]
    return np.repeat(image[:, :, :1], 3, axis=2) if channels < 3 else image[:, :, :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    out = [0] * len(line)
    raw, up = line.tolist(), above.tolist()
    for i, x in enumerate(raw):
        left = out[i - step] if i >= step else 0
        corner = up[i - step] if i >= step else 0
        if kind == 3:
            near = (left + up[i]) // 2
        else:
            guess = left + up[i] - corner
            near = min((abs(guess - left), 0, left), (abs(guess - up[i]), 1, up[i]), (abs(guess - corner), 2, corner))[2]
        out[i] = (x + near) & 255
    return np.array(out, np.uint8)


def _filtered(size: int, target: int, support: float, kernel) -> np.ndarray:
    """The target x size matrix of a separable resampling filter, widened where it shrinks."""
    scale = size / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    weight = kernel((np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide)
    weight[np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) >= support * wide] = 0
    return weight / weight.sum(1, keepdims=True)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear interpolation with antialiasing."""
    rows, columns = _filtered(image.shape[0], height, 1.0, _triangle), _filtered(image.shape[1], width, 1.0, _triangle)
    out = np.einsum("hy,yxc->hxc", rows, image.astype(np.float64), optimize=True)
    return np.clip(np.rint(np.einsum("wx,hxc->hwc", columns, out, optimize=True)), 0, 255).astype(np.uint8)


def thumbnail(image: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """The image with its longer side brought to edge, smaller ones enlarged, and zeros to the right and below: edge x edge x 3."""
    height, width = image.shape[:2]
    longer = max(height, width)
    small = resized(image, max(1, round(height * edge / longer)), max(1, round(width * edge / longer)))
    out = np.zeros((edge, edge, 3), np.uint8)
    out[: small.shape[0], : small.shape[1]] = small
    return out


def phash(image: np.ndarray, edge: int = HASH_EDGE, factor: int = HASH_FACTOR) -> bytes:
    """Perceptual hash: grey, 16 x 16 by a Lanczos filter, cosine transform, and for each of the lowest 8 x 8 whether it is above their median.

    Bits run row by row, the first highest.
    """
    side = edge * factor
    grey = np.floor(image[:, :, :3].astype(np.float64) @ np.array([299, 587, 114]) / 1000 + 0.5)
    small = _filtered(grey.shape[0], side, 3.0, _lanczos) @ grey @ _filtered(grey.shape[1], side, 3.0, _lanczos).T
    small = np.clip(np.rint(small), 0, 255)
    at = np.arange(side)
    transform = 2 * np.cos(np.pi * np.outer(at, 2 * at + 1) / (2 * side))
    low = (transform @ small @ transform.T)[:edge, :edge]
    return np.packbits((low > np.median(low)).ravel()).tobytes()


# Mean and deviation of the colours on which common image models were trained.
_MEAN, _DEVIATION = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def pixel_values(batch: np.ndarray, edge: int = EDGE, shorter: int = 256) -> np.ndarray:
    """Images (n x height x width x 3) as a model's input: shorter side brought to `shorter`, the centre edge x edge, normalised, channels first."""
    height, width = batch.shape[1:3]
    scale = shorter / min(height, width)
    size = round(height * scale), round(width * scale)
    top, left = (size[0] - edge) // 2, (size[1] - edge) // 2
    cut = np.stack([resized(image, *size)[top : top + edge, left : left + edge] for image in batch]).astype(np.float32) / 255
    return ((cut - _MEAN) / _DEVIATION).transpose(0, 3, 1, 2).astype(np.float32)
