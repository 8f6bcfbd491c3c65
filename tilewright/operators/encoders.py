"""Forward passes of two small image encoders in NumPy, and a corpus run that keeps its provenance.

Weights are given by name as arrays; images are ``[n, bands, rows, columns]``. Both encoders standardize by band, set
invalid pixels to 0 and give rows of unit length, so they fit the embedder interface.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from tilewright.sources import catalog

GROUPS = 8
_ERF = np.frompyfunc(math.erf, 1, 1)


def standardized_images(images: np.ndarray, mean: np.ndarray, deviation: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """``(x - mean) / deviation`` by band, 0 where ``valid[n, rows, columns]`` is false."""
    if images.ndim != 4 or images.shape[1] != len(mean):
        raise ValueError(f"images of {len(mean)} bands are expected, not of shape {images.shape}")
    if (deviation <= 0).any() or not (np.isfinite(mean).all() and np.isfinite(deviation).all()):
        raise ValueError("means and deviations of bands are out of range")
    out = (images - mean[None, :, None, None]) / deviation[None, :, None, None]
    return out if valid is None else np.where(valid[:, None], out, 0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A 3 by 3 convolution with stride 2 and a rim of zeros; ``kernel`` is ``[out, in, 3, 3]``."""
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    windows = sliding_window_view(padded, (3, 3), axis=(2, 3))[:, :, ::2, ::2]
    return np.einsum("nchwij,ocij->nohw", windows, kernel, optimize=True)


def _group_normed(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    parts = x.reshape(len(x), GROUPS, -1)
    normed = (parts - parts.mean(axis=2, keepdims=True)) / np.sqrt(parts.var(axis=2, keepdims=True) + eps)
    return normed.reshape(x.shape) * scale[None, :, None, None] + shift[None, :, None, None]


@dataclass(frozen=True)
class Convolutional:
    """Three stages of convolution, group norm and SiLU, then the mean over pixels and a projection.

    Weights: ``mean, deviation``, for k in 0..2 ``kernel_k, scale_k, shift_k``, and ``project, offset``.
    """

    weights: Mapping[str, np.ndarray]

    def __call__(self, images: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
        w = self.weights
        x = standardized_images(images, w["mean"], w["deviation"], valid)
        for k in range(3):
            x = _group_normed(_convolved(x, w[f"kernel_{k}"]), w[f"scale_{k}"], w[f"shift_{k}"])
            x = x / (1 + np.exp(-x))
        return _unit(x.mean(axis=(2, 3)) @ w["project"].T + w["offset"])


def _layer_normed(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps) * scale + shift


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Transformer:
    """Patches as tokens with a class token before them, pre-normed attention blocks, the class token projected.

    Weights: ``mean, deviation, patch, patch_offset, class_token, places``; by block b ``norm1_b, norm1_shift_b, qkv_b,
    qkv_offset_b, out_b, out_offset_b, norm2_b, norm2_shift_b, up_b, up_offset_b, down_b, down_offset_b``; then
    ``norm, norm_shift, project, offset``. Linear weights are ``[out, in]``; a patch is laid out band by band, row by row.
    """

    weights: Mapping[str, np.ndarray]
    patch: int
    heads: int
    depth: int

    def __call__(self, images: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
        w, p = self.weights, self.patch
        x = standardized_images(images, w["mean"], w["deviation"], valid)
        n, bands, rows, cols = x.shape
        if rows % p or cols % p:
            raise ValueError("patches do not fill the image")
        cells = x.reshape(n, bands, rows // p, p, cols // p, p).transpose(0, 2, 4, 1, 3, 5).reshape(n, -1, bands * p * p)
        tokens = cells @ w["patch"].T + w["patch_offset"]
        tokens = np.concatenate((np.broadcast_to(w["class_token"], (n, 1, tokens.shape[2])), tokens), axis=1) + w["places"]
        for b in range(self.depth):
            tokens = tokens + self._attended(_layer_normed(tokens, w[f"norm1_{b}"], w[f"norm1_shift_{b}"]), b)
            hidden = _layer_normed(tokens, w[f"norm2_{b}"], w[f"norm2_shift_{b}"]) @ w[f"up_{b}"].T + w[f"up_offset_{b}"]
            hidden = hidden * (0.5 * (1 + _ERF(hidden / math.sqrt(2)).astype(float)))
            tokens = tokens + hidden @ w[f"down_{b}"].T + w[f"down_offset_{b}"]
        first = _layer_normed(tokens[:, 0], w["norm"], w["norm_shift"])
        return _unit(first @ w["project"].T + w["offset"])

    def _attended(self, x: np.ndarray, b: int) -> np.ndarray:
        w, (n, count, wide) = self.weights, x.shape
        each = wide // self.heads
        q, k, v = (x @ w[f"qkv_{b}"].T + w[f"qkv_offset_{b}"]).reshape(n, count, 3, self.heads, each).transpose(2, 0, 3, 1, 4)
        mixed = _softmax(q @ k.transpose(0, 1, 3, 2) / math.sqrt(each)) @ v
        return mixed.transpose(0, 2, 1, 3).reshape(n, count, wide) @ w[f"out_{b}"].T + w[f"out_offset_{b}"]


def encode_tiles(tiles: DataFrame, encoder: Convolutional | Transformer, shape: tuple[int, int, int]) -> DataFrame:
    """``tile_id, embedding`` of ``tiles(tile_id, values)``, whose values are a tile's bands, rows and columns laid out in turn.

    A tile of another size is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                flat = part.column("values").flatten().to_numpy(zero_copy_only=False).astype(float)
                if len(flat) != part.num_rows * math.prod(shape):
                    raise ValueError(f"tiles must have the shape {shape}")
                made = encoder(flat.reshape(part.num_rows, *shape)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("tile_id"), pa.array(made.tolist(), pa.list_(pa.float32()))], ["tile_id", "embedding"])

    return tiles.select("tile_id", "values").mapInArrow(run, "tile_id string, embedding array<float>")


def embed_corpus(tiles: DataFrame, splits: DataFrame, encoder: Convolutional | Transformer, shape: tuple[int, int, int], path: str, **provenance: object) -> DataFrame:
    """Embeddings of all ``tiles`` with their split, written as a checked artifact with its provenance; a tile without a split is an error."""
    absent = tiles.join(splits, "tile_id", "left_anti").limit(3).collect()
    if absent:
        raise ValueError(f"tiles without a split: {sorted(r.tile_id for r in absent)}")
    made = encode_tiles(tiles, encoder, shape).join(splits.select("tile_id", "split"), "tile_id")
    catalog.write_embeddings(made, path, encoder=type(encoder).__name__, shape=list(shape), **provenance)
    return catalog.read_embeddings(tiles.sparkSession, path)
