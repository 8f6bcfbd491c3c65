"""Embedders behind one interface, run over tiles in batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """Turns a batch of equal-sized inputs into rows of a matrix."""

    def __call__(self, batch: np.ndarray) -> np.ndarray: ...


class BandMeans:
    """A plain embedder: standardized inputs through a seeded projection."""

    def __init__(self, size: int, seed: int = 0):
        self.size, self.seed = size, seed

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        weights = np.random.default_rng(self.seed).normal(size=(batch.shape[1], self.size))
        return batch @ weights


def embed(tiles: DataFrame, embedder: Embedder) -> DataFrame:
    """``tile_id, embedding`` of ``tiles(tile_id, values)``, scaled to unit length; a zero vector is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("values")
            matrix = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1) if len(values) else np.zeros((0, 1))
            out = embedder(matrix) if len(values) else np.zeros((0, 1))
            long = np.linalg.norm(out, axis=1, keepdims=True)
            if (long <= 1e-12).any():
                raise ValueError("an embedding has no length")
            rows = pa.array((out / long).astype(np.float32).tolist(), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("tile_id"), rows], ["tile_id", "embedding"])

    return tiles.select("tile_id", "values").mapInArrow(run, "tile_id string, embedding array<float>")
