"""Boundaries to encoders, renderers and mesh libraries: what goes in and out, not how it is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BATCH = 32
IMAGE_SIDE = 224


class Encoder(Protocol):
    """Embeds a batch of image files' contents; one row of floats for each."""

    def __call__(self, images: list[bytes]) -> np.ndarray: ...


class Renderer(Protocol):
    """PNG content of one view of a mesh under a 4 x 4 matrix."""

    def __call__(self, vertices: np.ndarray, faces: np.ndarray, mvp: np.ndarray, mode: str) -> bytes: ...


class MeshReader(Protocol):
    """Vertices and faces of a mesh file's content."""

    def __call__(self, content: bytes) -> tuple[np.ndarray, np.ndarray]: ...


def embed_views(views: DataFrame, encoder: Callable[[], Encoder], batch: int = BATCH, blank: bytes = b"") -> DataFrame:
    """(model_id, view_idx, embedding) of views (model_id, view_idx, content): rows of unit norm.

    `encoder` makes a client once in each task. An image that can't be
    embedded gets the embedding of `blank`, as a grey picture would.
    """
    kind = dict(views.dtypes)["model_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = encoder()
        for part in parts:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                images = [blank if c is None else bytes(c) for c in rows["content"]]
                try:
                    out = np.asarray(embed(images), np.float32)
                except Exception:  # one bad image: the others still count
                    out = np.concatenate([_one(embed, i, blank) for i in images])
                out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)
                yield pd.DataFrame({"model_id": rows["model_id"].values, "view_idx": rows["view_idx"].values, "embedding": list(out)})

    return views.select("model_id", "view_idx", "content").mapInPandas(run, f"model_id {kind}, view_idx int, embedding array<float>")


def _one(embed: Encoder, image: bytes, blank: bytes) -> np.ndarray:
    try:
        return np.asarray(embed([image]), np.float32)
    except Exception:
        return np.asarray(embed([blank]), np.float32)


def render_views(meshes: DataFrame, renderer: Callable[[], Renderer], modes: tuple[str, ...] = ("textured", "lfd")) -> DataFrame:
    """(model_id, view_idx, mode, content) of meshes (model_id, vertices, faces, view_idx, mvp)."""
    kind = dict(meshes.dtypes)["model_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = renderer()
        for part in parts:
            rows = [(r.model_id, r.view_idx, m, draw(np.array(r.vertices.tolist()), np.array(r.faces.tolist()), np.array(r.mvp).reshape(4, 4), m)) for r in part.itertuples() for m in modes]
            yield pd.DataFrame(rows, columns=["model_id", "view_idx", "mode", "content"])

    return meshes.mapInPandas(run, f"model_id {kind}, view_idx int, mode string, content binary")
