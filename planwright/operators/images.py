"""Images as rows: kernels run one image per row in Arrow batches, results are relations again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from planwright.functions import raster

MEASURES = "plan_id long, threshold int, ink double, components long, thickness double, skeleton long"


def measured(images: DataFrame) -> DataFrame:
    """Per image (plan_id, width, height, pixels: grey bytes): threshold, ink share, components, stroke width, line length."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for plan, w, h, pixels in batch[["plan_id", "width", "height", "pixels"]].itertuples(index=False):
                gray = raster.stretch(np.frombuffer(pixels, np.uint8).reshape(h, w))
                t = int(np.clip(raster.otsu(raster.histogram(gray)), 60, 200))
                mask = gray < t
                line = raster.skeletonize(mask)
                width = 2 * raster.distance_transform(mask)[line]
                rows.append((plan, t, float(mask.mean()), raster.connected_components(mask)[1], float(np.median(width)) if len(width) else None, int(line.sum())))
            yield pd.DataFrame(rows, columns=["plan_id", "threshold", "ink", "components", "thickness", "skeleton"])

    return images.select("plan_id", "width", "height", "pixels").mapInPandas(measure, MEASURES)


def drawn(walls: DataFrame, width: int, height: int) -> DataFrame:
    """Draws each plan's wall polygons (plan_id, polygon of x, z in pixels) as a grey image."""

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), bool)
        for polygon in group["polygon"]:
            mask |= raster.fill_polygon((height, width), np.array([(p["x"], p["z"]) for p in polygon]))
        gray = np.where(mask, 0, 255).astype(np.uint8)
        return pd.DataFrame([(group["plan_id"].iloc[0], width, height, gray.tobytes())], columns=["plan_id", "width", "height", "pixels"])

    return walls.groupBy("plan_id").applyInPandas(draw, "plan_id long, width int, height int, pixels binary")
