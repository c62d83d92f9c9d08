"""Connected components, of a few links inside a task and of a distributed table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import cut
from galena.operators.components import components


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        if np.array_equal(before, label):
            break
    return label


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node of its component) for links (a, b) of type long; nodes that are linked to themselves only are left out.

    Alternating stars: hubs and long chains of any size are spread over all tasks, and there is no bound on rounds.
    """
    found = components(links.where("a <> b"))
    return cut(found.select(F.col("id").alias("node"), F.col("cluster").alias("label")))
