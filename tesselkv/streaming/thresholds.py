"""A value threshold that follows the sizes of written values."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame

from tesselkv.functions.sketches import log_histogram


class ThresholdTracker:
    """Adds each batch's log histogram to those before; some thousand buckets at most.

    ``threshold`` is the size at ``percentile`` (a share from 0 to 1) of all values
    seen, within ``least`` and ``most``; 0 and no values give ``least``.
    """

    def __init__(self, percentile: float, least: int, most: int):
        if not 0 <= percentile <= 1 or not 0 < least <= most:
            raise ValueError("a share from 0 to 1, and 0 < least <= most")
        self.percentile, self.least, self.most = percentile, least, most
        self.buckets: Counter[int] = Counter()
        self.last_batch = -1

    def observe(self, batch: DataFrame, batch_id: int, size: str = "size") -> None:
        """For ``foreachBatch``; a batch that comes again counts once."""
        if batch_id > self.last_batch:
            self.buckets.update({r.bucket: r.n for r in log_histogram(batch, size).select("bucket", "n").collect()})
            self.last_batch = batch_id

    @property
    def threshold(self) -> int:
        total = sum(self.buckets.values())
        if not total or not self.percentile:
            return self.least
        need, upto = total * self.percentile, 0
        for bucket in sorted(self.buckets):
            upto += self.buckets[bucket]
            if upto >= need:
                break
        return min(self.most, max(self.least, round(math.exp(bucket / 100) - 1)))

    def clear(self) -> None:
        """Forgets all sizes."""
        self.buckets.clear()
