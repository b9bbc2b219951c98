"""Runs of words that very many texts share, found in a bounded sample.

The result only decides how work is dealt out or ordered (hot runs go last), never what
is found, so a sample is enough and its size may be bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.llm.words import U, Words, pieces, runs, signed

SAMPLE_TEXTS = 200_000
SAMPLE_SHARE = 64  # one text in so many at most
MOST_RUNS = 65_536


def hot_runs(texts: DataFrame, n: int, table: bytes | None = None) -> np.ndarray:
    """Sorted hashes of runs of n words in over 0.2 % of a sample of texts, and 8 of them.

    texts has k1, k2 and text. At most MOST_RUNS, the most frequent ones.
    """
    rows = texts.count()
    one_in = max(SAMPLE_SHARE, rows // SAMPLE_TEXTS)
    sample = texts.where(F.pmod(F.xxhash64("k1", "k2", F.lit(3)), F.lit(one_in)) == 0).select("text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in pieces(batch, "text", 1 << 20):
                words = Words(some, table)
                ok = words.whole(n)
                found = runs(words.hashes(), n)[ok]
                pairs = np.unique(np.stack([words.doc[ok].astype(U), found]), axis=1)[1] if len(found) else found
                yield pa.record_batch({"run": pa.array(signed(np.ascontiguousarray(pairs)))})

    counts = sample.mapInArrow(distinct, "run long").groupBy("run").count()
    hot = counts.where(F.col("count") >= max(8, rows // one_in // 500))
    top = hot.orderBy(F.desc("count"), "run").limit(MOST_RUNS).select("run").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(U))


def is_hot(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(hashes), bool)
    return hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
