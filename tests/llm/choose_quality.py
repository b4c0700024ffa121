"""Choose the lengths of op9's three kinds of terms without the held-out fold, then judge the choice on it once.

``python tests/llm/choose_quality.py FOLDER`` with the folder of ``documents.parquet`` and ``labels.parquet``. The labelled documents outside the
held-out fold are split in two by a hash of the id: one half teaches, the other judges every setting of a fixed grid. Only the ratios of the lengths
matter, so the runs' length is fixed; the grid reaches far to both sides. The best accuracy wins, then the greatest length of words, then the least of measures. The winner is then learned from
the whole training fold's sample and judged on the held-out fold, and each kind's share of the latent vectors' squared length is printed.
"""

import itertools
import os
import sys
import zlib

import duckdb
import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tradeloom.llm import quality  # noqa: E402

GRID = list(itertools.product((3840, 1920, 960, 480, 240, 120, 60, 30, 15), (120,), (15, 30, 60, 120, 240, 480, 960, 1920)))


def accuracy(x, y, teach, judge, share) -> float:
    voters = quality.fit(x[teach].copy(), y[teach], share)
    near = voters.project(x[judge]) @ voters.vectors.T
    last = np.partition(near, -quality.NEIGHBOURS, axis=1)[:, -quality.NEIGHBOURS, None]
    w = np.where(near >= last, np.maximum(near, 0) ** quality.SHARPNESS, 0) * voters.votes
    return float((((w @ voters.labels + 5e-10) / (w.sum(axis=1) + 1e-9) >= quality.ACCEPT) == (y[judge] == 1)).mean())


def main(folder: str) -> None:
    rows = duckdb.sql(f"SELECT DISTINCT ON (doc_id) doc_id, text, quality FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) WHERE quality IN (0, 1) ORDER BY doc_id, text").fetchall()
    ids, y = [str(r[0]).encode() for r in rows], np.array([r[2] for r in rows])
    held_out = np.array([zlib.crc32(i) % quality.FOLDS == quality.HELD_OUT for i in ids])
    order = np.argsort([zlib.crc32(b"half" + i) for i in ids])
    known = order[~held_out[order]]
    halves = known[: len(known) // 2], known[len(known) // 2 :]
    sampled = lambda rows: np.sort(np.concatenate([rows[y[rows] == k][: quality.SAMPLE] for k in (0, 1)]))
    share = float(y[known].mean())

    def unit(some: np.ndarray) -> np.ndarray:
        """Terms with every kind at length 1, from which any setting is a scaling."""
        quality.WORD_LENGTH = quality.RUN_LENGTH = quality.MEASURE_LENGTH = 1.0
        return quality.terms([rows[i][1] for i in some])

    parts = [slice(0, quality.WORDS), slice(quality.WORDS, quality.WORDS + quality.RUNS), slice(quality.WORDS + quality.RUNS, quality.TERMS)]

    def scaled(x: np.ndarray, setting: tuple) -> np.ndarray:
        out = x.copy()
        for part, length in zip(parts, setting):
            out[:, part] *= length
        return out

    def judged(setting: tuple, teach: np.ndarray, judge: np.ndarray, x: np.ndarray) -> float:
        return accuracy(scaled(x, setting), y[np.concatenate([teach, judge])], np.arange(len(teach)), np.arange(len(teach), len(teach) + len(judge)), share)

    teach, judge = sampled(halves[0]), halves[1]
    x = unit(np.concatenate([teach, judge]))
    found = {s: judged(s, teach, judge, x) for s in GRID}
    for s, a in found.items():
        print(*s, f"{a:.5f}", flush=True)
    best = max(GRID, key=lambda s: (found[s], -GRID.index(s)))
    teach, judge = sampled(known), np.flatnonzero(held_out)
    x = unit(np.concatenate([teach, judge]))
    print("chosen", *best, "held out", f"{judged(best, teach, judge, x):.5f}", "of", int(held_out.sum()))
    taught = scaled(x[: len(teach)], best)
    voters = quality.fit(taught, y[teach], share)
    each = np.array([((taught[:, p] @ voters.basis[p]) ** 2).sum() for p in parts])
    print("shares of words, runs, measures", *(each / each.sum()).round(4))


if __name__ == "__main__":
    main(sys.argv[1])
