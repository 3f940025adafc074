"""Words of scripts without spaces, by a dictionary."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from pathlib import Path

import pyarrow as pa


def load(path: str) -> dict[str, int]:
    """A word a line, with its frequency behind a space (1 without); what follows is not read, # begins a comment."""
    found = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        word, *rest = line.partition("#")[0].split()[:2] or [""]
        if word:
            found[word] = max(int(rest[0]), 1) if rest and rest[0].isdigit() else 1
    return found


def segmenter(words: Mapping[str, int]) -> Callable[[str], list[str]]:
    """A function that cuts a run of characters into the words whose frequencies have the greatest product.

    Characters that no word covers stand alone, as rare words do.
    It holds nothing but the dictionary, so that it can travel to executors without this module.
    """
    total = max(sum(words.values()), 1)
    weight = {w: math.log(n / total) for w, n in words.items()}
    longest = max(map(len, words), default=1)
    alone = -math.log(total) - 1

    def cut(run: str) -> list[str]:
        score, start = [0.0], [0]
        for end in range(1, len(run) + 1):
            best, at = score[end - 1] + weight.get(run[end - 1], alone), end - 1
            for i in range(max(0, end - longest), end - 1):
                w = weight.get(run[i:end])
                if w is not None and score[i] + w > best:
                    best, at = score[i] + w, i
            score.append(best)
            start.append(at)
        out, end = [], len(run)
        while end:
            out.append(run[start[end] : end])
            end = start[end]
        return out[::-1]

    return cut


def cut_arrays(words: Mapping[str, int]) -> Callable[[pa.Array], pa.Array]:
    """Arrays of pieces to arrays of words: pieces of ASCII stay, all else is cut."""
    cut = segmenter(words)

    def run(pieces: pa.Array) -> pa.Array:
        out = [None if row is None else [w for p in row for w in ([p.lower()] if p.isascii() else cut(p))] for row in pieces.to_pylist()]
        return pa.array(out, pa.list_(pa.string()))

    return run
