"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks.

Repetition compresses far below prose and encoded or random bytes far above it, and both
shift with length, as a short text has no past to refer to. So each length has its own band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from panelforge.llm.common import ASCII_SPACE, arrow_map, bounded_batches

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class BandParams:
    level: int = 3
    #: from so many bytes on: lowest and highest ratio of compressed to raw bytes; shorter texts pass
    bands: tuple[tuple[int, float, float], ...] = ((64, 0.28, 1.30), (256, 0.38, 0.95), (512, 0.34, 0.85), (1024, 0.30, 0.74), (16_384, 0.25, 0.72))
    chunk_bytes: int = 2048
    chunk_band: tuple[float, float] = (0.30, 0.74)
    most_bad_chunks: float = 0.25  #: of the judged ones


def judge(raw: bytes, compressor, p: BandParams) -> tuple[float | None, float, bool]:
    """Ratio of the whole text, share of chunks outside the band, and whether both are within limits."""
    if not raw:
        return None, 0.0, True
    ratio = len(compressor.compress(raw)) / len(raw)
    band = next(((lo, hi) for least, lo, hi in reversed(p.bands) if len(raw) >= least), None)
    fine = band is None or band[0] <= ratio <= band[1]
    # the last chunk ends where the text does, so that all of the text is in a chunk of full size
    starts = [*range(0, len(raw) - p.chunk_bytes, p.chunk_bytes), len(raw) - p.chunk_bytes] if len(raw) >= p.chunk_bytes else []
    chunks = [raw[i : i + p.chunk_bytes] for i in starts]
    lo, hi = p.chunk_band
    bad = sum(not lo <= len(compressor.compress(c)) / len(c) <= hi for c in chunks) / len(chunks) if chunks else 0.0
    return ratio, bad, fine and bad <= p.most_bad_chunks


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of this width that the text holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.uint64, count=n)
    if len(names) == n:
        return 0
    code, span = ids, 1
    while span < width:  # codes of windows twice as wide: equal codes are equal windows
        step = min(span, width - span)
        pairs = code[: len(code) - step] * np.uint64(n) + code[step:]
        code = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        span += step
    count = np.bincount(code.astype(np.int64))
    starts = np.flatnonzero(count[code.astype(np.int64)] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, ASCII_SPACE))
    lines: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in lines:
            dup += 1
        elif line.strip():
            lines.add(line)
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), dup, repeated_window_words(words)


def compression_rules(docs: DataFrame, params: BandParams = BandParams()) -> DataFrame:
    """Counts and verdict for every text, without any shuffle.

    A null or empty text has no words and so fails the base rule. Rows are judged one by one:
    ties and repeated rows get equal verdicts, an empty table none; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")

    def rules(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=params.level)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                raw = text.encode()
                counts = base_counts(text, raw)
                failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
                ratio, bad, fine = judge(raw, compressor, params)
                rows.append((doc, *counts, failed, fine and not failed, ratio, bad))
            yield dict(zip(columns, zip(*rows, strict=True), strict=True))

    return arrow_map(docs.select("doc_id", "text"), rules, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double")
