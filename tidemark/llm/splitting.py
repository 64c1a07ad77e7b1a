"""Problem 4: texts over a size limit as overlapping pieces, cut at natural ends.

Every natural end, and in a stretch without any every forced cut, is a node; it is joined to its farthest legal successor,
the end of the longest piece that may follow it with the overlap. Squaring the successor table again and again finds, in
parallel over all texts of a batch, which nodes the greedy walk from each text's start meets: after k rounds all of its
first 2^k - 1 cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.tables import need

LIMIT, OVERLAP = 1500, 150
CHARS_AT_ONCE = 2_000_000
BLANKS = (0x20, 0x09, 0x0A, 0x0D)
FULL_STOPS = (0x3002, 0xFF01, 0xFF1F)
STOPS = (*map(ord, ".!?…"),)
CLOSERS = (*map(ord, "\"')]}»”’"),)


def _last(marks: np.ndarray) -> np.ndarray:
    """For each position the last marked one up to it, -1 if none."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))


def natural_ends(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks, for positions 0..n of n code points, where a paragraph, a sentence or line, and a word may end. Each kind
    holds the one before; a carriage return is not parted from its line feed."""
    n = len(points)
    blank = np.isin(points, BLANKS)
    stop = np.isin(points, FULL_STOPS)
    word = np.zeros(n + 1, bool)
    word[1:] = blank | stop
    following = np.append(points[1:], 0)
    word[1:] &= ~((points == 0x0D) & (following == 0x0A))
    line = (points == 0x0A) | ((points == 0x0D) & (following != 0x0A))
    before = np.concatenate(([0], points))[:n], np.concatenate(([0, 0], points))[:n]
    ended = np.isin(before[0], STOPS) | (np.isin(before[0], CLOSERS) & np.isin(before[1], STOPS))
    sentence = np.zeros(n + 1, bool)
    sentence[1:] = stop | line | (blank & ended)
    sentence &= word
    lines = np.flatnonzero(line)
    paragraph = np.zeros(n + 1, bool)
    if len(lines) > 1:  # a line end with nothing but blanks since the one before
        inked = np.cumsum(~blank)
        paragraph[lines[1:][inked[lines[1:]] == inked[lines[:-1]]] + 1] = True
    return paragraph, sentence | paragraph, word | paragraph


def cut_texts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the ends of its pieces, and of each end the length of the stretch without a blank or full stop that it
    cuts in two; 0 at a natural end and at the text's end."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    gap = "\x00"  # keeps the end of a text apart from the start of the next
    points = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    ends = starts + sizes
    paragraph, sentence, word = natural_ends(points)
    for marks in (paragraph, sentence, word):  # no mark at a start or beyond an end
        marks[starts] = False
        marks[ends] = False
    breaks = np.isin(points, BLANKS + FULL_STOPS)
    breaks[ends] = True
    at = np.concatenate(([-1], np.flatnonzero(breaks)))

    # forced cuts: from the last end before a stretch without any, a step at a time until an end is in reach
    step, half = limit - overlap, (limit - overlap) // 2
    natural = np.unique(np.concatenate((np.flatnonzero(word), starts, ends)))
    first_step = np.where(np.isin(natural, starts), limit, step)
    until = np.append(natural[1:], natural[-1:])
    own_end = ends[np.minimum(np.searchsorted(ends, natural), len(ends) - 1)] if len(ends) else natural
    long = (until > natural + first_step) & (natural < own_end)
    forced = [np.zeros(0, np.int64)]
    for b, reach, f in zip(natural[long], until[long], first_step[long], strict=True):
        forced.append(np.arange(b + f, reach, step))
    nodes = np.unique(np.concatenate((natural, *forced)))

    text_end = ends[np.minimum(np.searchsorted(ends, nodes), len(ends) - 1)] if len(ends) else nodes
    is_start = np.isin(nodes, starts)
    reach = np.minimum(nodes + np.where(is_start, limit, step), text_end)
    least = nodes + np.where(is_start, limit // 2, half)
    p, s, w = _last(paragraph)[reach], _last(sentence)[reach], _last(word)[reach]
    target = np.where(p > least, p, np.where(s > least, s, np.where(w > nodes, w, reach)))
    target = np.where(reach == text_end, text_end, target)
    follow = np.searchsorted(nodes, target)
    met = np.zeros(len(nodes), bool)
    met[np.searchsorted(nodes, starts)] = True
    while True:
        more = met.copy()
        more[follow[met]] = True
        if (more == met).all():
            break
        met, follow = more, follow[follow]
    cuts = nodes[met & ~is_start]
    after = np.searchsorted(at, cuts)  # the first break not before a cut, which lies between two characters
    inside = (at[np.minimum(after, len(at) - 1)] > cuts) & (at[after - 1] < cuts - 1)
    broken = np.where(inside, at[np.minimum(after, len(at) - 1)] - at[after - 1] - 1, 0)
    parts = np.searchsorted(cuts, starts[1:])
    return ([c - a for c, a in zip(np.split(cuts, parts), starts, strict=True)], np.split(broken, parts)) if len(texts) else ([], [])


def split_texts(df: DataFrame, item_id: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, piece_no, n_pieces, begin, end, piece, n_chars, unbroken): the pieces of each text in order.

    A text of at most limit characters (code points) is one piece; a null or empty one has none. Pieces have at most limit
    characters; each after the first begins with the last overlap characters of the one before (all of it if shorter). A
    piece ends at the last paragraph end, else sentence or line end, in the second half of what it may take, else at the
    last word end in all of that, else at the limit. unbroken is the length of the stretch without a space, tab, line feed,
    carriage return or one of 。！？ that the piece's end cuts in two, 0 where that is a natural end. Dropping each piece's overlap gives the text again. Repeated
    rows are cut each for itself; null ids are kept; other columns are ignored.
    """
    need(df, item_id, text)
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    rows = df.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).filter("text <> ''")
    schema = T.StructType([rows.schema["item_id"], *(T.StructField(n, T.IntegerType()) for n in ("piece_no", "n_pieces", "begin", "end")), T.StructField("piece", T.StringType()), T.StructField("n_chars", T.IntegerType()), T.StructField("unbroken", T.IntegerType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= CHARS_AT_ONCE):
                    size += len(texts[b])
                    b += 1
                cuts, broken = cut_texts(texts[a:b], limit, overlap)
                counts = np.array([len(c) for c in cuts])
                finish = np.concatenate(cuts)
                begin = np.concatenate([np.concatenate(([0], np.maximum(c[:-1] - overlap, 0))) for c in cuts])
                owner = np.repeat(np.arange(b - a), counts)
                pieces = [texts[a + o][i:j] for o, i, j in zip(owner, begin, finish, strict=True)]
                number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                ints = (number, counts[owner], begin, finish)
                chars = np.array([len(t) for t in texts[a:b]])
                ids = batch.column("item_id").slice(a, b - a).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int32)) for x in ints), pa.array(pieces, pa.string()), pa.array(chars[owner].astype(np.int32)), pa.array(np.concatenate(broken).astype(np.int32))], names)
                a = b

    return rows.mapInArrow(run, schema)
