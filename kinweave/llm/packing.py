"""Hierarchical packing of documents into sequences of several lengths.

Each document becomes token ids and a closing id 0. What fills whole windows
of the longest tier is cut off at once; the rest is routed to the shortest tier
that holds it. The tiers are packed from the longest to the shortest: the
longest waiting piece opens a window of its tier, and the gap is filled from
shorter tiers with the longest piece that fits, again and again; a gap that no
piece fits is closed by cutting the shortest one. So every window is full, and
what a task has left at its end is cut at powers of two: nothing is padded.

Sequences are then balanced over step groups: those of a horizon are ordered by
tier and attention cost and dealt back and forth, so that groups get alike
numbers of tokens and alike cost.

Nothing is shuffled: each task packs the rows of its partition, and holds at
most one horizon of tokens and one document.

Defined cases: null or empty text is the closing id alone; repeated rows are
packed each; null ids pass through; no rows give no pieces; other columns are
not looked at.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import importable

TIERS = (1024, 512, 256, 128)
END_ID = 0
#: Tokens that a task gathers before it packs them, and sequences in a step group.
HORIZON, GROUP = 1 << 21, 32
SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, step_group long, tokens binary"
)
_encoders: dict[tuple[str, bool], Callable[[str], list[int]]] = {}
#: Blanks in a row from which a run is encoded by itself; the class is what the pattern calls white space.
LONG_BLANK = 1 << 14
_LONG_BLANK = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANK},}}")


def _byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return symbols | {chr(256 + k): b for k, b in enumerate(others)}


def encoder(path: str, special_ids: bool = False) -> Callable[[str], list[int]]:
    """Text to ids by a byte-level BPE file of ``tokenizers``.

    Special strings in a text are ordinary text, or with ``special_ids`` their
    own ids, as a plain ``encode`` of the file gives them. Where the file's ids
    are its merge ranks, ``tiktoken`` encodes from the same file with the same
    ids at a fifth of the time; else ``tokenizers`` itself does.
    """
    key = (path, special_ids)
    if key not in _encoders:
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        exact.encode_special_tokens = not special_ids
        slow = lambda text: exact.encode(text, add_special_tokens=False).ids
        _encoders[key] = _ranked(path, slow, special_ids) or slow
    return _encoders[key]


def _ranked(path: str, exact: Callable[[str], list[int]], special_ids: bool) -> Callable[[str], list[int]] | None:
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, symbols = file["model"], _byte_symbols()
    pre, added = file.get("pre_tokenizer") or {}, file.get("added_tokens", [])
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocab = model["vocab"]
    plain = {a["content"] for a in added}
    known = {t: k for t, k in vocab.items() if t not in plain}
    order = [vocab.get("".join(m), -1) for m in merges]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or order != sorted(order) or any(c not in symbols for t in known for c in t):
        return None
    if file.get("normalizer") or any(not a["special"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        return None
    ranks = {bytes(symbols[c] for c in t): k for t, k in known.items()}
    if len(ranks) != len(known) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = {a["content"]: a["id"] for a in added} if special_ids else {}
    marks = re.compile("|".join(f"({re.escape(t)})" for t in sorted(special, key=len, reverse=True))) if special else None

    def ordinary(text: str) -> list[int]:
        if len(text) < LONG_BLANK:
            return fast.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _LONG_BLANK.finditer(text):
            # The pattern's search for the end of a run is recursive, so a long run is split off where the pattern
            # would end it: before its last blank, which may belong to a word, or at the end of the text.
            stop = run.end() if run.end() == len(text) else run.end() - 1
            ids += fast.encode_ordinary(text[at : run.start()])
            ids += fast._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + fast.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        try:
            if marks is None or not marks.search(text):
                return ordinary(text)
            ids: list[int] = []
            at = 0
            for found in marks.finditer(text):
                ids += ordinary(text[at : found.start()])
                ids.append(special[found[0]])
                at = found.end()
            return ids + ordinary(text[at:])
        except BaseException as error:
            # A panic of the library is no Exception; the other one has no such limits.
            if type(error).__name__ != "PanicException":
                raise
            return exact(text)

    probe = "It's  a\tprobe\n\n  Größe, niño 12345 你好 \U0001f600 é <|endoftext|> \x00end  "
    return encode if encode(probe) == exact(probe) else None


class Pool:
    """Waiting pieces by length. A piece is ``(doc, start, ids, doc_tokens)``."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple]] = defaultdict(list)
        self.have = 0
        self.tokens = 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by[n].append(piece)
        self.have |= 1 << n
        self.tokens += n

    def take(self, n: int) -> tuple:
        piece = self.by[n].pop()
        if not self.by[n]:
            self.have &= ~(1 << n)
        self.tokens -= n
        return piece

    def longest(self, limit: int) -> int:
        """The longest waiting length up to ``limit``, 0 if there is none."""
        return max(0, (self.have & ((2 << limit) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.have & -self.have).bit_length() - 1


def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


def pack(pool: Pool, tiers: tuple[int, ...]) -> list[list[tuple]]:
    """Full windows out of the pool; the pieces of the last, which nothing is left to fill, go back."""
    done = []
    while pool.have:
        n = pool.longest(tiers[0])
        size = min(t for t in tiers if t >= n)
        window, gap = [pool.take(n)], size - n
        while gap and pool.have:
            fits = pool.longest(gap)
            if fits:
                window.append(pool.take(fits))
                gap -= fits
            else:
                head, rest = cut(pool.take(pool.shortest()), gap)
                window.append(head)
                pool.put(rest)
                gap = 0
        if gap:
            for piece in window:
                pool.put(piece)
            break
        done.append(window)
    return done


def close(pool: Pool) -> list[list[tuple]]:
    """Sequences whose lengths are powers of two, out of all that is left."""
    left = []
    while pool.have:
        left.append(pool.take(pool.longest(pool.have.bit_length())))
    done, total = [], sum(len(p[2]) for p in left)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        window = []
        while room:
            piece = left.pop()
            if len(piece[2]) > room:
                piece, rest = cut(piece, room)
                left.append(rest)
            window.append(piece)
            room -= len(piece[2])
        done.append(window)
    return done


def balanced(windows: list[list[tuple]], group: int) -> list[int]:
    """A step group for each window: by tier and attention cost, dealt back and forth."""
    groups = max(1, -(-len(windows) // group))
    cost = [(sum(len(p[2]) for p in w), sum(len(p[2]) ** 2 for p in w)) for w in windows]
    out = [0] * len(windows)
    for k, w in enumerate(sorted(range(len(windows)), key=lambda w: cost[w], reverse=True)):
        turn, at = divmod(k, groups)
        out[w] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, horizon: int = HORIZON, group: int = GROUP, special_ids: bool = False) -> DataFrame:
    """``docs (doc_id, text)`` to one row a piece, with its ids as little-endian 32-bit ``tokens``.

    Special strings in a text are ordinary text unless ``special_ids``, see :func:`encoder`.
    """
    importable(docs.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tiers = tuple(sorted(tiers, reverse=True))
    top = tiers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, special_ids)
        base = TaskContext.get().partitionId() << 36
        pool, full, gathered = Pool(), [], 0
        sequences = groups = 0

        def emit(windows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            steps = balanced(windows, group)
            columns: list[list] = [[] for _ in range(9)]
            for window, step in zip(windows, steps, strict=True):
                offset, size = 0, sum(len(p[2]) for p in window)
                for doc, start, ids, total in window:
                    row = (doc, start, len(ids), total, base + sequences, offset, size, base + groups + step, ids.tobytes())
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += len(ids)
                sequences += 1
            groups += max(steps, default=-1) + 1
            if columns[0]:
                kinds = [pa.int64()] * 8 + [pa.binary()]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                ids = np.array([*(encode(text) if text else ()), END_ID], "<u4")
                doc, n = ids_of[k].as_py(), len(ids)
                whole = n - n % top
                full.extend([(doc, at, ids[at : at + top], n)] for at in range(0, whole, top))
                if whole < n:
                    pool.put((doc, whole, ids[whole:], n))
                gathered += n
                if gathered >= horizon:
                    yield from emit(full + pack(pool, tiers))
                    full, gathered = [], 0
        yield from emit(full + pack(pool, tiers) + close(pool))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), special_ids=True))
