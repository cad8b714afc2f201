"""Order-preserving packing of documents into training sequences.

The documents of a partition are one stream of tokens. Where it is cut into sequences is chosen by dynamic
programming: a cut at a document's end is free, one at a sentence's end costs a little, one elsewhere more, and
every token that a sequence lacks to the window costs one. The best predecessor of a cut is the front of a monotone
queue over the cuts of the last window. The plan has the least cost of all plans of the whole partition, though it
is made block by block: cuts are given out once every plan that can still be the best one shares them.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import documents, few_rows, small_batches, tokenizer_path

WINDOW = 1024
#: Id that ends every document.
END_ID = 0
#: Cost, in tokens of padding, of a cut at a sentence's end and of a cut within a sentence.
SENTENCE_CUT, FREE_CUT = 8.0, 24.0
#: Further tokens after which the plan is carried on and its settled cuts are given out.
BLOCK = 128 * WINDOW


class Vocabulary:
    """Ids of a byte-level BPE vocabulary file (JSON), by the merge ranks that its ids are.

    Texts are split at the file's added tokens, which have ids of their own; what lies between is encoded by itself.
    """

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        added = described.get("added_tokens", [])
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
            raise ValueError("added tokens that take blanks or need whole words are not supported")
        special = {x["content"]: x["id"] for x in added}
        back = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(back[c] for c in piece): i for piece, i in described["model"]["vocab"].items() if piece not in special}
        self.added = special
        self.splits = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.ordinary = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: Which ids end a sentence: their last character but blanks and quotes is a full stop, or they hold a line end.
        self.ends_sentence = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=bool)
        for piece, i in ranks.items():
            self.ends_sentence[i] = b"\n" in piece or piece.rstrip(b" \"')]")[-1:] in (b".", b"!", b"?")

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the tokenizers library gives them without its post-processor."""
        if self.splits is None or self.splits.search(text) is None:
            return self.ordinary(text)
        out, at = [], 0
        for found in self.splits.finditer(text):
            out += self.ordinary(text[at : found.start()])
            out.append(self.added[found.group()])
            at = found.end()
        return out + self.ordinary(text[at:])


@lru_cache(maxsize=2)
def vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> Vocabulary:
    return Vocabulary(tokenizer_path(name, folder))


class Plan:
    """The cuts of least cost of a stream that is given piece by piece.

    Candidates come in ascending order with their penalties; all other places are candidates at the penalty ``free``,
    which is at least theirs. A sequence costs window minus its length. Of the other places only the end of a full
    window after the queue's front can be in a best plan: a cut that is moved towards the end of its window leaves the
    sum of all paddings as it is, and of two predecessors the one of less cost plus place stays ahead.
    """

    def __init__(self, window: int = WINDOW, free: float = FREE_CUT):
        self.window, self.free = window, free
        # States: a cut's place, the cost up to it and the state before it. States are numbered from the stream's
        # beginning, of which the first self.gone are dropped, and places too; self.origin is the last settled cut.
        self.at, self.cost, self.before = [0], [0.0], [-1]
        self.gone = self.origin = 0
        self.queue = deque([0])  # cuts of the last window; cost + place ascends, so the front pads least

    def extend(self, places: list[int], penalties: list[float]) -> None:
        """Plans on to the last of ``places``, which then is a cut."""
        at, cost, before, queue, window, gone = self.at, self.cost, self.before, self.queue, self.window, self.gone
        i, n, k = 0, len(places), self.gone + len(self.at)
        while i < n:
            front = queue[0]
            full = at[front - gone] + window
            b = places[i]
            if full < b:
                queue.popleft()
                if full <= at[-1]:  # a candidate stood at the full window's end
                    continue
                b, penalty = full, self.free
            else:
                penalty = penalties[i]
                i += 1
            c = cost[front - gone] + full - b + penalty
            at.append(b)
            cost.append(c)
            before.append(front)
            key = c + b
            while queue and cost[queue[-1] - gone] + at[queue[-1] - gone] >= key:
                queue.pop()
            queue.append(k)
            k += 1

    def _path(self, k: int) -> list[int]:
        cuts = []
        while k > self.gone:
            cuts.append(self.at[k - self.gone])
            k = self.before[k - self.gone]
        return cuts[::-1]

    def cuts(self) -> list[int]:
        """All cuts from the last settled one up to the last place."""
        return self._path(self.gone + len(self.at) - 1)

    def settle(self) -> list[int]:
        """The further cuts that every best plan of a longer stream shares.

        Later cuts follow one that is in the queue now, so these are the cuts before the queue's common ancestor.
        """
        ends = set(self.queue)
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(self.before[last - self.gone])
        root = ends.pop()
        cuts, drop = self._path(root), root - self.gone
        self.origin, spent = self.at[drop], self.cost[drop]
        del self.at[:drop], self.cost[:drop], self.before[:drop]
        self.gone = root
        if spent > 1e9:  # costs are compared with each other only, so they needn't grow
            self.cost[:] = [c - spent for c in self.cost]
        return cuts


def split_tail(length: int, free: float = FREE_CUT, window: int = WINDOW) -> list[int]:
    """Lengths of the sequences of a last one: itself, or powers of two where that costs less than its padding."""
    bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return bits if len(bits) > 1 and (len(bits) - 1) * free < window - length else [length]


class Packer:
    """Takes documents in order and gives the pieces of sequences that are settled."""

    def __init__(self, ends_sentence: np.ndarray, window: int = WINDOW, block: int = BLOCK):
        self.ends_sentence, self.window, self.block = ends_sentence, window, block
        self.docs: list[tuple] = []  # id, ids left, ids before them, all its ids
        self.fresh: list[np.ndarray] = []  # ids of the documents that aren't planned yet
        self.plan, self.planned, self.waiting, self.sequences = Plan(window), 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.fresh.append(ids)
        self.waiting += len(ids)

    def is_due(self) -> bool:
        return self.waiting >= self.block

    def _carry_on(self) -> None:
        new = np.concatenate(self.fresh)
        ends = np.cumsum([len(x) for x in self.fresh])
        places = np.union1d(np.flatnonzero(self.ends_sentence[new]) + 1, ends)
        penalties = np.full(len(places), SENTENCE_CUT)
        penalties[np.searchsorted(places, ends)] = 0.0
        self.plan.extend((places + self.planned).tolist(), penalties.tolist())
        self.planned += len(new)
        self.fresh, self.waiting = [], 0

    def take(self, last: bool) -> list[tuple]:
        """doc_id, start, length, crc32, doc_tokens, sequence, offset and sequence's length of each settled piece."""
        if not self.docs:
            return []
        if self.fresh:
            self._carry_on()
        begun_at = self.plan.origin
        cuts = [c - begun_at for c in (self.plan.cuts() if last else self.plan.settle())]
        if last:
            start = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + (start + np.cumsum(split_tail(self.planned - begun_at - start, window=self.window))).tolist()
        if not cuts:
            return []
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        stops = np.union1d(cuts, ends[ends <= cuts[-1]])
        starts = np.concatenate([[0], stops[:-1]])
        of_cut = np.searchsorted(cuts, starts, side="right")
        of_doc = np.searchsorted(ends, starts, side="right")
        opened = np.concatenate([[0], cuts])
        begun = np.concatenate([[0], ends])
        data = ids.astype("<u4", copy=False)
        out = []
        for a, b, s, d in zip(starts.tolist(), stops.tolist(), of_cut.tolist(), of_doc.tolist()):
            doc_id, _, skipped, total = self.docs[d]
            first = int(opened[s])
            out.append((doc_id, a - int(begun[d]) + skipped, b - a, zlib.crc32(data[a:b]), total, self.sequences + s, a - first, int(opened[s + 1]) - first))
        self.sequences += len(cuts)
        kept = int(np.searchsorted(ends, cuts[-1], side="right"))
        rest = self.docs[kept:]
        if rest and (gone := cuts[-1] - int(begun[kept])):
            doc_id, left, skipped, total = rest[0]
            rest[0] = (doc_id, left[gone:], skipped + gone, total)
        self.docs = rest
        return out


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def pack(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """The pieces of documents in sequences of at most 1024 tokens, in the order of the rows of each partition.

    Each id of a document, and END_ID after them, lies in exactly one piece; null and empty texts are END_ID
    alone. A sequence is padded to 1024 unless its length is a power of two. Repeated rows are packed again.
    Only doc_id and text are read. Partitions are packed by themselves, in one pass without a shuffle; a task
    holds the ids (four bytes each) behind the last settled cut, usually some hundred windows. sequence_id is the partition's number times 2^40 plus the sequence's number in it, so a
    task that is run again gives the same rows. An empty table gives no piece.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], _PIECE).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_name, folder)
        packer = Packer(words.ends_sentence)
        base = TaskContext.get().partitionId() << 40

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            cols[5] = [base + s for s in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], schema=schema)

        for batch in few_rows(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text) if text else []
                ids.append(END_ID)
                packer.add(doc_id, np.array(ids, dtype=np.uint32))
                if packer.is_due() and (rows := packer.take(False)):
                    yield table(rows)
        if rows := packer.take(True):
            yield table(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(documents(spark, sf_dir))
