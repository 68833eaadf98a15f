"""Cross-tokenizer alignment by interval coalescing.

Tokenizer A (byte-level BPE, of a space and the text) and tokenizer B (pieces with byte
fallback, which puts the space itself) both tile the same bytes. All tokens of both are
sorted by start and the running maximum of their ends is kept: a group breaks where a start
reaches it. Inside a group, every A token is linked with the B tokens whose bytes overlap
its own. Links are then weighed by how many documents of the corpus hold their id pair.

A place where a character that is not white space meets a space or a line break ends a token
of both (checked against B's vocabulary, else texts stay whole), so texts are cut there and
each distinct part is encoded and coalesced once, all new parts of a block together. Texts
with other white space are one part each, whatever their length.

Spark's share: documents are staged in blocks, a row each, with the block's distinct parts,
their pairs, and which document has which parts. Pairs are counted by a sum over blocks,
each A id's highest count by a table of at most A's vocabulary. Then one row per block and
pair meets its count, and the answers meet their block. A pair that is everywhere costs one
row per block.

Defined results: null and empty texts, and texts whose tokens don't give their bytes back
(U+2581 in a text, for one), have no tokens: zeros and an empty digest; null ids are kept;
repeated rows are counted and returned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.exchange import press, unpress
from touchline.llm.shared import internal, materialize, slices
from touchline.llm.source_audit import Numbers
from touchline.llm.tokens import byte_level_table, encoder

#: Text bytes in a block, and in a step of its making.
BLOCK, STEP = 6 << 20, 1 << 20
#: Parts, and their characters, that a worker remembers; half of them are older ones.
REMEMBERED, REMEMBERED_CHARS = 240_000, 8 << 20

_OTHER_SPACE = re.compile(r"[^\S \n]")
_PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_BLOCK = "block long, n_docs long, payload binary, pairs binary"
_ROWS = ("id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
         "groups_sha256 string")
_aligners: dict[tuple[str, str], Aligner] = {}


def coalesce(a_start, a_end, b_start, b_end):
    """Groups of the tokens of A and B, by one sort: (order over A then B tokens, group of
    each token in that order)."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    kind = np.repeat([0, 1], [a_start.size, b_start.size])
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(order.size, bool)
    breaks[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def links(a_start, a_end, b_start, b_end):
    """All (A token, B token) whose bytes overlap; both tile, so a token's partners are a run."""
    low = np.searchsorted(b_end, a_start, "right")
    high = np.searchsorted(b_start, a_end, "left")
    count = high - low
    a = np.repeat(np.arange(a_start.size), count)
    first = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if count.size else low
    return a, np.arange(a.size) + first


def runs_of(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, given where each begins and how long it is."""
    if not size.size:
        return np.zeros(0, np.int64)
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class Parts:
    """Parts of texts with what they come to: tokens of A and of B, groups and links
    (``figures``, a row of -1 where the tokens don't give the bytes back), the id pairs of the
    links (A's and B's id in one number), and the groups as text."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.chars = self.n_links = 0
        self.figures = np.zeros((1024, 4), np.int64)
        self.ends = np.zeros(1025, np.int64)
        self.links = np.zeros(4096, np.int64)

    def add(self, parts: list[str], figures: np.ndarray, links: np.ndarray, text: list[str]) -> None:
        known, more = len(self.text), len(parts)
        while known + more > len(self.figures):
            self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
            self.ends = np.concatenate([self.ends, np.zeros(self.ends.size - 1, np.int64)])
        while self.n_links + links.size > self.links.size:
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.figures[known:known + more] = figures
        self.ends[known + 1:known + more + 1] = self.n_links + np.cumsum(np.maximum(figures[:, 3], 0))
        self.links[self.n_links:self.n_links + links.size] = links
        self.n_links += links.size
        self.number.update(zip(parts, range(known, known + more)))
        self.text += text
        self.chars += sum(map(len, parts))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        figures = self.figures[at]
        links = self.links[runs_of(self.ends[at], np.maximum(figures[:, 3], 0))]
        return figures, links, list(map(self.text.__getitem__, at.tolist()))


class Aligner:
    """Both tokenizers, and the parts that were met lately."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = encoder(a_path, True, plain=True)
        own = self.a.library
        table = byte_level_table()
        vocab = own.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(table[c] for c in token if c in table)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(self.n_b)]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        # No piece goes on with a space or holds a line break: parts are safe.
        plain = [p for k, p in enumerate(pieces) if not self.b.is_byte(k)]
        self.cut = not any("▁" in p.lstrip("▁") or "\n" in p for p in plain)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # Ids as text with the sign before them.
        self.n_ids = max(len(self.a_bytes), self.n_b)
        self.signed = [sign + str(k) for sign in ";|," for k in range(self.n_ids)]
        self.new, self.old = Parts(), Parts()

    def split(self, text: str) -> list[str]:
        """The parts of a space and the text."""
        whole = " " + text
        return _PARTS.findall(whole) if self.cut and not _OTHER_SPACE.search(whole) else [whole]

    def _encode_b(self, parts: list[str]) -> list[list[int]]:
        """B's ids. The library puts a space before what it gets, so a part's own first one is
        left out; a part that begins with a line break loses the space again."""
        given = [p[1:] if p[0] == " " else p for p in parts]
        out = self.b.encode(given, num_threads=1)
        for k, p in enumerate(parts):
            if p == " ":
                out[k] = [self.space]
            elif p[0] != " ":
                out[k] = out[k][1:]
        return out

    def find(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Figures, links and text of the parts (distinct ones), one after the other."""
        if len(self.new.text) > REMEMBERED // 2 or self.new.chars > REMEMBERED_CHARS:
            self.old, self.new = self.new, Parts()
        number = self.new.number
        missing = [p for p in parts if p not in number]
        again = [p for p in missing if p in self.old.number]
        if again:
            self.new.add(again, *self.old.take(np.fromiter(
                map(self.old.number.__getitem__, again), np.int64, len(again))))
            missing = [p for p in missing if p not in number]
        for at in range(0, len(missing), 20_000):
            self.new.add(missing[at:at + 20_000], *self._settle(missing[at:at + 20_000]))
        return self.new.take(np.fromiter(map(number.__getitem__, parts), np.int64, len(parts)))

    def _settle(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Encode parts and coalesce their tokens."""
        wanted = [p.encode() for p in parts]
        size = np.fromiter(map(len, wanted), np.int64, len(wanted))
        a_ids, a_count = self.a.encode_many(parts)
        a_ids = a_ids.astype(np.int64)
        b_lists = self._encode_b(parts)
        b_count = np.fromiter(map(len, b_lists), np.int64, len(b_lists))
        b_ids = np.fromiter(chain.from_iterable(b_lists), np.int64, int(b_count.sum()))
        good = self._give_back(wanted, size, a_ids, a_count, self.a_bytes, self.a_size)
        good &= self._give_back(wanted, size, b_ids, b_count, self.b_bytes, self.b_size)
        figures = np.full((len(parts), 4), -1, np.int64)
        if not good.all():
            a_ids, b_ids = a_ids[np.repeat(good, a_count)], b_ids[np.repeat(good, b_count)]
            a_count, b_count = a_count[good], b_count[good]
        n = a_count.size
        # Parts follow one another: both tokenizers tile them one after the other.
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        a_start, b_start = a_end - self.a_size[a_ids], b_end - self.b_size[b_ids]
        order, group = coalesce(a_start, a_end, b_start, b_end)
        part = np.repeat(np.concatenate([np.arange(n)] * 2), np.concatenate([a_count, b_count]))[order]
        # As text: groups in order, A's ids before B's.
        is_b = order >= a_ids.size
        line = np.lexsort((is_b, group))
        kind, of, who = is_b[line], group[line], np.concatenate([a_ids, b_ids])[order][line]
        first = np.ones(line.size, bool)
        first[1:] = of[1:] != of[:-1]
        turn = np.zeros(line.size, bool)
        turn[1:] = kind[1:] & ~kind[:-1]
        sign = np.where(first, 0, np.where(turn, 1, 2))
        words = list(map(self.signed.__getitem__, (sign * self.n_ids + who).tolist()))
        ends = np.cumsum(a_count + b_count).tolist()
        text = ["".join(words[at:end]) for at, end in zip([0, *ends], ends)]
        left, right = links(a_start, a_end, b_start, b_end)
        n_links = np.bincount(np.repeat(np.arange(n), a_count)[left], minlength=n)
        figures[good] = np.stack([a_count, b_count, np.bincount(part[line][first], minlength=n), n_links], axis=1)
        if n < len(parts):
            rest = iter(text)
            text = [next(rest) if g else "" for g in good.tolist()]
        return figures, a_ids[left] * self.n_b + b_ids[right], text

    @staticmethod
    def _give_back(wanted: list[bytes], size: np.ndarray, ids: np.ndarray, count: np.ndarray,
                   entry: list[bytes], entry_size: np.ndarray) -> np.ndarray:
        """Which parts are the bytes of their tokens."""
        ends = np.cumsum(count)
        total = np.concatenate([[0], np.cumsum(entry_size[ids])])
        sizes_fit = total[ends] - total[ends - count] == size
        found = list(map(entry.__getitem__, ids.tolist()))
        if sizes_fit.all() and b"".join(found) == b"".join(wanted):
            return sizes_fit
        return np.array([b"".join(found[e - c:e]) == want for e, c, want in zip(
            ends.tolist(), count.tolist(), wanted)])


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


class _Open:
    """A block in the making."""

    def __init__(self, own: Aligner):
        self.own, self.size = own, 0
        self.numbers = Numbers()
        self.parts, self.links, self.text = [], [], []
        self.ids, self.null, self.figures, self.digests = [], [], [], []
        self.doc, self.part, self.times, self.n_docs = [], [], [], 0

    def add(self, piece: pa.RecordBatch) -> None:
        texts = [t or "" for t in piece.column("text").to_pylist()]
        split = [self.own.split(t) if t else [] for t in texts]
        sizes = np.array([len(p) for p in split], np.int64)
        flat = list(chain.from_iterable(split))
        at = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        if len(self.numbers) > len(self.text):
            figures, links_, text = self.own.find(list(islice(self.numbers, len(self.text), None)))
            self.parts.append(figures)
            self.links.append(links_)
            self.text += text
            self.parts = [np.concatenate(self.parts)]
        # A text counts when all its parts do.
        value = self.parts[0][at] if flat else np.zeros((0, 4), np.int64)
        totals = np.zeros((len(flat) + 1, 5), np.int64)
        np.cumsum(np.column_stack([value, value[:, 0] < 0]), axis=0, out=totals[1:])
        ends = np.cumsum(sizes)
        sums = totals[ends] - totals[ends - sizes]
        known = (sums[:, 4] == 0) & (sizes > 0)
        self.figures.append(np.where(known[:, None], sums[:, :4], 0))
        first, numbers, spell = 0, at.tolist(), self.text.__getitem__
        for good, last in zip(known.tolist(), ends.tolist()):
            # The digest's text begins without the sign before its first group.
            self.digests.append(hashlib.sha256("".join(map(spell, numbers[first:last]))[1:].encode()).digest()
                                if good else b"")
            first = last
        self.null.append(piece.column("id").is_null().to_numpy(zero_copy_only=False))
        self.ids.append(piece.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        use = np.repeat(known, sizes)
        key, times = np.unique(np.repeat(np.arange(len(texts)), sizes)[use] << 32 | at[use], return_counts=True)
        self.doc.append((key >> 32) + self.n_docs)
        self.part.append(key & 0xFFFFFFFF)
        self.times.append(times)
        self.n_docs += len(texts)
        self.size += piece.column("text").nbytes

    def row(self, number: int) -> pa.RecordBatch:
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        doc, part, times = join(self.doc), join(self.part), join(self.times)
        n_links = np.maximum(join([p[:, 3] for p in self.parts]), 0)
        pairs, place = np.unique(join(self.links), return_inverse=True)
        # Documents that hold a pair: one entry for each document and pair.
        first = np.cumsum(n_links) - n_links
        size = n_links[part]
        width = max(pairs.size, 1)
        once = np.repeat(doc, size) * width + place[runs_of(first[part], size)]
        once.sort()
        new = np.ones(once.size, bool)
        new[1:] = once[1:] != once[:-1]
        docs = np.bincount(once[new] % width, minlength=pairs.size)
        held = docs > 0
        rank = np.cumsum(held) - 1
        # Pairs only of texts without tokens are in no document: their links are never used.
        place = np.where(held[place], rank[place], 0) if place.size else place
        pairs, docs = pairs[held], docs[held]
        columns = [np.concatenate(self.ids).astype("<i8"), np.concatenate(self.null).astype("u1"),
                   *np.concatenate(self.figures).T.astype("<i8")]
        payload = [press(*columns), zstandard.compress(b"".join(d or bytes(32) for d in self.digests), 1),
                   zstandard.compress(bytes(bool(d) for d in self.digests), 1),
                   press(doc.astype("<i4"), part.astype("<i4"), times.astype("<i4")),
                   press(n_links.astype("<i4")), press(place.astype("<i4"))]
        sizes = np.array([len(p) for p in payload], "<i8").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([self.n_docs]), pa.array([sizes + b"".join(payload)], pa.binary()),
             pa.array([press(pairs.astype("<u8"), docs.astype("<i8"))], pa.binary())],
            ["block", "n_docs", "payload", "pairs"])


def stage(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """Blocks of aligned documents, written once."""

    def blocks(batches):
        own = aligner(a_path, b_path)
        part, seq, held = TaskContext.get().partitionId(), 0, _Open(own)
        for piece in slices(batches, STEP):
            held.add(piece)
            if held.size >= BLOCK:
                yield held.row((part << 32) | seq)
                seq, held = seq + 1, _Open(own)
        if held.n_docs:
            yield held.row((part << 32) | seq)

    return materialize(internal(docs, id_col, text_col).select("id", "text").mapInArrow(blocks, _BLOCK), "aligned-blocks")


def _pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, pair, docs): the distinct pairs of each block."""

    def rows(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist()):
                pairs, docs = unpress(data, "<u8", "<i8")
                for at in range(0, pairs.size, 100_000):
                    some = pairs[at:at + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(some.size, block)), pa.array(some.astype(np.int64)),
                         pa.array(docs[at:at + 100_000])], ["block", "pair", "docs"])

    return blocks.select("block", "pairs").mapInArrow(rows, "block long, pair long, docs long")


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(a, b, pair, docs, best): documents that hold each linked id pair, and whether it is
    its A id's highest count."""
    counted = _pair_rows(blocks).groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn(
        "a", F.expr(f"pair div {n_b}"))
    counted = materialize(counted, "pair-counts")
    highest = counted.groupBy("a").agg(F.max("docs").alias("highest"))
    # At most as many rows as A has ids.
    return counted.join(F.broadcast(highest), "a").select(
        "a", (F.col("pair") % n_b).alias("b"), "pair", "docs", (F.col("docs") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    blocks = stage(docs, a_path, b_path, id_col, text_col)
    counts = pair_counts(blocks, n_b).select("pair", F.col("docs").alias("total"), "best")
    answers = _pair_rows(blocks).select("block", "pair").join(counts, "pair")

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        payload = left.column("payload")[0].as_py()
        sizes = np.frombuffer(payload[:48], "<i8").tolist()
        cut = np.cumsum([48, *sizes]).tolist()
        data = [payload[a:b] for a, b in zip(cut, cut[1:])]
        ids, null, n_a, n_b_, n_groups, n_links = unpress(data[0], "<i8", "u1", "<i8", "<i8", "<i8", "<i8")
        raw, has = zstandard.decompress(data[1]), zstandard.decompress(data[2])
        doc, part, times = unpress(data[3], "<i4", "<i4", "<i4")
        in_part, = unpress(data[4], "<i4")
        place, = unpress(data[5], "<i4")
        order = np.argsort(right.column("pair").to_numpy(), kind="stable")
        total = right.column("total").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(in_part)]).astype(np.int64)

        def per_part(value: np.ndarray) -> np.ndarray:
            sums = np.zeros(place.size + 1, np.int64)
            if value.size:
                np.cumsum(value[place], out=sums[1:])
            return sums[ends[1:]] - sums[ends[:-1]]

        def per_doc(value: np.ndarray) -> np.ndarray:
            out = np.zeros(ids.size, np.int64)
            np.add.at(out, doc, per_part(value)[part] * times)
            return out

        digest = [raw[32 * k:32 * k + 32].hex() if h else "" for k, h in enumerate(has)]
        columns = [pa.array(ids, mask=null.astype(bool)), n_a, n_b_, n_groups, n_links, per_doc(best), per_doc(total)]
        return pa.table([*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), pa.array(digest, pa.string())],
                        names=[c.split()[0] for c in _ROWS.split(", ")])

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, _ROWS)


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document id and its groups as text, ``a1,a2|b1;a3|b2,b3``."""

    def spell(batches):
        own = aligner(a_path, b_path)
        for piece in slices(batches, STEP):
            out = []
            for text in piece.column("text").to_pylist():
                numbers = Numbers()
                at = [numbers[p] for p in own.split(text)] if text else []
                figures, _, spelled = own.find(list(numbers))
                good = bool(at) and (figures[:, 0] >= 0).all()
                out.append("".join([spelled[k] for k in at])[1:] if good else "")
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(out, pa.string())], ["id", "groups"])

    return internal(docs, id_col, text_col).select("id", "text").mapInArrow(spell, "id long, groups string")
