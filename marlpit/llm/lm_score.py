"""Scoring texts by causal self-attention over subword ids.

A text is its lower-cased words, then an end. Words are spelled in byte-level BPE
pieces. Two attention models, trained in numpy, share the work. One reads a window
of words, each by its first and its last piece, and gives the next word if it is
one of the WHOLE most frequent, or else its first piece, or the end. What follows
the first piece comes from all training words that begin so, by their counts; a
DISCOUNT off each count goes to the other model, which reads the pieces of a word
and gives the next piece or the word's close.

Training texts are dealt by a hash of their pieces and ids to shards of about
SHARD_PIECES, so shards, and with them scores, do not hang on how the input is
split. The first shard is learned first; every other one goes on from there with
all windows of all its texts, end to end; the weights are averaged by how much
each shard learned. Distinct words are dealt and learned in the same way, each
once. At scoring, windows of WINDOW words overlap, and each word is scored once,
in masked batches.

Word counts are a shuffle over all texts. Every word keeps its count, and what
follows its first piece is worked out once in the whole corpus: words of up to
PACKED pieces travel as two numbers, longer ones as overlapping runs of them. The
counts of at most FREQUENT words are broadcast, the others are joined to the texts.

Null and empty texts are an end alone. Texts may be of any length. Repeated rows
are scored one by one; null ids are not held out, and their rows are dealt by
where they stand in the input. Extra columns are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import BUCKETS, MEMBERS, START, Adam, Attention, initial, keep_memory, windows_of
from .bpe import read_file
from .common import crc_bucket, cut, keyed_text, map_batches
from .textkernel import ASCII_LOWER, SPACED, mix, run_hashes

#: Positions of a window, and how many of them a scoring window adds to the one before.
WINDOW, STEP = 24, 18
#: Pieces of a word that travel with its count.
PACKED = 8
#: The most words whose counts are broadcast.
FREQUENT = 1 << 18
#: The most frequent words, which are given at once and not spelled.
WHOLE = 480
#: Taken off the count of every word, for words that were never seen.
DISCOUNT = 0.75
#: Pieces of a shard; windows of a training step; pieces that are worked on at a time.
SHARD_PIECES, BATCH_WINDOWS, STEP_PIECES = 16_000_000, 256, 2_000_000
RATE, GO_ON_RATE = 0.006, 0.003
#: Steps that a shard should have at least, and passes over it that are made for them at most.
STEPS, PASSES = 200, 10
#: Rows whose weights one task sums, and that reach the driver.
MERGED = 16
#: Distinct words whose counts a task gathers before it hands them on.
GATHERED = 1 << 19
#: Letters of a word that are spelled together.
RUN = 64
#: Bytes of text that are spelled, and pieces that are scored, at a time, so that what is worked on stays in a core's cache.
SPELL_BYTES, SCORED_PIECES = 1 << 18, 1 << 17


class Table:
    """Places of distinct 64-bit hashes in the order they came in, by open addressing; room: for how many, at least."""

    def __init__(self, hashes: np.ndarray, room: int = 0):
        bits = max(4, int(np.ceil(np.log2(max(1, len(hashes), room) * 3))))
        self.shift, self.mask, self.many = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.hashes, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.add(hashes)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes that are not there yet, and for which there is room."""
        slot, rest = (hashes >> self.shift).astype(np.int64), np.arange(len(hashes))
        while rest.size:
            at = slot[rest]
            free = self.place[at] < 0
            self.hashes[at[free]], self.place[at[free]] = hashes[rest[free]], self.many + rest[free]
            rest = rest[self.place[at] != self.many + rest]
            slot[rest] = (slot[rest] + 1) & self.mask
        self.many += len(hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not there."""
        slot = (hashes >> self.shift).astype(np.int64)
        place = self.place[slot]
        other = np.flatnonzero((place >= 0) & (self.hashes[slot] != hashes))
        while other.size:
            slot[other] = (slot[other] + 1) & self.mask
            place[other] = self.place[slot[other]]
            other = other[(place[other] >= 0) & (self.hashes[slot[other]] != hashes[other])]
        return place


class Speller:
    """Texts as subword ids; a word's first piece, and no other, begins with the space before it. Remembers by a 64-bit hash how words are spelled, and forgets all when it is full."""

    def __init__(self, ranks: dict[bytes, int], room: int = 1 << 20):
        self.encoding = tiktoken.Encoding("pieces", pat_str=f" ?[^ ]{{1,{RUN}}}", mergeable_ranks=ranks, special_tokens={})
        self.room = room
        self.forget(room)

    def forget(self, room: int) -> None:
        self.at = Table(np.zeros(0, np.uint64), room)
        # Grown by doubling; the first at.many words, and filled pieces, count.
        self.first, self.size, self.pieces, self.filled = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.uint16), 0

    def learn(self, hashes: np.ndarray, words: list[bytes], opens: np.ndarray) -> None:
        pieces = np.array(self.encoding.encode_ordinary(" " + b" ".join(words).decode()), np.uint16)
        first = np.flatnonzero(opens[pieces])
        if self.filled + len(pieces) > len(self.pieces):
            self.pieces = np.concatenate([self.pieces, np.zeros(self.filled + len(pieces), np.uint16)])
        self.pieces[self.filled : self.filled + len(pieces)] = pieces
        own = slice(self.at.many, self.at.many + len(words))
        self.first[own], self.size[own] = first + self.filled, np.diff(first, append=len(pieces))
        self.filled += len(pieces)
        self.at.add(hashes)

    def __call__(self, texts: list[bytes], opens: np.ndarray) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 16-bit integers."""
        at = size = 0
        for k, text in enumerate(texts):
            if size and size + len(text) > SPELL_BYTES:
                yield from self.spelled(texts[at:k], opens)
                at, size = k, 0
            size += len(text)
        yield from self.spelled(texts[at:], opens)

    def spelled(self, texts: list[bytes], opens: np.ndarray) -> Iterator[bytes]:
        letters = ASCII_LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        edge = np.diff(SPACED[letters].view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        hashes = run_hashes(letters, starts, ends - starts)
        which = self.at.find(hashes)
        if len(new := np.flatnonzero(which < 0)):
            new = new[np.unique(hashes[new], return_index=True)[1]]
            if self.at.many + len(new) > len(self.first):
                new = np.unique(hashes, return_index=True)[1]
                self.forget(max(self.room, len(new)))
            data = letters.tobytes()
            self.learn(hashes[new], [data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())], opens)
            which = self.at.find(hashes)
        sizes = self.size[which]
        stops = np.cumsum(sizes)
        flat = self.pieces[np.repeat(self.first[which] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        cuts = np.concatenate([[0], stops])[offsets]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield flat[a:b].tobytes()


class Vocabulary:
    """The subword ids of a rank file; one more id, `stop`, ends words and texts."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.stop = max(self.ranks.values()) + 1
        if self.stop >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.opens = np.zeros(self.stop + 1, bool)
        self.opens[[i for t, i in self.ranks.items() if t[:1] == b" "]] = True
        self.own_speller: Speller | None = None

    def speller(self) -> Speller:
        """One for each worker process, which keeps what it has learned from task to task."""
        self.own_speller = self.own_speller or Speller(self.ranks)
        return self.own_speller


class Words:
    """The words of some texts (ids laid end to end): where they begin and end, how many each text has, and a hash of each."""

    def __init__(self, texts: list[bytes], opens: np.ndarray):
        ids = np.frombuffer(b"".join(texts), "<u2")
        self.ids = ids.astype(np.int64)
        self.first = np.flatnonzero(opens[self.ids])
        self.size = np.diff(self.first, append=len(self.ids))
        self.last = self.first + self.size - 1
        self.offsets = np.searchsorted(self.first, np.cumsum([0, *(len(t) // 2 for t in texts)]))
        self.hashes = np.zeros(len(self.first), np.uint64)
        if len(ids):
            self.hashes = run_hashes(ids, self.first, self.size)


def id_steps(batch: pa.RecordBatch, column: int, most: int = STEP_PIECES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, packed ids) of consecutive parts of a batch, of about `most` pieces each."""
    texts, at, size = batch.column(column).to_pylist(), 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > 2 * most:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(text)
    if texts:
        yield at, texts[at:]


def spelled_texts(texts: DataFrame, vocabulary) -> DataFrame:
    """(row, doc_id, trained, ids) of (doc_id, text, trained), packed as unsigned 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, row = vocabulary.value.speller(), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = [*spell(batch.column(1).cast(pa.binary()).to_pylist(), vocabulary.value.opens)]
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(2), pa.array(ids, pa.binary())], ["row", "doc_id", "trained", "ids"])

    return map_batches(texts, run, f"row long, doc_id {texts.dtypes[0][1]}, trained boolean, ids binary")


#: Kinds of counts: words by their hash, first pieces of words, other pieces, and runs of the pieces of long words by a hash.
WORD, OPENING, INNER, RUN_OF = 0, 1, 2, 3
COUNTS = "kind int, word long, size int, low long, high long, n long"
#: Stands where a packed word has no piece.
NO_PIECE = 0xFFFF


def packed_pieces(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first PACKED pieces of words in two 64-bit numbers."""
    place = np.arange(PACKED)
    pieces = np.where(place < size[:, None], ids[np.minimum(first[:, None] + place, len(ids) - 1)], NO_PIECE).astype("<u2")
    both = np.ascontiguousarray(pieces).view("<i8")
    return both[:, 0], both[:, 1]


def unpacked_pieces(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces laid end to end, how many each word has)."""
    pieces = np.ascontiguousarray(np.stack([low, high], axis=1)).view("<u2").astype(np.int64)
    there = pieces != NO_PIECE
    return pieces[there], there.sum(axis=1)


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which equal hashes lie together, where each group of them begins)."""
    # Numbers sort faster than places by numbers: places stand in the low bits.
    bits = np.uint64(max(1, len(hashes).bit_length()))
    keys = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)
    keys.sort()
    order = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered, high = hashes.take(order), keys >> bits
    new = ordered[1:] != ordered[:-1]
    if (new & (high[1:] == high[:-1])).any():  # hashes that differ in the low bits alone
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(hashes)), bool), new]))


class Gathered:
    """Counts of distinct words (word, size, low, high, n) from many parts, at most GATHERED of them once they are merged."""

    def __init__(self):
        self.parts, self.many = [], 0

    def add(self, *columns: np.ndarray) -> Iterator[list[np.ndarray]]:
        self.parts.append(columns)
        self.many += len(columns[0])
        if self.many > 2 * GATHERED:
            self.merge()
            if self.many > GATHERED:
                yield from self.handed_on()

    def merge(self) -> None:
        *same, n = (np.concatenate(c) for c in zip(*self.parts))
        order, first = grouped(same[0].view(np.uint64))
        self.parts = [(*(c[order[first]] for c in same), np.add.reduceat(n[order], first))]
        self.many = len(first)

    def handed_on(self) -> Iterator[list[np.ndarray]]:
        if self.many:
            self.merge()
            for k in range(0, self.many, 1 << 16):
                yield [c[k : k + (1 << 16)] for c in self.parts[0]]
        self.parts, self.many = [], 0


def corpus_counts(texts: DataFrame, vocabulary) -> DataFrame:
    """COUNTS of texts (trained, ids): n is the occurrences in trained ones, zero where only others have a word.

    low and high are the first PACKED pieces of a word or all of a run; size is the pieces of a word, or of a run (negative: the word goes on).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens = vocabulary.value.opens
        pieces, gathered = np.zeros((2, len(opens)), np.int64), Gathered()

        def rows(kind: int, word: np.ndarray, size: np.ndarray, packs: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> pa.RecordBatch:
            columns = [np.full(len(n), kind, np.int32), word, size.astype(np.int32), *packs, n.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "word", "size", "low", "high", "n"])

        for batch in batches:
            trained = np.array(batch.column(0).to_pylist(), bool)
            for start, part in id_steps(batch, 1):
                words = Words(part, opens)
                weight = np.repeat(trained[start : start + len(part)], np.diff(words.offsets))
                if not len(words.first):
                    continue
                order, begins = grouped(words.hashes)
                at = order[begins]
                found, n, first, size = words.hashes[at], np.add.reduceat(weight[order].astype(np.int64), begins), words.first[at], words.size[at]
                for word, of, low, high, many in gathered.add(found.view(np.int64), size, *packed_pieces(words.ids, first, size), n):
                    yield rows(WORD, word, of, (low, high), many)
                if (long := np.flatnonzero((size > PACKED) & (n > 0))).size:
                    # Runs share a piece with the one before; the last ends the word.
                    many = -(-(size[long] - 1) // (PACKED - 1))
                    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    begin = np.repeat(first[long], many) + nth * (PACKED - 1)
                    left = np.repeat(first[long] + size[long], many) - begin
                    own = np.minimum(left, PACKED)
                    named = mix(np.repeat(found[long], many) + nth.astype(np.uint64) + np.uint64(1))
                    yield rows(RUN_OF, named.view(np.int64), np.where(left > PACKED, -own, own), packed_pieces(words.ids, begin, own), np.repeat(n[long], many))
                opening = np.bincount(words.ids[words.first], weight, len(opens)).astype(np.int64)
                pieces += [opening, np.bincount(words.ids, np.repeat(weight, words.size), len(opens)).astype(np.int64) - opening]
        for word, size, low, high, n in gathered.handed_on():
            yield rows(WORD, word, size, (low, high), n)
        for kind, n in ((OPENING, pieces[0]), (INNER, pieces[1])):
            there = np.flatnonzero(n)
            nothing = np.zeros(len(there), np.int64)
            yield rows(kind, there, nothing, (nothing, nothing), n[there])

    same = [F.max(c).alias(c) for c in ("size", "low", "high")]
    # Tasks have merged their own; a partial aggregate before the shuffle would find next to nothing to merge.
    return map_batches(texts.select("trained", "ids"), run, COUNTS).repartition("kind", "word").groupBy("kind", "word").agg(*same, F.sum("n").alias("n"))


class Buckets:
    """Ids as BUCKETS buckets: all but MEMBERS of them hold one frequent id each, the rest share out the others."""

    def __init__(self, frequency: np.ndarray, given: np.ndarray):
        """frequency settles which ids stand alone; given: the occurrences that the probability inside a bucket follows."""
        alone = BUCKETS - MEMBERS
        order = np.argsort(-frequency, kind="stable")
        self.of = (alone + np.arange(len(frequency)) % MEMBERS).astype(np.int16)
        self.of[order[:alone]] = np.arange(alone)
        whole = np.bincount(self.of, given + 0.5, BUCKETS)
        self.popularity = whole / whole.sum()
        self.inside = np.log((given + 0.5) / whole[self.of])


class Positions:
    """Sequences laid end to end (size: of each): two ids a position, the bucket to be given there, and the id's probability inside its bucket. Joint sequences share windows."""

    def __init__(self, size: np.ndarray, one: np.ndarray, two: np.ndarray, goal: np.ndarray, inside: np.ndarray, joint: bool):
        self.size, self.inside, self.joint, self.many = size, inside, joint, len(one)
        # A window may begin or end where there is no position.
        around = lambda values, outside: np.concatenate([np.full(WINDOW, outside, values.dtype), values, np.full(WINDOW, outside, values.dtype)])
        self.one, self.two, self.goal = around(one, START), around(two, START), around(goal, 0)
        self.runs = np.array([len(one)]) if joint else size
        self.group = around(np.repeat(np.arange(len(size), dtype=np.int32), size), -1)

    def log_probability(self, model: Attention) -> np.ndarray:
        """The natural logarithm of the probability of the id at each position, from windows that overlap by WINDOW - STEP."""
        p, lead, known = np.zeros(self.many + 2 * WINDOW), WINDOW - STEP, model.products()
        index, given = windows_of(self.runs, WINDOW, STEP)
        index += WINDOW
        for k in range(0, len(index), 2 * BATCH_WINDOWS):
            at, own = index[k : k + 2 * BATCH_WINDOWS], given[k : k + 2 * BATCH_WINDOWS, lead:]
            p[at[:, lead:][own]] = model.log_probability(self.one[at], self.two[at], self.group[at], self.goal[at[:, lead:]], lead, known)[own]
        return p[WINDOW : self.many + WINDOW] + self.inside

    def learn(self, adam: Adam, batch: int) -> int:
        """A step for every batch of windows, which do not overlap; returns how many windows there were."""
        index, given = windows_of(self.runs, WINDOW, WINDOW)
        index += WINDOW
        # Neighbours are alike; steps take windows from everywhere.
        order = np.argsort(mix(np.arange(len(index), dtype=np.uint64)))
        for k in range(0, len(index), batch):
            at, weight = index[order[k : k + batch]], given[order[k : k + batch]].astype(np.float32)
            # Where sequences do not share windows, what lies beyond the end comes after it and is seen by none of it.
            adam.step(self.one[at], self.two[at], self.group[at] if self.joint else None, self.goal[at], weight / weight.sum())
        return len(order)


class Language:
    """Both models and their buckets. Words among `whole` (hashes and counts) are given at once, all others by their first piece and what follows it."""

    def __init__(self, opening: np.ndarray, inner: np.ndarray, texts: int, stop: int, whole: np.ndarray, n: np.ndarray):
        words = opening.sum()
        order = np.argsort(whole)
        self.whole, self.stop = whole[order], stop
        self.place = Table(self.whole)
        every, given = np.concatenate([opening, n[order]]), inner.copy()
        every[stop], given[stop] = texts, words
        self.opening, self.inner = Buckets(every, every), Buckets(opening + given, given)
        self.models = [Attention(WINDOW, initial(WINDOW, self.opening.popularity)), Attention(WINDOW, initial(WINDOW, self.inner.popularity), WINDOW - STEP)]

    def heads(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(the id that opens each word: its own or that of its first piece; which words have their own)."""
        at = self.place.find(words.hashes)
        return np.where(at >= 0, self.stop + 1 + at, words.ids[words.first]), at >= 0

    def pack(self, which: int) -> bytes:
        return b"".join(v.astype("<f4").tobytes() for v in self.models[which].weights.values())

    def unpack(self, which: int, data: bytes) -> None:
        values, at, weights = np.frombuffer(data, "<f4"), 0, self.models[which].weights
        for k, v in weights.items():
            weights[k] = values[at : at + v.size].reshape(v.shape).copy()
            at += v.size

    def text_positions(self, words: Words, heads: np.ndarray) -> Positions:
        """Every word of every text, then the text's end."""
        # A word is one place further for each text before its own.
        many, ends = np.diff(words.offsets), words.offsets[1:]
        goal, last = np.insert(heads, ends, self.stop), np.insert(words.ids.take(words.last), ends, self.stop)
        given = self.opening.of.take(goal)
        one, two = np.roll(given, 1), np.roll(self.inner.of.take(last), 1)
        # Nothing stands before a text's first word.
        begin = np.cumsum(many + 1) - (many + 1)
        one[begin], two[begin] = START, START
        return Positions(many + 1, one, two, given, self.opening.inside.take(goal), False)

    def word_positions(self, ids: np.ndarray, size: np.ndarray, closed: np.ndarray | None = None) -> Positions:
        """Every piece after the first of words laid end to end, then the word's close (unless it is not closed)."""
        ends = np.cumsum(size)
        within = np.arange(len(ids)) - np.repeat(ends - size, size)
        one = self.inner.of[ids]
        two = np.where(within > 0, np.concatenate([[START], one[:-1]]), START).astype(np.int16) if len(ids) else one
        goal = np.append(ids[1:], self.stop)[: len(ids)]
        goal[ends - 1] = self.stop
        if closed is not None and not closed.all():
            kept = np.ones(len(ids), bool)
            kept[ends[~closed] - 1] = False
            one, two, goal, size = one[kept], two[kept], goal[kept], size - ~closed
        return Positions(size, one, two, self.inner.of[goal], self.inner.inside[goal], True)

    def spelled(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of what follows the first piece of words laid end to end."""
        p = self.word_positions(ids, size).log_probability(self.models[1])
        return np.add.reduceat(p, np.cumsum(size) - size) if len(size) else p

    def openings(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(natural logarithms of the probability of each word's opening, of each text's end; which words have no more than that)."""
        heads, own = self.heads(words)
        positions = self.text_positions(words, heads)
        p = positions.log_probability(self.models[0])
        ends = np.cumsum(positions.size) - 1
        return np.delete(p, ends), p[ends], own


def learned_shards(dealt: DataFrame, language: Language, which: int, read: Callable[[Language, pa.RecordBatch], Positions], weights: bytes, rate: float, steps: int, batch: int) -> DataFrame:
    """(shard, seen, weights) from rows (shard, ...) that are dealt and sorted by shard: what each shard makes of the weights that it is given. read makes positions of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        shard = adam = None
        seen, own = 0, language

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(seen)]), pa.array([own.pack(which)], pa.binary())], ["shard", "seen", "weights"])

        for rows in batches:
            of = rows.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            for first, last in zip(cuts, np.append(cuts[1:], len(of))):
                if of[first] != shard:
                    if shard is not None:
                        yield ended()
                    own.unpack(which, weights)
                    shard, seen, adam = int(of[first]), 0, Adam(own.models[which], rate, steps)
                for part in parts_of(rows.slice(first, last - first)):
                    seen += read(own, part).learn(adam, batch)
        if shard is not None:
            yield ended()

    return map_batches(dealt, run, "shard int, seen double, weights binary")


def parts_of(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose packed ids, if they have any, are about STEP_PIECES together."""
    if "ids" not in rows.schema.names:
        yield rows
        return
    for first, texts in id_steps(rows, rows.schema.get_field_index("ids")):
        yield rows.slice(first, len(texts))


def averaged(learned: DataFrame, many: int) -> bytes | None:
    """The mean of the weights of `many` shards, weighted by seen. Rounds of tasks sum MERGED rows each until MERGED are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, total, seen = None, None, 0.0
        for rows in batches:
            for s, n, packed in zip(*(rows.column(k).to_pylist() for k in range(3))):
                if s // MERGED != into:
                    if into is not None:
                        yield row(into, seen, total)
                    into, total, seen = s // MERGED, None, 0.0
                mean = np.frombuffer(packed, "<f4").astype(np.float64)
                total, seen = (0 if total is None else total) + n * mean, seen + n
        if into is not None:
            yield row(into, seen, total)

    def row(into: int, seen: float, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([into], pa.int32()), pa.array([seen]), pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())], ["shard", "seen", "weights"])

    while many > MERGED:
        many = -(-many // MERGED)
        dealt = learned.repartition(many, F.floor(F.col("shard") / MERGED)).sortWithinPartitions("shard")
        learned = map_batches(dealt, run, "shard int, seen double, weights binary")
    rows = sorted(learned.collect(), key=lambda r: r["shard"])
    if not rows:
        return None
    total = sum(r["seen"] for r in rows)
    return sum(r["seen"] / total * np.frombuffer(r["weights"], "<f4").astype(np.float64) for r in rows).astype("<f4").tobytes()


def train(language: Language, which: int, rows: DataFrame, key, read: Callable[[Language, pa.RecordBatch], Positions], size: int, shard_size: int, positions: int) -> None:
    """Learn the weights of a model of `language` from all rows, which are dealt by a key; size: of the rows, in units of shard_size; positions: how many they make."""
    shards = max(1, -(-size // shard_size))
    windows = max(1.0, positions / shards / WINDOW)
    # A small corpus is learned in small steps, and more than once.
    batch = int(np.clip(windows / STEPS, 16, BATCH_WINDOWS))
    passes = int(np.clip(np.ceil(STEPS * batch / windows), 1, PASSES)) if shards == 1 else 1
    steps, columns = int(passes * windows / batch), rows.columns
    dealt = rows.withColumn("key ", key).withColumn("shard", F.pmod("key ", F.lit(shards)).cast("int"))
    # One task: the first shard has about shard_size however many there are.
    first = dealt.where("shard = 0").withColumn("pass ", F.explode(F.sequence(F.lit(1), F.lit(passes)))).repartition(1).sortWithinPartitions("pass ", "key ").select("shard", *columns)
    begun = averaged(learned_shards(first, language, which, read, language.pack(which), RATE, steps, batch), 1) or language.pack(which)
    if shards > 1:
        # More partitions than shards, most of them empty: few shards meet in one.
        rest = dealt.where("shard > 0").repartition(8 * shards, "shard").sortWithinPartitions("shard", "key ").select("shard", *columns)
        begun = averaged(learned_shards(rest, language, which, read, begun, GO_ON_RATE, steps, batch), shards) or begun
    language.unpack(which, begun)


def train_openings(language: Language, texts: DataFrame, vocabulary, pieces: int, positions: int) -> None:
    """From every window of texts (row, doc_id, ids)."""

    def read(own: Language, rows: pa.RecordBatch) -> Positions:
        words = Words(rows.column(1).to_pylist(), vocabulary.value.opens)
        return own.text_positions(words, own.heads(words)[0])

    key = F.xxhash64("ids", F.coalesce(F.col("doc_id").cast("string"), F.col("row").cast("string")))
    train(language, 0, texts.select("row", "doc_id", "ids"), key, lambda own, rows: read(own, rows.select([0, 3])), pieces, SHARD_PIECES, positions)


def train_spelling(language: Language, counts: DataFrame) -> None:
    """From every trained word of counts that is not whole, once, however often it occurs."""

    def read(own: Language, rows: pa.RecordBatch) -> Positions:
        ids, size = unpacked_pieces(rows.column(1).to_numpy(), rows.column(2).to_numpy())
        return own.word_positions(ids, size, rows.column(3).to_numpy() > 0)

    words = counts.where(F.col("n") > 0).where(F.col("kind").isin(WORD, RUN_OF) & (F.col("kind").eqNullSafe(RUN_OF) | (F.col("size") <= PACKED)))
    words = not_whole(words, language.whole).select("word", "low", "high", "size")
    positions = words.agg(F.coalesce(F.sum(F.abs("size")), F.lit(0))).first()[0]
    train(language, 1, words, F.xxhash64("word"), lambda own, rows: read(own, rows.select([0, 2, 3, 4])), positions, SHARD_PIECES // 4, positions)


def not_whole(words: DataFrame, whole: np.ndarray) -> DataFrame:
    return words.where(~F.col("word").isin(whole.view(np.int64).tolist())) if len(whole) else words


def spelled_words(counts: DataFrame, language: Language) -> DataFrame:
    """(word, first, n, rest) of all words: the first piece, and the natural logarithm of what follows it, 0 for whole words and for those of more than PACKED pieces."""
    shared = counts.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        own = shared.value
        for rows in batches:
            word, size, low, high = (rows.column(k).to_numpy() for k in (0, 2, 3, 4))
            rest = np.zeros(len(word), np.float32)
            asked = np.flatnonzero((size <= PACKED) & ~np.isin(word, own.whole.view(np.int64)))
            rest[asked] = own.spelled(*unpacked_pieces(low[asked], high[asked]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array((low & NO_PIECE).astype(np.int32)), rows.column(1), pa.array(rest)], ["word", "first", "n", "rest"])

    return map_batches(counts.where(F.col("kind") == WORD).select("word", "n", "size", "low", "high"), run, "word long, first int, n long, rest float")


def frequent(words: DataFrame) -> DataFrame:
    """The most frequent of words (word, n, ...), FREQUENT at most: whole levels of an eighth of a doubling."""
    level, words = F.floor(F.log2("n") * 8), words.where("n > 0")
    room, lowest = FREQUENT, None
    for row in words.groupBy(level.alias("level")).agg(F.count("*").alias("many")).orderBy(F.desc("level")).collect():
        room -= row["many"]
        if room < 0:
            break
        lowest = row["level"]
    return words.where(level >= lowest) if lowest is not None else words.limit(0)


def begun_so(words: DataFrame, whole: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, distinct words) by first piece, of trained words (word, first, n) that are not whole."""
    out = np.zeros((2, stop + 1))
    for r in not_whole(words.where("n > 0"), whole).groupBy("first").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        out[:, r["first"]] = r["n"], r["kinds"]
    return out[0], out[1]


class Often:
    """What words (word, first, n, rest: a pandas frame) and first pieces add to scores, by their place; the last place is that of no word and adds nothing.

    n_so, kinds_so: occurrences and distinct words by first piece.
    """

    def __init__(self, words, whole: np.ndarray, n_so: np.ndarray, kinds_so: np.ndarray, scale: float):
        hashes, first, n = words["word"].to_numpy(np.int64).view(np.uint64), words["first"].to_numpy(np.int64), words["n"].to_numpy(np.int64)
        self.at, self.n = Table(hashes), n
        self.log_all = np.log10(np.maximum(n_so, 1))
        # What is left of the first piece's words for those never seen; all, if none begins so.
        self.spare = np.where(kinds_so > 0, DISCOUNT * kinds_so, 1.0)
        score = np.where(np.isin(hashes, whole), 0.0, self.scores(n, first, words["rest"].to_numpy(np.float64)))
        self.score, self.base = np.append(score, 0.0), np.append(np.log10((n + 0.5) / scale), 0.0)

    def scores(self, n: np.ndarray, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The log10 probability of what follows words' first pieces; rest: its natural logarithm by spelling."""
        return np.log10(np.maximum(n - DISCOUNT, 0) + self.spare[first] * np.exp(rest)) - self.log_all[first]


def score_texts(docs: DataFrame, train_condition, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text; counts and weights come from the rows under train_condition.

    base_score is the smoothed word-unigram log10 probability that the score is to be held against.
    """
    texts = keyed_text(docs, id_col, text_col)
    kind = texts.dtypes[0][1]
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(Vocabulary(read_file(docs, vocabulary_path)))
    stop = vocabulary.value.stop
    spelled = cut(spelled_texts(texts.withColumn("trained", F.coalesce(train_condition, F.lit(False))), vocabulary))
    learnt = spelled.where("trained")
    counts = cut(corpus_counts(spelled, vocabulary))
    ends = learnt.count()
    is_word = F.col("kind") == WORD
    n_words, types = counts.where(is_word & (F.col("n") > 0)).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, types = n_words + ends, types + (ends > 0)
    # One row for each piece of the vocabulary and kind at most.
    pieces = np.zeros((3, stop + 1), np.float64)
    for r in counts.where(F.col("kind").isin(OPENING, INNER)).select("kind", "word", "n").collect():
        pieces[r["kind"], r["word"]] = r["n"]
    top = frequent(counts.where(is_word)).orderBy(F.desc("n"), "word").limit(WHOLE).select("word", "n").toPandas()
    language = Language(pieces[OPENING], pieces[INNER], ends, stop, top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))
    train_openings(language, learnt, vocabulary, int(pieces.sum()), int(tokens))
    train_spelling(language, counts)
    words = cut(spelled_words(counts, language))
    hot = frequent(words).toPandas()
    scale = tokens + 0.5 * (types + 1)
    shared = context.broadcast((language, Often(hot, language.whole, *begun_so(words, language.whole, stop), scale)))
    end_base = float(np.log10((ends + 0.5) / scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        language, often = shared.value
        for batch in batches:
            for first, part in id_steps(batch, 2, SCORED_PIECES):
                own = Words(part, vocabulary.value.opens)
                opening, end, own_id = language.openings(own)
                begins = own.ids[own.first]
                at = often.at.find(own.hashes)
                found, score, base = at >= 0, often.score.take(at, mode="wrap"), often.base.take(at, mode="wrap")
                rare = np.flatnonzero(~found)
                score[rare] = np.where(own_id[rare], 0.0, -often.log_all[begins[rare]])
                spare, rest = often.spare[begins[rare]], np.zeros(len(rare))
                if (long := np.flatnonzero((own.size > PACKED) & ~own_id)).size:
                    pieces = own.ids[np.repeat(own.first[long] - (np.cumsum(own.size[long]) - own.size[long]), own.size[long]) + np.arange(own.size[long].sum())]
                    spelled_long, known = language.spelled(pieces, own.size[long]), found[long]
                    rest[np.searchsorted(rare, long[~known])] = spelled_long[~known]
                    score[long[known]] = often.scores(often.n[at[long[known]]], begins[long[known]], spelled_long[known])
                score += opening / np.log(10)
                sums = [np.concatenate([[0], np.cumsum(x)])[own.offsets] for x in (found, base, score)]
                listed = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(rare, own.offsets), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(own.hashes[rare].view(np.int64)), pa.array(spare.astype(np.float32)), pa.array(rest.astype(np.float32))], ["word", "spare", "rest"]),
                )
                columns = [
                    batch.column(0).slice(first, len(part)),
                    batch.column(1).slice(first, len(part)),
                    pa.array(np.diff(own.offsets) + 1, pa.int64()),
                    pa.array(np.diff(sums[0]).astype(np.int64) + (ends > 0)),
                    pa.array(np.diff(sums[1]) + end_base),
                    pa.array(np.diff(sums[2]) + end / np.log(10)),
                    listed,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    scored = cut(map_batches(spelled.select("row", "doc_id", "ids"), run, f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:bigint,spare:float,rest:float>>"))
    asked = scored.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.spare", F.col("rare.rest").alias("long_rest"))
    # Every word is in the table; rest is 0 there for long words, long_rest for all others.
    spare = F.col("spare").cast("double") * F.exp(F.col("rest").cast("double") + F.col("long_rest"))
    known = (
        asked.join(words.select("word", "n", "rest"), "word")
        .groupBy("row")
        .agg(
            F.count_if(F.col("n") > 0).alias("more"),
            F.sum(F.log10((F.col("n") + 0.5) / F.lit(float(scale)))).alias("more_base"),
            F.sum(F.log10(F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + F.greatest(spare, F.lit(1e-300)))).alias("more_score"),
        )
    )
    out = scored.drop("rare").join(known, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def training_rows(id_col: str = "doc_id"):
    return F.coalesce(crc_bucket(id_col, 5) != 1, F.lit(True))
