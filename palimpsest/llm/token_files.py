"""Token ids in files, compressed by Re-Pair, for random access.

A shard holds the ids of consecutive documents, about SHARD of them. Round by round its frequent pairs of adjacent symbols
are replaced by nonterminals, until no pair is frequent. Stored are the rules (left and right symbol), the length that
each expands to, the remaining symbols, and where each document's symbols end. No symbol spans two documents, so one
document is decoded from its own symbols and the rules alone, and the lengths say where an id lies before any
expansion.

A file is a Parquet file with a row for each shard; fields below. Shards are ordered by (part, at), documents by doc_id,
null first, and equal ids by a hash of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress as picked
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import BATCH, settings, ship, tidied
from palimpsest.llm.pieces import ChunkTable, Ids, Table, gather, runs

#: Ids from which a shard is closed, and how often a pair must occur in it to become a rule.
SHARD, LEAST = 1 << 20, 16

#: at: ids of this part's shards before this one. base: number of terminals; symbol base + k stands for rule k.
#: least, most: the range of doc_ids that aren't null, by which files and their row groups are passed over.
SCHEMA = "part int, at long, n_tokens long, base int, least long, most long, doc_ids array<long>, doc_symbols array<int>, rules binary, rule_lengths binary, wide boolean, symbols binary"


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (k x 2), their expanded lengths, symbols, and the end of each document's symbols.

    Each round counts pairs and replaces those that occur at least so often without overlaps; where two of them overlap the more frequent
    goes first, and a pair that is left with too few places waits. It ends when no pair is frequent.

    A pair of two symbols that both are there already never becomes more frequent. So a round looks at places of pairs that were frequent in the round
    before, and at those beside symbols made in it; any other pair was counted when the later of its symbols was new.
    """
    full = np.diff(ends, prepend=0) > 0
    seq, last = ids.astype(np.int32), np.zeros(len(ids), bool)
    last[ends[full] - 1] = True  # the last symbol of its document
    found, symbols = [np.empty((0, 2), np.int64)], base
    live = np.flatnonzero(~last)
    # While many places are looked at, symbols stand side by side, and close up after each round.
    while len(live) > len(seq) >> 3:
        n = len(seq)
        frequent = _frequent_pairs(live, seq.take(live), seq.take(live + 1), None, least, symbols, n)
        if not frequent:
            live = live[:0]
            break
        live, own, pairs, odd = frequent
        rank = np.full(n + 2, -1, np.int32)  # of place k at k + 1
        rank[live + 1] = own
        rank[odd + 1] = -1
        won = []
        while True:
            first = np.zeros(n + 2, bool)
            first[1:-1] = (rank[1:-1] > rank[:-2]) & (rank[1:-1] >= rank[2:])
            spots = np.flatnonzero(first)
            if not len(spots):
                break
            won.append((spots - 1, rank.take(spots)))
            rank[spots] = rank[spots - 1] = rank[spots + 1] = -1
        spots, new, pairs = _kept(won, pairs, least)
        seq[spots] = symbols + new
        last[spots] = last[spots + 1]
        symbols += len(pairs)
        found.append(pairs)
        # 1: the last of its document, 2: a place to look at again, 4: a new symbol.
        marks, held = last.astype(np.uint8), np.ones(n, bool)
        marks[live] = 2
        marks[spots] = 6 + last.take(spots)
        held[spots + 1] = False
        at = np.flatnonzero(held)
        seq, marks = seq.take(at), marks.take(at)
        last, again = (marks & 1) > 0, marks > 1
        again[:-1] |= marks[1:] > 3
        live = np.flatnonzero(again & ~last)
    # Then they are a list linked both ways; place n is none. Places are of the type that numpy takes as an index as it is.
    n = len(seq)
    seq = np.append(seq, np.int32(-1))
    after, before = np.arange(1, n + 2, dtype=np.intp), np.arange(-1, n, dtype=np.intp)
    after[:n][last] = n
    before[1:][last] = n
    before[0] = after[n] = before[n] = n
    held = np.ones(n + 1, bool)
    held[n] = False
    rank_at, taken = np.full(n + 1, -1, np.int32), np.zeros(n + 1, bool)
    while len(live):
        frequent = _frequent_pairs(live, seq.take(live), seq.take(after.take(live)), after, least, symbols, n)
        if not frequent:
            break
        live, own, pairs, odd = frequent
        rank_at[live] = own
        rank_at[odd] = -1
        wanted = np.flatnonzero(rank_at.take(live) >= 0)
        rank_at[live] = -1
        spots, own = live.take(wanted), own.take(wanted)
        won = []
        while len(spots):
            rank_at[spots] = own
            first = (own > rank_at.take(before.take(spots))) & (own >= rank_at.take(after.take(spots)))
            rank_at[spots] = -1
            ahead, rest = np.flatnonzero(first), np.flatnonzero(~first)
            won.append((spots.take(ahead), own.take(ahead)))
            taken[won[-1][0]] = True
            spots, own = spots.take(rest), own.take(rest)
            free = np.flatnonzero(~(taken.take(before.take(spots)) | taken.take(after.take(spots))))
            spots, own = spots.take(free), own.take(free)
        for x, _ in won:
            taken[x] = False
        spots, new, pairs = _kept(won, pairs, least)
        seq[spots] = symbols + new
        symbols += len(pairs)
        found.append(pairs)
        gone = after[spots]
        held[gone] = False
        after[spots] = after[gone]
        before[after[spots]] = spots
        before[n] = n
        # Places to look at again.
        again = np.zeros(n + 1, bool)
        again[live] = again[spots] = again[before[spots]] = True
        live = np.flatnonzero(again)
        live = live.take(np.flatnonzero(held.take(live) & (after.take(live) < n)))
    rules, sizes = np.concatenate(found), [1] * base
    for a, b in rules.tolist():
        sizes.append(sizes[a] + sizes[b])
    lengths = np.array(sizes[base:], np.int64)
    at, out = np.flatnonzero(held), np.zeros(len(ends), np.int64)
    out[full] = np.flatnonzero(after.take(at) == n) + 1
    return rules, lengths, seq.take(at).astype(np.int64), np.maximum.accumulate(out) if len(out) else out


def _kept(won: list[tuple[np.ndarray, np.ndarray]], pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs that still have enough, which of those pairs each has, and those pairs. The most frequent pair keeps all its places, so that each round makes a rule."""
    spots, own = (np.concatenate(x) for x in zip(*won, strict=True))
    used = np.bincount(own, minlength=len(pairs)) >= least
    keep = np.flatnonzero(used.take(own))
    return spots.take(keep), (np.cumsum(used) - 1).take(own.take(keep)), pairs[used]


def _frequent_pairs(live: np.ndarray, left: np.ndarray, right: np.ndarray, after: np.ndarray | None, least: int, symbols: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Places of frequent pairs, the rank of each one's pair, these pairs from the rarest on, and places that overlap with the one before. after: the place after each; by default the next."""
    # Pairs whose hash few places have aren't frequent, and needn't be sorted.
    # An eighth of the places tells whether enough are dropped for that to be worth while.
    some = len(live) >> 3
    if len(live) > 1 << 15 and np.mean(_not_alone(left[:some], right[:some], max(2, least >> 3))) < 0.6:
        likely = np.flatnonzero(_not_alone(left, right, least))
        if not len(likely):
            return None
        live, left, right = live.take(likely), left.take(likely), right.take(likely)
        del likely
    # Of places of one pair in a row, all of one symbol, every other one, from the first, can be taken.
    twins = odd = np.flatnonzero(left == right)
    if len(twins):
        at = live.take(twins)
        lead = np.concatenate(([True], ((at[:-1] + 1 if after is None else after.take(at[:-1])) != at[1:]) | (left[twins[1:]] != left[twins[:-1]])))
        nth = np.arange(len(twins)) - np.maximum.accumulate(np.where(lead, np.arange(len(twins)), 0))
        odd = twins[nth % 2 == 1]
    keys, at, bits = _sorted_pairs(left, right, live, symbols.bit_length(), max(1, n).bit_length())
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size, each = np.diff(start, append=len(keys)), keys.take(start)
    count = size
    if len(odd):
        count = size - np.bincount(np.searchsorted(each, (left[odd].astype(np.int64) << bits) | right[odd]), minlength=len(size))
    frequent = count >= least
    often = np.flatnonzero(frequent)
    if not len(often):
        return None
    by_count = np.argsort(count[often], kind="stable")
    rank_of = np.empty(len(often), np.int32)
    rank_of[by_count] = np.arange(len(often), dtype=np.int32)
    chosen = each.take(often.take(by_count))
    return at[np.repeat(frequent, size)], np.repeat(rank_of, size[often]), np.stack([chosen >> bits, chosen & ((1 << bits) - 1)], axis=1), live[odd]


def _not_alone(left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Whether a pair's hash has so many places."""
    bucket = (((left.astype(np.uint32) * np.uint32(0x9E3779B1) + right.astype(np.uint32)) * np.uint32(0x85EBCA6B)) >> np.uint32(14)).astype(np.intp)
    return (np.bincount(bucket, minlength=1 << 18) >= least).take(bucket)


def _sorted_pairs(left: np.ndarray, right: np.ndarray, live: np.ndarray, symbol_bits: int, place_bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs as numbers (left above, right in the lower bits) in their order, the place of each, and how many bits are lower. Pair and place are sorted as one number where they fit into one."""
    if 2 * symbol_bits + place_bits > 63:
        keys = (left.astype(np.int64) << 32) | right
        order = np.argsort(keys, kind="stable")
        return keys.take(order), live.take(order), 32
    both = (left.astype(np.int64) << (symbol_bits + place_bits)) | (right.astype(np.int64) << place_bits) | live
    both.sort()
    return both >> place_bits, both & ((1 << place_bits) - 1), symbol_bits


class Grammar:
    """The rules of a shard: what each symbol expands to, and to how many ids."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray):
        self.lengths = np.concatenate([np.ones(base, np.int64), lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = np.empty(int(self.lengths.sum()), np.int32)
        flat[:base] = np.arange(base)
        start = self.starts.tolist()
        n = self.lengths.tolist()
        for k, (a, b) in enumerate(rules.tolist(), base):
            at = start[k]
            flat[at : at + n[a]] = flat[start[a] : start[a] + n[a]]
            flat[at + n[a] : at + n[k]] = flat[start[b] : start[b] + n[b]]
        self.flat = flat

    def expand(self, symbols: np.ndarray) -> Ids:
        return gather(self.flat, self.starts, self.lengths, symbols)


def _packed(part: int, at: int, base: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(counts)
    rules, lengths, symbols, stops = compress(ids, ends, base)
    wide = base + len(rules) > 1 << 16
    own = [i for i in doc_ids if i is not None]
    row = [part, at, len(ids), base, own[0] if own else None, own[-1] if own else None, doc_ids, np.diff(stops, prepend=0).tolist(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), wide, symbols.astype("<u4" if wide else "<u2").tobytes()]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _shard(rule_bytes: bytes, length_bytes: bytes, base: int, wide: bool, symbol_bytes: bytes) -> tuple[Grammar, np.ndarray]:
    rules = np.frombuffer(rule_bytes, "<u4").reshape(-1, 2).astype(np.int64)
    return Grammar(base, rules, np.frombuffer(length_bytes, "<u4").astype(np.int64)), np.frombuffer(symbol_bytes, "<u4" if wide else "<u2").astype(np.int64)


class Encoder:
    """Ids by the tokenizers library, chunk by chunk; texts that hold an added token's string go to it whole."""

    def __init__(self, path: str, pattern: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            vocabulary = json.load(f)
        self.added = [x["content"] for x in vocabulary["added_tokens"]]
        self.base = self.tokenizer.get_vocab_size()
        split = vocabulary.get("pre_tokenizer") or {}
        self.by_piece = vocabulary["model"]["type"] == "BPE" and not vocabulary.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        # What a piece looks like to the model: bytes that don't print stand for characters from 256 on, in their order.
        self.shown = {c: 256 + n for n, c in enumerate([*range(33), *range(127, 161), 173])}
        self.character = np.arange(256, dtype="<u2")
        self.character[list(self.shown)] = list(self.shown.values())
        self.by_piece = self.by_piece and all(chr(c) in vocabulary["model"]["vocab"] for c in self.character.tolist())
        self.agreed: dict[str, bool] = {}
        # 1: letters, 2: numbers, 3: others. 0: white space, the apostrophe, and what isn't agreed on or wasn't met yet.
        self.kinds = np.zeros(0x110000, np.uint8)
        self.findall = regex.compile(pattern).findall
        # In the file each byte of a token is one character.
        self.bytes = np.zeros(self.base, np.int64)
        for token, i in vocabulary["model"]["vocab"].items():
            self.bytes[i] = len(token)
        if self.by_piece:
            for c in map(chr, range(128)):
                self._split_alike(c)
            self.kinds[ord("'")] = 0
        self.table = ChunkTable(self._chunks, self._split, limit=1_500_000)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split_alike(self, c: str) -> bool:
        """Whether the library and the pattern take a character for the same kind: letter, number or other, not white space. Their versions of Unicode may differ."""
        if c not in self.agreed:
            text = f"a{c}1{c}!{c}a"
            each = [text[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            self.agreed[c] = len(each) == 5 and each == self.findall(text)
            if self.agreed[c]:
                self.kinds[ord(c)] = 1 if len(each[0]) == 2 else 2 if len(each[1]) == 3 else 3
        return self.agreed[c]

    def _split(self, text: str) -> list[str]:
        """Pieces of a text as the library cuts it: by the pattern, which is faster, if both agree on its characters."""
        if not self.by_piece or text.isascii() or all(c.isascii() or self._split_alike(c) for c in set(text)):
            return self.findall(text)
        return [text[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _plain_pieces(self, pieces: pa.StringArray) -> Ids:
        """Pieces, each different one by the library's model; bytes of tokens tell them apart."""
        coded, tokenize = pieces.dictionary_encode(), self.tokenizer.model.tokenize
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1]
        shown = self.character.take(np.frombuffer(coded.dictionary.buffers()[2], np.uint8)[: ends[-1]]).tobytes().decode("utf-16-le")
        ids = np.array([t.id for i, j in pairwise(ends.tolist()) for t in tokenize(shown[i:j])], np.int32)
        lengths = np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), ends[1:]) + 1, prepend=0)
        return gather(ids, np.cumsum(lengths) - lengths, lengths, coded.indices.to_numpy())

    def _cut(self, chunks: list[str], size: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """Pieces of chunks of a space, letters, numbers and others: they end where the kind changes, and the space goes with what follows. And where each chunk's pieces end."""
        text = "".join(chunks)
        points, ends = np.frombuffer(text.encode("utf-32-le"), "<u4"), np.cumsum(size)
        kind = self.kinds.take(points)
        kind[ends - size] = kind.take(ends - size + 1)
        new = np.append(True, kind[1:] != kind[:-1])
        new[ends - size] = True
        first = np.flatnonzero(new)
        bytes_to = np.cumsum(1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int32)
        offsets = np.append(np.append(np.int32(0), bytes_to.take(first[1:] - 1)), bytes_to[-1:])
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(text.encode())), np.append(np.searchsorted(first, ends[:-1]), len(first))

    def _chunks(self, chunks: list[str]) -> Table:
        """Chunks of one space and what isn't space at its ends are joined, as the pattern never joins them itself, and told apart again by lengths.

        Those of ASCII and of characters that the library and the pattern take for the same are cut into pieces, by the pattern if they hold white space or an apostrophe, and each
        different piece goes to the library's model once. For others, what the pattern matches depends on the version of Unicode: the library gets them joined, and bytes of tokens tell them apart. All else goes
        to the library chunk by chunk."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        bare = np.fromiter(map(len, map(str.strip, chunks)), np.int64, len(chunks))
        joined = (bare == size - 1) & (bare > 0) & np.fromiter(map(str.startswith, chunks, repeat(" ")), bool, len(chunks))
        plain = joined & np.fromiter(map(str.isascii, chunks), bool, len(chunks))
        wider = np.flatnonzero(joined & ~plain).tolist() if self.by_piece else []
        apart = {c for c in set("".join([chunks[i] for i in wider])) if not c.isascii() and not self._split_alike(c)}
        plain[[i for i in wider if apart.isdisjoint(chunks[i])] if apart else wider] = True
        plain &= self.by_piece
        lengths, starts, flats, used = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), [], 0

        def put(group: np.ndarray, ids: np.ndarray, stops: np.ndarray) -> None:
            nonlocal used
            lengths[group] = np.diff(stops, prepend=0)
            starts[group] = used + stops - lengths[group]
            flats.append(ids)
            used += len(ids)

        some = np.flatnonzero(plain)
        if len(some):
            own = [chunks[i] for i in some.tolist()]
            starts_at = np.cumsum(size[some]) - size[some]
            kind = self.kinds.take(np.frombuffer("".join(own).encode("utf-32-le"), "<u4"))
            kind[starts_at] = 1
            easy = np.minimum.reduceat(kind, starts_at) > 0
            if easy.any():
                pieces, ends = self._cut(list(picked(own, easy.tolist())), size[some[easy]])
                ids, width = self._plain_pieces(pieces)
                put(some[easy], ids, np.cumsum(width)[ends - 1])
            if not easy.all():
                pieces = self.findall("".join(picked(own, (~easy).tolist())))
                ids, width = self._plain_pieces(pa.array(pieces, pa.string()))
                last = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum(size[some[~easy]]))
                put(some[~easy], ids, np.cumsum(width)[last])
        some = np.flatnonzero(joined & ~plain)
        for at in range(0, len(some), 4096):
            group = some[at : at + 4096]
            own = [chunks[i] for i in group.tolist()]
            ids = np.array(self._whole(["".join(own)])[0], np.int32)
            put(group, ids, np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(c.encode()) for c in own])) + 1)
        rest = np.flatnonzero(~joined)
        for i, ids in zip(rest.tolist(), self._whole([chunks[i] for i in rest.tolist()]), strict=True):
            lengths[i], starts[i] = len(ids), used
            flats.append(np.array(ids, np.int32))
            used += len(ids)
        return np.concatenate(flats) if flats else np.empty(0, np.int32), starts, lengths

    def encode_runs(self, texts: pa.StringArray) -> Iterator[Ids]:
        special = np.zeros(len(texts), bool)
        for a in self.added:
            special |= pc.fill_null(pc.match_substring(texts, a), False).to_numpy(zero_copy_only=False)
        if not special.any():
            yield from self.table.encode_runs(texts)
            return
        at = 0
        for flat, n in self.table.encode_runs(pc.if_else(pa.array(special), "", texts)):
            parts = np.split(flat, np.cumsum(n)[:-1])
            for i in np.flatnonzero(special[at : at + len(n)]).tolist():
                parts[i] = np.array(self._whole([texts[at + i].as_py()])[0], np.int32)
            at += len(n)
            yield np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker."""
    return Encoder(path, pattern)


def write_ids(docs: DataFrame, out: str, path: str, pattern: str, end_id: int | None = None, shard: int = SHARD) -> None:
    """Encode each row of docs (doc_id, text) and write the ids to files under out.

    A null text is empty. end_id is appended to each row's ids. Null ids come first; rows with equal ids all stay, in the
    order of a hash of their text; no rows leave a folder without shards; other columns are not read. path: the tokenizer's
    file, present on every executor; pattern: how it splits.

    Rows are dealt by ranges of doc_id, so parts follow each other; a task holds one shard and a few texts at a time.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, at = TaskContext.get().partitionId(), encoder(path, pattern), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        doc_ids: list = []
        held = 0
        tail = np.array([end_id] if end_id is not None else [], np.int32)
        for b in batches:
            keys = b.column(0).to_pylist()
            for flat, n in (x for texts in runs(b.column(1)) for x in own.encode_runs(texts)):
                if len(tail):
                    flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
                ids.append(flat)
                counts.append(n)
                doc_ids += keys[: len(n)]
                del keys[: len(n)]
                held += len(flat)
                if held >= shard:
                    yield _packed(part, at, own.base, doc_ids, np.concatenate(counts), np.concatenate(ids))
                    at, held, ids, counts, doc_ids = at + held, 0, [], [], []
        if doc_ids:
            yield _packed(part, at, own.base, doc_ids, np.concatenate(counts), np.concatenate(ids))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    # The more texts a batch has, the more chunks in it are looked up together.
    with settings(spark, {BATCH: "9999"}):
        rows.mapInArrow(tidied(run), SCHEMA).write.option("compression", "zstd").parquet(out)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array<int>) of each document in files under out."""
    return _read(spark, out, "ids array<int>", lambda x: pa.array(x, pa.list_(pa.int32())))


def read_checksums(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of little-endian unsigned 32-bit ids) of each document in files under out."""
    return _read(spark, out, "ids_crc32 long", lambda x: pa.array([zlib.crc32(ids.astype("<i4", copy=False)) for ids in x], pa.int64()))


def _read(spark: SparkSession, out: str, column: str, made) -> DataFrame:
    ship(spark)
    shards = spark.read.schema(SCHEMA).parquet(out)
    # A row for each part, of which there are as many as the writing job had tasks: their count doesn't follow the rows.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = totals.select("part", before.alias("first"))
    rows = shards.join(F.broadcast(firsts), "part").select((F.col("first") + F.col("at")).alias("start"), "base", "doc_ids", "doc_symbols", "rules", "rule_lengths", "wide", "symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                start, base, doc_ids, n, rules, lengths, wide, symbols = (c[r].as_py() for c in b.columns)
                grammar, seq = _shard(rules, lengths, base, wide, symbols)
                n = np.array(n, np.int64)
                ids, width = grammar.expand(seq)
                stops = np.concatenate(([0], np.cumsum(width)))[np.cumsum(n)]
                counts = np.diff(stops, prepend=0)
                for i in range(0, len(doc_ids), 2000):
                    j = min(i + 2000, len(doc_ids))
                    each = [ids[e - k : e] for e, k in zip(stops[i:j].tolist(), counts[i:j].tolist(), strict=True)]
                    starts = start + stops[i:j] - counts[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i:j], pa.int64()), pa.array(starts), pa.array(counts[i:j]), made(each)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    return rows.mapInArrow(tidied(run), f"doc_id long, start long, n_tokens long, {column}")


def expanded_span(base: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, first: int, n: int) -> list[int]:
    """Ids first to first + n of what symbols expand to. Rules outside that span are passed over by their lengths; those within are followed down one by one."""
    width = np.ones(len(symbols), np.int64)
    width[symbols >= base] = lengths[symbols[symbols >= base] - base]
    ends = np.cumsum(width)
    i, j = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, first + n, "left")) + 1
    skip, out = first - (int(ends[i - 1]) if i else 0), []
    waiting = symbols[i:j].tolist()[::-1]
    while waiting and len(out) < n:
        s = waiting.pop()
        size = 1 if s < base else int(lengths[s - base])
        if skip >= size:
            skip -= size
        elif s < base:
            out.append(s)
        else:
            waiting += (int(rules[s - base, 1]), int(rules[s - base, 0]))
    return out


def read_span(spark: SparkSession, out: str, doc_id: int, first: int, n: int) -> list[list[int]]:
    """Ids first to first + n of a document, for each row with that doc_id. Only shards whose range holds the id are read, and only rules that the span needs are expanded."""
    of = F.lit(doc_id).cast("long")
    shards = spark.read.schema(SCHEMA).parquet(out).where((F.col("least") <= of) & (F.col("most") >= of) & F.array_contains("doc_ids", of))
    found = []
    for s in shards.orderBy("part", "at").toLocalIterator():
        rules, lengths = np.frombuffer(s.rules, "<u4").reshape(-1, 2), np.frombuffer(s.rule_lengths, "<u4")
        seq = np.frombuffer(s.symbols, "<u4" if s.wide else "<u2").astype(np.int64)
        stops = np.cumsum(s.doc_symbols)
        for k in [k for k, x in enumerate(s.doc_ids) if x == doc_id]:
            found.append(expanded_span(s.base, rules, lengths, seq[stops[k] - s.doc_symbols[k] : stops[k]], first, n))
    return found
