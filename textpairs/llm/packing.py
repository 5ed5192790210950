"""Packing of token pieces into sequences: best fit, then a swap-based local search.

Documents become pieces of at most ``capacity`` tokens.  Full pieces are sequences of their own.  The
rest is dealt by hash into blocks of about ``BLOCK_PIECES`` pieces (each leaves less than about one
sequence underfull), and every block is packed in one task: best fit by falling length, then the local search
over underfull bins.  The search takes the emptiest bin and moves its documents out, exchanges one
for one, two for one or one for two with another bin, always so that the sum of squared fills rises,
until bins are empty and the lower bound is met or the emptiest bins stay.

Defined cases: a null or empty text is the end token alone; rows that share an id are packed each for itself;
a null id stays null; an empty table gives no rows; clashing columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpairs.session import materialize

CAPACITY = 4096
END_ID = 1
BLOCK_PIECES = 16_384
PATIENCE = 32
SWEEPS = 6
CACHED_WORDS = 300_000
CACHED_WORD_BYTES = 48
GROUP_BYTES = 1 << 20
#: fixed value: the pattern of tokenizers that take letters, digits and other signs apart, contractions aside
_LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers by bin: each item, longest first, into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin with r tokens of room is known
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            r = n + ((fits & -fits).bit_length() - 1)
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), capacity - n
            bins.append([i])
        by_room[r].append(b)
        rooms |= 1 << r
    return bins


class _Underfull:
    """The underfull bins of a block as flat arrays, rebuilt as bins change."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [sorted(b, key=lambda i: -lengths[i]) for b in bins]
        self.fill = np.array([int(lengths[b].sum()) for b in self.bins], np.int64)
        self.where = np.concatenate([np.full(len(b), j) for j, b in enumerate(self.bins)]) if bins else np.zeros(0, np.int64)
        self.item = np.array([i for b in self.bins for i in b], np.int64)
        self.length = lengths[self.item] if len(self.item) else np.zeros(0, np.int64)
        self.slot = {int(i): k for k, i in enumerate(self.item)}

    def shift(self, items: list[int], to: int) -> None:
        for i in items:
            k = self.slot[i]
            a = int(self.where[k])
            self.bins[a].remove(i)
            self.bins[to].append(i)
            self.where[k] = to
            self.fill[a] -= self.lengths[i]
            self.fill[to] += self.lengths[i]
        self.bins[to].sort(key=lambda i: -self.lengths[i])

    def step(self, s: int) -> bool:
        """One improving step that takes tokens out of bin ``s``."""
        room = self.capacity - self.fill
        target = (self.fill > 0) & (self.fill >= self.fill[s])
        target[s] = False
        mine = list(self.bins[s])
        for i in mine:  # move: the tightest bin with room
            n = int(self.lengths[i])
            ok = np.flatnonzero(target & (room >= n))
            if len(ok):
                self.shift([i], int(ok[np.argmin(room[ok])]))
                return True
        there, allowed = room[self.where], target[self.where]

        def exchange(give: list[int]) -> bool:
            gain = int(self.lengths[give].sum()) - self.length
            gain = np.where(allowed & (gain > 0) & (gain <= there), gain, 0)
            k = int(np.argmax(gain))
            if gain[k] <= 0:
                return False
            to, back = int(self.where[k]), int(self.item[k])
            self.shift([back], s)
            self.shift(give, to)
            return True

        for i in mine:  # one for one
            if exchange([i]):
                return True
        for a, b in zip(mine, mine[1:]):  # two for one
            if exchange([a, b]):
                return True
        order = np.lexsort((-self.length, self.where))
        pair = np.flatnonzero(self.where[order][1:] == self.where[order][:-1])
        x, y = order[pair], order[pair + 1]
        for i in mine:  # one for two of neighbouring size
            gain = int(self.lengths[i]) - self.length[x] - self.length[y]
            gain = np.where(allowed[x] & (gain > 0) & (gain <= there[x]), gain, 0)
            if len(gain) and gain[k := int(np.argmax(gain))] > 0:
                to = int(self.where[x[k]])
                back = [int(self.item[x[k]]), int(self.item[y[k]])]
                self.shift(back, s)
                self.shift([i], to)
                return True
        return False


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Fewer or equal bins with the same items; every step raises the sum of squared fills.

    The emptiest bins give first.  A sweep ends when ``PATIENCE`` bins in a row could not be emptied; the search
    ends at the lower bound, after a sweep without a step, or after ``SWEEPS`` sweeps.
    """
    full = [b for b in bins if int(lengths[b].sum()) == capacity]
    rest = [b for b in bins if int(lengths[b].sum()) < capacity]
    least = -(-sum(int(lengths[b].sum()) for b in rest) // capacity)
    u = _Underfull(rest, lengths, capacity)
    used = len(rest)
    for _ in range(SWEEPS):
        moved, failed = False, 0
        for s in np.argsort(u.fill, kind="stable").tolist():
            if used <= least or failed == PATIENCE:
                break
            if not u.bins[s]:
                continue
            while u.bins[s] and u.step(s):
                moved = True
            if u.bins[s]:
                failed += 1
            else:
                used, failed = used - 1, 0
        if not moved or used <= least:
            break
    return full + [b for b in u.bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def pack(pieces: DataFrame, order_cols: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table) with ``sequence_id`` and ``offset``; ``order_cols`` make the packing repeatable."""
    pieces = pieces.drop("sequence_id", "offset")
    full = pieces.filter(F.col(length_col) >= capacity)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col(length_col) < capacity)
    blocks = max(1, -(-rest.count() // BLOCK_PIECES))
    rest = rest.withColumn("__block", F.pmod(F.xxhash64(*order_cols), F.lit(blocks)))

    def one(key, table):
        table = table.sort_by([(c, "ascending") for c in order_cols])
        lengths = table[length_col].to_numpy().astype(np.int64)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, b in enumerate(pack_lengths(lengths, capacity)):
            seq[b] = number
            off[b] = np.cumsum(lengths[b]) - lengths[b]
        seq += key[0].as_py() << 32
        return table.drop_columns(["__block"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    packed = rest.groupBy("__block").applyInArrow(one, full.schema)
    return full.unionByName(packed)


class WordIds:
    """Ids of words, remembered in two generations of at most about ``CACHED_WORDS`` words each.

    When the young one is full it becomes the old one; words met again move back into the young one.  At about 200 bytes a
    word both hold at most some 120 MB, and a task has its own.
    """

    def __init__(self, tokenizer, ends: np.ndarray | None = None):
        """``ends``: by id, whether it ends a word, where the tokenizer marks that and takes a run of letters as one word."""
        self.tokenizer, self.ends, self.young, self.old = tokenizer, ends, {}, {}

    def _learn(self, words: list[bytes]):
        """(word, its ids) of each word; words of letters are encoded in one text and cut behind the ids that end a word."""
        texts = [w.decode() for w in words]
        whole = [self.ends is not None and x.lower().isalpha() for x in texts]
        letters = [x for x, y in zip(texts, whole) if y]
        if letters:
            (e,) = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(letters):
                data = ids.tobytes()
                for w, a, b in zip((w for w, y in zip(words, whole) if y), [0, *cuts], cuts):
                    yield w, data[a:b]
            else:  # what is a letter here is none to the tokenizer: each word for itself
                whole = [False] * len(words)
        alone = [i for i, y in enumerate(whole) if not y]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False)):
            ids = e.ids
            yield words[i], pack_ids(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        young, old, learn = self.young, self.old, []
        for w in set().union(*texts).difference(young):
            if w in old:
                young[w] = old[w]
            else:
                learn.append(w)
        young.update(self._learn(learn))
        out = [b"".join(map(young.__getitem__, t)) for t in texts]
        for w in learn:
            if len(w) > CACHED_WORD_BYTES:
                del young[w]
        if len(young) > CACHED_WORDS:
            self.young, self.old = {}, young
        return out


def _splitter(tokenizer_json: str):
    """``split(text) -> words`` that the tokenizer treats each for itself.

    Blanks always part words.  A tokenizer that lower-cases and takes runs of letters and runs of other signs apart gives the
    same ids for ``Word,`` as for ``word`` and ``,``: such words are lower-cased (A-Z) and parted there, so that fewer
    different words have to be encoded.  No sign of an added token is among them.
    """
    if _parts_letters(json.loads(tokenizer_json)):
        sign = re.compile(rb"(?<=[a-z])[.,;:!?#$%&*]")
        return lambda raw: sign.sub(rb" \g<0>", raw.lower()).split()
    return bytes.split


def _parts_letters(rules: dict) -> bool:
    steps = lambda x, key: [y["type"] for y in x.get(key, [x])] if x else []
    first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    return "Lowercase" in steps(rules.get("normalizer") or {}, "normalizers") and first == _LETTERS_APART


def _word_ends(tokenizer_json: str) -> np.ndarray | None:
    """By id, whether it ends a word; None for a tokenizer that does not mark the ends or does not take letters apart.

    A run of letters is one word to such a tokenizer, and only the last of its ids has the mark.
    """
    rules = json.loads(tokenizer_json)
    mark = rules["model"].get("end_of_word_suffix")
    if not mark or rules["model"].get("ignore_merges") or not _parts_letters(rules):
        return None
    vocab = rules["model"]["vocab"]
    ends = np.zeros(1 + max([*vocab.values(), *(t["id"] for t in rules["added_tokens"])]), bool)
    ends[[i for w, i in vocab.items() if w.endswith(mark)]] = True
    single = sum(len(w) == len(mark) + 1 for w in vocab if w.endswith(mark))
    return ends if single >= 256 else None  # every byte can end a word


def token_pieces(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): each text's tokens and the end id, cut at ``capacity``.

    Words between blanks are encoded each for itself and remembered: the tokenizer drops blanks and never joins over them.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = END_ID.to_bytes(4, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, split = WordIds(Tokenizer.from_str(held.value), _word_ends(held.value)), _splitter(held.value)  # the memory ends with the task
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            kept, group, size = [], [], 0

            def flush(group):
                for (doc, _), data in zip(group, words.encode([w for _, w in group])):
                    data += end
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        ids = data[at : at + 4 * capacity]
                        for c, x in zip(out, (doc, p, at // 4, len(ids) // 4, zlib.crc32(ids))):
                            out[c].append(x)
                        if keep_ids:
                            kept.append(np.frombuffer(ids, "<u4").astype(np.int32))

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                raw = text.as_py() or b""
                group.append((doc, split(raw)))
                size += len(raw)
                if size >= GROUP_BYTES:
                    flush(group)
                    group, size = [], 0
            flush(group)
            types_ = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), types_)]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*out, *(["ids"] if keep_ids else [])])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def pack_documents(docs: DataFrame, tokenizer_json: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all texts with their place in a sequence."""
    pieces = materialize(token_pieces(docs, tokenizer_json or default_tokenizer(), id_col, text_col, capacity, keep_ids), "op1-pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], "length", capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
