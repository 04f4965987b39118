"""Token ids in files, compressed by a Re-Pair grammar for random access.

Documents go to tasks by ranges of their id and are encoded there in order of id; a task's ids, an end id
after each document, are cut into shards of ``SHARD_IDS`` ids or more at ends of documents. A shard's ids are compressed by Re-Pair: round
after round the pairs that occur at least ``MIN_PAIRS`` times are replaced by nonterminals, without overlaps from the left,
until no pair does, as long as the symbols fit into 16 bits (32 bits if the ids don't), the most frequent pairs first. A shard stores its rules, each symbol's
expansion length, the symbols, and the running lengths of every ``STRIDE`` symbols, by which any
range of ids is decoded without the rest.

Files are Parquet, a row per shard: the name of a part (a range of ids, in order), the shard's ids before it in its part, and
the blobs. Any store that Spark writes will do, and a lost task is written again as it was.

A text is encoded by its words between ASCII white space: the tokenizer's normalizer and split pattern
don't reach over white space, and its special tokens have none, so the words' ids joined are the text's. Words are encoded by the
tokenizers library once and kept in a bounded cache; words of letters only go to it many at a time and come apart at
tokens with the end-of-word mark.

Cases: null and empty texts have the end id alone; documents without an id come first; equal ids are
ordered by a hash of the text, and copies are stored as often as they occur; an empty table gives an empty one; a very
long text makes a shard of its own length; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut, documents, python_batches, record, schemas

#: A pair that occurs less often isn't replaced: a rule takes 8 bytes, and files are smallest at this bound (4 and 16 make larger ones).
MIN_PAIRS = 8
SHARD_IDS, STRIDE = 1 << 19, 256
COUNTERS = 1 << 18
CACHE = 1_200_000
#: Arrow batches that are encoded at once.
TOGETHER = 4
#: Words whose ids are put out at once, so few that the places fit into a core's cache.
WORDS = 1 << 15
MARKS = frozenset(b".,;:!?|")
#: How the tokenizer splits words of ASCII characters.
SPLITS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+", re.I).findall
END = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """Encodes texts word by word with the tokenizers library, as it would the whole text without special tokens added."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        # The same model for words of letters in lower case, to which normalizer and split pattern would do nothing.
        bare = json.loads(self.tokenizer.to_str())
        bare["normalizer"] = None
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.letters = Tokenizer.from_str(json.dumps(bare))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        added = [re.escape(a.content) for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added or ["(?!)"]).encode(), re.I)
        self.cache: dict[bytes, bytes] = {}

    def _whole(self, word: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, tokenizer, words: list[bytes], sizes: list[int] | int, text: str) -> None:
        """Encodes words with one call, ``sizes`` split tokens each, and puts them into the cache if the ids come apart as they should."""
        ids = np.asarray(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends, upto = np.flatnonzero(self.is_end[ids]) + 1, np.cumsum(np.broadcast_to(sizes, len(words)))
        if words and len(ends) == upto[-1] and ends[-1] == len(ids):
            raw, at = ids.tobytes(), (4 * ends[upto - 1]).tolist()
            self.cache.update(zip(words, [raw[a:b] for a, b in zip([0, *at], at)]))

    def _learn(self, words: list[bytes]) -> None:
        """Puts different words, none with a special token, into the cache."""
        cache, later = self.cache, []
        new = {w for w in words if w[-1] not in MARKS}
        for w in words:
            if w[-1] in MARKS:
                # Punctuation after a letter is a token apart.
                if w[-2:-1].isalpha() or w[-2:-1] > b"\x7f" and w.decode()[-2].isalpha():
                    head = w[:-1]
                    later.append((w, head))
                    if head not in cache:
                        new.add(head)
                else:
                    new.add(w)
        letters, other, sizes, marked, low = [w for w in new if w.isalpha()], [], [], [], []
        for w in new.difference(letters):
            if w.isascii():
                other.append(w)
                sizes.append(len(SPLITS(w)))
            else:
                t = w.decode()
                x = t.lower()
                # Letters that the normalizer only makes lower case, each for itself.
                if x.isalpha() and len(x) == len(t) and "\u03a3" not in t and is_normalized("NFC", t) and is_normalized("NFC", x):
                    marked.append(w)
                    low.append(x)
        self._together(self.letters, letters, 1, b"\n".join(letters).lower().decode())
        self._together(self.letters, marked, 1, "\n".join(low))
        self._together(self.tokenizer, other, sizes, b"\n".join(other).decode())
        alone = [w for w in new if w not in cache] + list({w[-1:] for w, _ in later}.difference(cache))
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)):
            cache[w] = np.asarray(e.ids, "<u4").tobytes()
        for w, head in later:
            cache[w] = cache[head] + cache[w[-1:]]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each begin; ``texts`` are large_string, null as empty.

        Arrow finds the words and numbers them, so Python sees each different word once, not at each of its places.
        """
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        cache[b""] = b""  # stands before, between and after words
        texts = texts.fill_null("")
        # A-Z in lower case have the same ids, but for special tokens.
        low, odd = pc.ascii_lower(texts), pc.match_substring(texts, "<|")
        if pc.any(odd).as_py():
            odd = pa.array([o and self.special.search(t) is not None for o, t in zip(odd.to_pylist(), texts.cast(pa.large_binary()).to_pylist())])
            low = pc.if_else(odd, texts, low)
        split = pc.ascii_split_whitespace(low)
        coded = split.values.dictionary_encode()
        raw, at = coded.dictionary.buffers()[2], np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1).tolist()
        raw = raw.to_pybytes() if raw else b""
        words = [raw[a:b] for a, b in zip(at, at[1:])]
        own = list(map(cache.get, words))
        new = [k for k, ids in enumerate(own) if ids is None]
        plain = [words[k] for k in new]
        if b"<|" in raw:
            for w in plain:
                if b"<|" in w:
                    cache[w] = self._whole(w)
            plain = [w for w in plain if b"<|" not in w]
        if plain:
            self._learn(plain)
        for k in new:
            own[k] = cache[words[k]]
        ids = np.frombuffer(b"".join(own), "<u4")
        size = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        shift, codes = np.cumsum(size) - size, coded.indices.to_numpy()
        upto = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size[codes], out=upto[1:])
        out = np.empty(int(upto[-1]), "<u4")
        for k in range(0, len(codes), WORDS):
            part, begin, end = codes[k : k + WORDS], int(upto[k]), int(upto[min(k + WORDS, len(codes))])
            out[begin:end] = ids[np.repeat(shift[part] - upto[k : k + len(part)], size[part]) + np.arange(begin, end)]
        return out, upto[split.offsets.to_numpy()]

    def encode_many(self, raws: list[str | bytes]) -> list[bytes]:
        """The ids of each text, or of its UTF-8 bytes, as little-endian unsigned 32-bit integers."""
        ids, upto = self.encode_column(pa.array([t if isinstance(t, bytes) else t.encode() for t in raws], pa.large_binary()).view(pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(upto, upto[1:])]


@lru_cache(maxsize=2)
def coder(path: str | None = None) -> WordCoder:
    return WordCoder(path)


def _by_pair(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted pairs), equal ones by place. Pairs of 32 bits are sorted as one number with their place, which is faster than to sort places."""
    if pair.dtype == np.uint32:
        both = np.sort(pair.astype(np.uint64) << np.uint64(32) | np.arange(len(pair), dtype=np.uint64))
        return (both & np.uint64(0xFFFFFFFF)).astype(np.int64), both >> np.uint64(32)
    order = np.argsort(pair, kind="stable")
    return order, pair[order]


def compress(ids: np.ndarray, least: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, base): symbols below ``base`` are ids, ``base + i`` stands for the pair ``rules[i]``.

    A round leaves no place of a pair that it replaces, and no other pair of old symbols gets more frequent, so the next one only
    looks at pairs with a symbol of the round before.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    room = (1 << 16 if base <= 1 << 16 else 1 << 32) - base
    # Pairs of 16-bit symbols are worked on as 32-bit numbers.
    half, kind, spread = (16, np.uint32, 0x9E3779B1) if base + room <= 1 << 16 else (32, np.uint64, 0x9E3779B97F4A7C15)
    s = ids.astype(kind)
    rules, made = [], 0
    look = np.arange(max(0, len(s) - 1))
    while len(look) and made < room:
        pair = s[look] << kind(half) | s[look + 1]
        if len(look) > COUNTERS // 4:
            slot = pair * kind(spread) >> kind(2 * half - 18)
            often = np.bincount(slot, minlength=COUNTERS) >= least
            some = np.flatnonzero(often[slot])  # holds each pair that is frequent; others may share its counter
            look, pair = look[some], pair[some]
        order, pair = _by_pair(pair)
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        count = np.diff(np.r_[first, len(pair)])
        chosen = np.flatnonzero(count >= least)
        if not len(chosen):
            break
        if len(chosen) > room - made:
            chosen = np.sort(chosen[np.argsort(-count[chosen], kind="stable")[: room - made]])
        symbol = np.zeros(len(first), kind)
        symbol[chosen] = np.arange(base + made, base + made + len(chosen), dtype=kind)
        # By place again; 0 is no new symbol.
        mark = np.zeros(len(s), kind)
        mark[look[order]] = np.repeat(symbol, count)
        at = np.flatnonzero(mark)
        # Of pairs that overlap in a run, every other one from the left.
        head = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
        at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))) & 1 == 0]
        known = pair[first[chosen]].astype(kind)
        rules.append(np.stack([known >> kind(half), known & kind((1 << half) - 1)], axis=1))
        made += len(chosen)
        s[at] = mark[at]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        # Where the new symbols are now, and the places before them.
        look = np.repeat(at - np.arange(len(at)), 2)
        look[::2] -= 1
        look = look[np.r_[True, look[1:] != look[:-1]] & (look >= 0) & (look < len(s) - 1)]
    return s, np.concatenate(rules) if rules else np.zeros((0, 2), kind), base


def rounds(rules: np.ndarray, base: int):
    """(begin, end) of rules that only need ids and rules before ``begin``, as those of one round do."""
    top, begin = rules.max(axis=1, initial=0), 0
    while begin < len(rules):
        later = np.flatnonzero(top[begin:] >= base + begin)
        end = begin + int(later[0]) if len(later) else len(rules)
        yield begin, end
        begin = end


def pack(ids: np.ndarray) -> dict:
    """The blobs of a shard."""
    s, rules, base = compress(ids)
    rules = rules.astype(np.int64)
    lengths = np.ones(base + len(rules), np.int64)
    for begin, end in rounds(rules, base):
        lengths[base + begin : base + end] = lengths[rules[begin:end]].sum(axis=1)
    kind = "<u2" if base + len(rules) <= 1 << 16 else "<u4"
    upto = np.r_[0, np.cumsum(lengths[s.astype(np.int64)])]
    return {"n_ids": len(ids), "base": base, "symbols": s.astype(kind).tobytes(), "rules": rules.astype(kind).tobytes(), "lengths": lengths[base:].astype("<u4").tobytes(), "upto": upto[::STRIDE].astype("<u8").tobytes()}


class Shard:
    """Decodes a shard's ids, or a range of them."""

    def __init__(self, row: dict):
        self.n, self.base = row["n_ids"], row["base"]
        lengths = np.frombuffer(row["lengths"], "<u4")
        kind = "<u2" if self.base + len(lengths) <= 1 << 16 else "<u4"
        self.symbols, self.rules = np.frombuffer(row["symbols"], kind), np.frombuffer(row["rules"], kind).reshape(-1, 2)
        self.lengths = np.r_[np.ones(self.base, np.int64), lengths.astype(np.int64)]
        self.upto = np.frombuffer(row["upto"], "<u8")

        # What each symbol stands for, one after the other; a round's symbols are made of those of the rounds before.
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = np.arange(int(self.lengths.sum()), dtype=np.uint32)
        for a, b in rounds(self.rules, self.base):
            made = self.expand(self.rules[a:b].ravel())
            at = int(self.first[self.base + a])
            self.flat[at : at + len(made)] = made

    def expand(self, s: np.ndarray) -> np.ndarray:
        size = self.lengths[s]
        end = np.cumsum(size)
        # Places in the flat table of what symbols stand for.
        return self.flat[np.repeat(self.first[s] - (end - size), size) + np.arange(int(size.sum()))]

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n if end is None else min(end, self.n)
        if begin >= end:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.upto, begin, "right")) - 1
        last = int(np.searchsorted(self.upto, end, "left"))
        before = int(self.upto[first])
        return self.expand(self.symbols[first * STRIDE : last * STRIDE])[begin - before : end - before]


FILES = "part int, before bigint, n_ids bigint, doc_ids array<{id}>, doc_lengths array<int>, base int, symbols binary, rules binary, lengths binary, upto binary"


def token_files(df: DataFrame, path: str | None = None, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, end: int = END, parts: int | None = None) -> DataFrame:
    """Writes the ids of ``df`` as shard files to ``path`` (None: the shared folder) and gives the table of the files."""
    spark = df.sparkSession
    python_batches(spark)
    id_kind = df.schema[id_col].dataType.simpleString()
    kind, arrow = schemas(FILES.format(id=id_kind))
    mark = np.array([end], "<u4")

    def run(batches):
        gc.disable()  # the cache has no cycles, and going through it again and again takes long
        own, part = coder(tokenizer), TaskContext.get().partitionId()
        before, ids, names, sizes, held = 0, [], [], [], 0

        def shard():
            nonlocal before, held
            blobs = pack(np.concatenate(ids))
            row = {"part": part, "before": before, "doc_ids": list(names), "doc_lengths": list(sizes), **blobs}
            before += held
            held = 0
            for x in (ids, names, sizes):
                x.clear()
            return record(arrow, [[row[c]] for c in arrow.names])

        while group := list(islice(batches, TOGETHER)):
            batch = pa.Table.from_batches(group)
            flat, upto = own.encode_column(pa.concat_arrays(batch.column(1).cast(pa.large_binary()).chunks).view(pa.large_string()))
            upto = upto.tolist()
            for name, a, b in zip(batch.column(0).to_pylist(), upto, upto[1:]):
                ids += (flat[a:b], mark)
                names.append(name)
                sizes.append(b - a + 1)
                held += sizes[-1]
                if held >= SHARD_IDS:
                    yield shard()
        if names:
            yield shard()

    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("text"))
    out = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(run, kind)
    if path is None:
        return cut(out, "tokens")
    out.write.parquet(path)
    return spark.read.schema(kind).parquet(path)


def read_documents(files: DataFrame, fields: str, make, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, start (ids of all documents before) and ``fields`` of each document in shard files; ``make()`` gives a function from its ids to a tuple.

    The driver gets one row per part.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    totals.sort(key=lambda r: r["part"])
    starts = dict(zip((r["part"] for r in totals), np.r_[0, np.cumsum([r["n"] for r in totals], dtype=np.int64)].tolist()))
    id_kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    kind, arrow = schemas(f"`{id_col}` {id_kind}, start bigint, {fields}")

    def run(batches):
        f = make()
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, rows = Shard(row).ids(), starts[row["part"]] + row["before"], []
                upto = np.r_[0, np.cumsum(row["doc_lengths"])].tolist()
                for name, a, b in zip(row["doc_ids"], upto, upto[1:]):
                    rows.append((name, at + a, *f(ids[a:b])))
                if rows:
                    yield record(arrow, list(zip(*rows)))

    return files.mapInArrow(run, kind)


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, start and ids of each document."""
    return read_documents(files, "ids array<bigint>", _ids, id_col)


def _ids():
    return lambda ids: (ids.tolist(),)


def _digests():
    return lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes()))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(token_files(documents(spark, sf_dir)), "n_tokens bigint, ids_crc32 bigint", _digests)


QUERIES = {"op5_token_files": op5_token_files}
