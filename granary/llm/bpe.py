"""BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType

from granary.llm.common import free_name, windows

#: Code points that the newer tables of `regex` call letters or numerals and those of the tokenizers library
#: do not, and capitals that Python's tables do not know yet with the distance to their small letters.
UNKNOWN_YET = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7cf\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7"
    "\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ebb-\\U00016ed3"
    "\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128"
    "\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
NEW_CAPITALS = {
    **{c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}, 0xA7CB: 0x264, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
NEVER = np.iinfo(np.int32).max
#: Bytes that a kept chunk takes besides its letters and ids.
ENTRY = 200
#: A vocabulary file beyond this size is refused, as it is sent to every executor.
MAX_FILE_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def plain(text: str) -> bool:
    """Whether all code points lie below 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class BpeCodec:
    """Codec of a tokenizer file with BPE, lower-cased NFC text and an end-of-word suffix.

    Texts of a batch are cut into chunks at white space; chunks not met before are cut into words, and the words not
    met before are encoded together: their symbols lie in one flat array, and each round merges the lowest-ranked
    pair of every word that has one, found by binary search over the sorted keys of pairs. What has been met is
    kept up to about `most` bytes, then forgotten, which bounds memory.
    """

    def __init__(self, file_text: str, most: int = 48 << 20):
        spec = json.loads(file_text)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"]:
            raise ValueError("the file is not BPE with an end-of-word suffix and no decoder")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.made = made
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, NEVER).astype(np.int32)
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        # of alternatives, so that the common pattern stays as fast as it is
        self.odd = regex.compile(f"[{UNKNOWN_YET}]")
        self.odd_words = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{UNKNOWN_YET}]]+|[\p{{N}}--[{UNKNOWN_YET}]]|[[^\s\p{{L}}\p{{N}}]||[{UNKNOWN_YET}]]+")
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.most, self.known, self.held = most, {}, 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], NEVER)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the place where each word begins, with the end of the last."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        owner = np.arange(len(words))
        rank = np.full(len(symbols), NEVER, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = NEVER
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(owner):
            low = np.minimum.reduceat(rank, np.cumsum(size) - size)
            if (over := low == NEVER).any():
                cells = np.repeat(over, size)
                done.append((owner[over], size[over], symbols[cells]))
                symbols, rank, owner, size, low = symbols[~cells], rank[~cells], owner[~over], size[~over], low[~over]
                if not len(owner):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            beside = np.diff(at, prepend=-2) == 1
            if beside.any():  # of overlapping pairs as in a a a, every other one from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(beside, 0, place))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            starts = np.cumsum(size) - size
            size = np.add.reduceat(stays.astype(np.int64), starts)
            ends = np.cumsum(size) - 1
            at = np.cumsum(stays)[at] - 1
            symbols, rank = symbols[stays], rank[stays]
            touched = np.concatenate([at, at[at > 0] - 1])
            last = np.zeros(len(symbols), bool)
            last[ends] = True
            rank[touched] = NEVER
            touched = touched[~last[touched]]
            rank[touched] = self.ranks(symbols[touched], symbols[touched + 1])
        owner, size, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        order = np.argsort(owner, kind="stable")
        begins = np.cumsum(size) - size
        size, begins = size[order], begins[order]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return symbols[np.arange(bounds[-1]) + np.repeat(begins - bounds[:-1], size)].astype("<u4"), bounds

    def _learn(self, chunks: list[str]) -> None:
        parts = [(self.words if plain(c) or not self.odd.search(c) else self.odd_words).findall(c) for c in chunks]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
        ids, bounds = self.encode_words(list(words)) if words else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        raw, b = ids.tobytes(), (bounds * 4).tolist()
        for c, p in zip(chunks, parts, strict=True):
            self.known[c] = x = b"".join([raw[b[i] : b[i + 1]] for i in map(words.__getitem__, p)])
            self.held += ENTRY + len(c) + len(x)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Normalised text without its white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one: no final sigma
        text = text.lower()
        if not plain(text):
            text = text.translate(NEW_CAPITALS)
        if re.search("[\x1c-\x1f]", text):
            return [c for c in re.split("[\t-\r \x85\xa0  -     　]+", text) if c]
        return text.split()

    def _segments(self, text: str) -> list[list[str] | int]:
        if self.split_special is None or not self.split_special.search(text):
            return [self.chunks(text)]
        return [self.special[s] if s in self.special else self.chunks(s) for s in self.split_special.split(text)]

    def encode(self, texts: list[str], together: int = 1 << 20) -> list[np.ndarray]:
        """The ids of each text; about `together` characters are worked on at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str] | int]] = []
        size = 0
        for k, text in enumerate(texts):
            for piece in windows(text):
                held += [(k, s) for s in self._segments(piece)]
                size += len(piece)
                if size >= together:
                    self._encode_segments(held, out)
                    held, size = [], 0
        self._encode_segments(held, out)
        return [np.frombuffer(b"".join(x), "<u4") for x in out]

    def _encode_segments(self, held: list[tuple[int, list[str] | int]], out: list[list[bytes]]) -> None:
        met = set().union(*(s for _, s in held if not isinstance(s, int)))
        new = [c for c in met if c not in self.known]
        if self.held > self.most:
            self.known, self.held, new = {}, 0, list(met)
        if new:
            self._learn(new)
        for k, s in held:
            out[k].append(np.array([s], "<u4").tobytes() if isinstance(s, int) else b"".join(map(self.known.__getitem__, s)))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The tokens of each row of ids, with spaces between."""
        return [" ".join(map(self.tokens.__getitem__, x.tolist())) for x in ids]


@lru_cache(maxsize=2)
def _codec(file_text: str) -> BpeCodec:
    return BpeCodec(file_text)


def load(path: str) -> str:
    if Path(path).stat().st_size > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return Path(path).read_text(encoding="utf-8")


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def small(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `most` bytes in a column, or of one row that is longer."""
    for b in batches:
        size = pa.compute.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(at, at[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, packed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs with ids, the tokens of the whole text, and with decoded_col the text that they give back, made in one pass.

    ids are array<int>, or with packed binary: little-endian unsigned 32-bit integers. Columns of these names are
    replaced; all others, of whatever names, stay, or with keep only those that it names. Null and empty texts have no ids and decode to an empty text.
    Special tokens' strings in a text become their ids. Nothing is shuffled and each row stands alone, so repeated
    rows give equal results and an empty table an empty one; a very long text is encoded piece by piece. The file at
    path is read by the driver and sent to the executors; its size is checked.
    """
    file = docs.sparkSession.sparkContext.broadcast(load(path))
    added = [ids_col, *([decoded_col] if decoded_col else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [x.lower() for x in added]]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add(ids_col, BinaryType() if packed else ArrayType(IntegerType()))
    schema = schema.add(decoded_col, StringType()) if decoded_col else schema
    plain = text_col in kept and docs.schema[text_col].dataType == StringType()
    text = text_col if plain else free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value)
        for b in small(batches, text):
            ids = codec.encode(texts_of(b.column(text)))
            if packed:
                columns = [pa.array([x.tobytes() for x in ids], pa.binary())]
            else:
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))]
            if decoded_col:
                columns.append(pa.array(codec.decode(ids), pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], names=[*kept, *added])

    return docs.select(*[f"`{c}`" for c in kept], *([] if plain else [F.col(text_col).cast("string").alias(text)])).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encoded with decoded, the tokens of ids (array<int>) with spaces between; null ids count as empty."""
    file = encoded.sparkSession.sparkContext.broadcast(load(path))
    kept = [c for c in encoded.columns if c.lower() != decoded_col.lower()]
    schema = encoded.select(*[f"`{c}`" for c in kept]).schema.add(decoded_col, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value)
        for b in batches:
            ids = [np.array(x or [], np.int64) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(codec.decode(ids), pa.string())], names=[*kept, decoded_col])

    return encoded.mapInArrow(run, schema)
