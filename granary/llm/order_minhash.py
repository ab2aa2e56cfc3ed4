"""Near-duplicate classes by Order MinHash, with candidates verified by banded alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.components import connected
from granary.llm.common import free_name, join_groups, likely_in, settled

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The similarity that makes a near copy, as a fraction, so that counts decide exactly.
NUMERATOR, DENOMINATOR = 4, 5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Occurrence-labelled k-mers of words as 64-bit numbers; remembers the numbers of up to `most` words."""

    def __init__(self, k: int = 5, most: int = 200_000):
        self.k, self.most, self.known = k, most, {}
        self.factor = _mixed(np.arange(1, k + 1, dtype=np.uint64) * MIX) | np.uint64(1)

    def words(self, text: str) -> list[str]:
        return WORD.findall(text.lower())

    def labelled(self, words: list[str]) -> np.ndarray:
        """One number for each k-mer in text order, equal for equal k-mers that are the same occurrence in their
        texts; fewer than k words make one k-mer of all, none make none."""
        if not words:
            return np.zeros(0, np.uint64)
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, set(words)
        for w in new:
            self.known[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        x = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(x) - self.k + 1)
        value = np.full(n, len(x) if len(x) < self.k else self.k, np.uint64)
        for j in range(min(self.k, len(x))):
            value += _mixed(x[j : j + n] ^ self.factor[j])
        value = _mixed(value)
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        fresh = np.ones(n, bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        if fresh.all():
            return value
        at = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
        return _mixed(value + nth * MIX)


def sketches(labelled: np.ndarray, bands: int, mins: int) -> np.ndarray:
    """Order MinHash: for each band, the `mins` least k-mers under its own hash, in text order, as one number."""
    n = len(labelled)
    seed = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * MIX)
    if n <= mins:
        chosen = np.tile(labelled, (bands, 1))
    else:
        hashed = (labelled[None, :] ^ seed[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93)
        chosen = labelled[np.sort(np.argpartition(hashed, mins - 1, axis=1)[:, :mins], axis=1)]
    key = seed
    for j in range(chosen.shape[1]):
        key = _mixed(key * np.uint64(31) + chosen[:, j])
    return key.view(np.int64)


def bucket_keys(labelled: np.ndarray, bands: int, mins: int, few: int = 3, short: int = 60) -> np.ndarray:
    """Keys of a text's buckets: sketches of `few` minima below `short` k-mers, of `mins` from there on.

    Minima are drawn without replacement, so many of them often hold one of the few k-mers in which short texts
    differ. A near copy of a text of n k-mers has 4/5 n or more, so texts from 4/5 of `short` on have both kinds: two
    near copies always have one kind in common.
    """
    n, few = len(labelled), min(few, mins)
    kinds = [few] * (n < short or few == mins) + [mins] * (few < mins and DENOMINATOR * n >= NUMERATOR * short)
    return np.concatenate([sketches(labelled, bands, m) for m in kinds])


def aligned(a: np.ndarray, b: np.ndarray, need: int = 0, band: int | None = None) -> int:
    """Length of the best alignment of two rows of labelled k-mers, each of which occurs once in a row.

    Equal k-mers in rising places of both rows count; matches whose places differ by more than band are left out, as
    they need more insertions and deletions than that. Stops early, with 0, when fewer than need can be reached.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if band is not None:
        near = np.abs(i - j) <= band
        i, j = i[near], j[near]
    if len(i) < need:
        return 0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def alignment(a: np.ndarray, b: np.ndarray) -> int:
    """aligned(a, b) if it makes a near copy, else 0.

    With m aligned k-mers of n in both rows together, the similarity is m / (n - m); at the threshold of 4/5 a pair
    needs m >= 4 n / 9, hence at most n / 9 insertions and deletions, which is the band.
    """
    n = len(a) + len(b)
    need = -(-NUMERATOR * n // (NUMERATOR + DENOMINATOR))
    if not n or min(len(a), len(b)) < need:
        return 0
    m = aligned(a, b, need, n - 2 * need)
    return m if m >= need else 0


def links_among(comps: np.ndarray, rows: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places (i, j) of near copies that join all components among rows that near copies can join.

    Compared are pairs of different components of which one at least has side 0; pairs that earlier links have
    joined are passed over. Shared k-mers are counted by a product of 0/1 matrices before anything is aligned.
    """
    parent = {c: c for c in comps.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    sizes = np.array([len(r) for r in rows])
    values, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(rows)), sizes)
    several = count[column] > 1
    owner, column = owner[several], shared[column[several]]
    common = np.zeros((len(rows), len(rows)), np.float32)
    width = int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 1024):
        lo, hi = np.searchsorted(column, [at, at + 1024])
        held = np.zeros((len(rows), min(1024, width - at)), np.float32)
        held[owner[lo:hi], column[lo:hi] - at] = 1
        common += held @ held.T
    out = []
    for lo in range(0, len(rows), 256):
        at = slice(lo, lo + 256)
        both = sizes[at, None] + sizes[None, :]
        fit = ((NUMERATOR + DENOMINATOR) * common[at] >= NUMERATOR * both) & (comps[at, None] != comps[None, :]) & ((side[at, None] == 0) | (side[None, :] == 0))
        for i, j in np.argwhere(np.triu(fit, lo + 1)).tolist():
            i += lo
            a, b = root(int(comps[i])), root(int(comps[j]))
            if a != b and alignment(rows[i], rows[j]):
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, bands: int = 34, mins: int = 6, block_kmers: int = 1_000_000, block_rows: int = 1500) -> DataFrame:
    """For every row of docs: _place, _class, id_col, class_id, class_size. Near copies share a class.

    Words are runs of letters, digits and _ in lower case. Texts of equal words are copies; texts without words are
    copies where they are equal; null counts as empty. Different texts are near copies when, of their k-mers of
    words, each labelled by its occurrence in its text, the aligned ones (equal and in the same order in both)
    make up 4/5 or more of all. Fewer than k words make one k-mer. Classes are the components of these links;
    _class is the place of one of their rows, and tells classes apart however ids repeat or lack; class_id is the
    least id in them (null if all are null), class_size their rows. Repeated rows are copies. An empty table gives an
    empty result. Of a very long text all words count; its k-mers, 8 bytes each, are what a task holds of it.

    Candidates: in each of `bands` bands, the `mins` least k-mers under its hash, in text order, are the key of a
    bucket; the 3 least in texts of under 60 k-mers, and both kinds from 48 to 59. A pair of m aligned k-mers and n in
    both rows together misses all buckets with probability (1 - C(m, mins) / C(n - m, mins))^bands: at most 2.9e-8
    where both texts have under 60, else at most 7.1e-5 (48 and 60 k-mers), which falls to 3.3e-5 as texts grow. No
    bucket is capped.

    1. Copies shrink to one row by the digest of their words.
    2. Every text of a bucket is aligned with the bucket's least one, unless their lengths alone keep them apart; links
       give components. However many near copies a bucket holds, that is one comparison each.
    3. Buckets left with several components are compared pair by pair across components, in blocks of about
       block_kmers k-mers and block_rows rows: those outside the bucket's largest component against all. Of buckets
       with the same texts one is compared.
    4. Components of all links.

    Only texts that share a bucket with another one of fit length are read again, and only their k-mers are moved. Keys
    that hold more than a thousandth of the rows (a large group of copies, a common passage) are joined without
    a shuffle. docs must yield the same rows in the same order when read again.
    """
    place = F.monotonically_increasing_id()
    rows = docs.select(place.alias("place"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for b in batches:
            out = []
            for text in b["text"]:
                words = shingler.words(text)
                x = shingler.labelled(words)
                digest = blake2b((" ".join(words) if words else "\0" + text).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                out.append((digest, len(x), bucket_keys(x, bands, mins) if words else np.zeros(0, np.int64)))
            yield pd.DataFrame({"place": b["place"], "id": b["id"], "digest": [o[0] for o in out], "n": [o[1] for o in out], "keys": [o[2] for o in out]})

    marked, n_rows = settled(rows.mapInPandas(sketch, "place long, id string, digest binary, n int, keys array<long>").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)))
    first = marked.groupBy("digest").agg(F.min("place").alias("place"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    texts, n_texts = settled(first.join(marked.select("place", "n", "keys"), "place"), at_most=n_rows)

    entries = texts.select("place", "n", F.explode("keys").alias("bucket"))
    heads, n_heads = settled(entries.groupBy("bucket").agg(F.min("place").alias("head"), F.min_by("n", "place").alias("head_n"), F.count(F.lit(1)).alias("size")).filter("size > 1"), 100_000)
    shared = likely_in(entries, heads, n_heads, "bucket")
    filled, n_filled = settled(join_groups(shared, heads, "bucket", F.col("size"), n_texts * bands), 100_000)

    fit = lambda n, m: F.least(n, m) * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR
    star = filled.filter((F.col("place") != F.col("head")) & fit(F.col("n"), F.col("head_n")))
    star, n_star = settled(star.select(F.col("place").alias("a"), F.col("head").alias("b")).distinct(), 100_000, n_filled)

    def kmers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for b in batches:
            yield pd.DataFrame({"place": b["place"], "kmers": [shingler.labelled(shingler.words(t)).tobytes() for t in b["text"]]})

    involved, n_involved = settled(filled.select("place").distinct(), 100_000, n_filled)
    found = likely_in(rows.select("place", "text"), involved, n_involved, "place").join(involved, "place")
    content, _ = settled(found.mapInPandas(kmers, "place long, kmers binary"), 2000)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = [alignment(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) > 0 for x, y in zip(b["kmers_a"], b["kmers_b"], strict=True)]
            yield b.loc[same, ["a", "b"]]

    # a head with many texts stands once for each thousand of them, and each copy takes its own share
    crowds, _ = settled(star.groupBy("b").agg(F.count(F.lit(1)).alias("texts")), 100_000, n_star)
    share = F.pmod(F.xxhash64("a"), F.ceil(F.col("texts") / 1000)).alias("share")
    asked = join_groups(star, crowds, "b", F.col("texts"), n_star).select("a", "b", share)
    ours = crowds.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("texts") / 1000) - 1)).alias("share"))
    of = lambda name: content.select(F.col("place").alias(name), F.col("kmers").alias(f"kmers_{name}"))
    links, n_links = settled(asked.join(of("a"), "a").join(ours.join(of("b"), "b"), ["b", "share"]).mapInPandas(verify, "a long, b long"), 100_000)

    roots, _ = settled(connected(links), 100_000, 2 * n_links)
    labelled, _ = settled(filled.select("place", "n", "bucket").join(roots, F.col("place") == F.col("node"), "left").select("place", "n", "bucket", F.coalesce("root", "place").alias("comp")), 100_000, n_filled)
    parts = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("kmers"), F.bit_xor(F.xxhash64("place")).alias("x"), F.sum(F.xxhash64("place", F.lit(3)).cast("decimal(38,0)")).alias("y"))
    by_bucket = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"), F.sum("kmers").alias("kmers"), F.max("rows").alias("main_rows"), F.max_by("kmers", F.struct("rows", "comp")).alias("main_kmers"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")).filter("parts > 1")
    once = by_bucket.groupBy("rows", "kmers", "x", "y").agg(F.min(F.struct("bucket", "main", "main_rows", "main_kmers")).alias("own")).select("own.*", "rows", "kmers")
    blocks = lambda n, m: F.greatest(F.ceil(n / block_rows), F.ceil(m / block_kmers), F.lit(1)).cast("int")
    alone = (F.col("rows") <= block_rows) & (F.col("kmers") <= block_kmers)
    once, _ = settled(once.select("bucket", "main", "rows", F.when(alone, 0).otherwise(blocks(F.col("main_rows"), F.col("main_kmers"))).alias("mains"), F.when(alone, 1).otherwise(blocks(F.col("rows") - F.col("main_rows"), F.col("kmers") - F.col("main_kmers"))).alias("others")), 100_000, n_heads)
    own = lambda n: F.pmod(F.xxhash64("place", F.lit(7)), n).cast("int")
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    mine = own(F.col("others"))
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: pair(o, mine))
    with_mains = F.when(F.col("mains") > 0, F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: pair(mine, F.col("others") + m))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    from_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: pair(o, F.col("others") + own(F.greatest("mains", F.lit(1)))))
    is_main = F.col("comp") == F.col("main")
    tasks = F.when(F.col("mains") == 0, F.array(pair(F.lit(0), F.lit(0)))).when(is_main, from_main).otherwise(F.array_distinct(F.concat(with_others, with_mains)))
    dealt = join_groups(labelled, once, "bucket", F.col("rows"), n_filled).select("bucket", "place", "comp", is_main.cast("int").alias("side"), F.explode(tasks).alias("task")).join(content, "place")

    def across(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("place", ignore_index=True)
        found = links_among(b["comp"].to_numpy(), [np.frombuffer(x, np.uint64) for x in b["kmers"]], b["side"].to_numpy())
        at = b["place"].to_numpy()
        return pd.DataFrame([(at[i], at[j]) for i, j in found], columns=["a", "b"])

    more, n_more = settled(dealt.groupBy("bucket", "task").applyInPandas(across, "a long, b long"), 100_000)
    if n_more:
        roots, _ = settled(connected(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), 100_000, 2 * (n_links + n_more))
    joined = texts.select("place", "digest", "id", "copies").join(roots, F.col("place") == F.col("node"), "left")
    known, _ = settled(joined.select("digest", "id", "copies", F.coalesce("root", "place").alias("root")), at_most=n_texts)
    classes, _ = settled(known.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts")), at_most=n_texts)
    by_text, _ = settled(join_groups(known.select("digest", "copies", "root"), classes, "root", F.col("texts"), n_texts).select("digest", "copies", "root", "class_id", "class_size"), at_most=n_texts)
    return join_groups(marked.select("place", "id", "digest"), by_text, "digest", F.col("copies"), n_rows).select(F.col("place").alias("_place"), F.col("root").alias("_class"), F.col("id").alias(id_col), "class_id", "class_size")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each class of near copies: that of least id, and of rows that share it the first.

    All columns of docs, of whatever names, stay as they were.
    """
    place = free_name(docs, "_place")
    found = near_duplicates(docs, id_col, text_col, **how)
    first = found.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).select("_place", "_class", "class_size")
    single = first.filter("class_size = 1").select(F.col("_place").alias(place))
    several = first.filter("class_size > 1").groupBy("_class").agg(F.min("_place").alias(place)).select(place)
    return docs.withColumn(place, F.monotonically_increasing_id()).join(single.unionByName(several), place, "left_semi").select(*[f"`{c}`" for c in docs.columns])
