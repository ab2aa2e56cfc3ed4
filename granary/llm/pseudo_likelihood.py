"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, free_name
from granary.llm.language_id import words_of

#: Names of the parameters, in the order in which they are sent; the tables of the neighbours come first.
PARTS = ("context", "bias", "group", "group_bias", "word", "word_bias")


class Hashes(dict):
    """Words to their CRC-32, by which they are known from then on; words met are kept, `most` at once."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = crc32(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, words), "<u4", len(words)) for words in words_of(text or "")]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


@dataclass
class Vocabulary:
    """Tokens: the most frequent hashes of words by rank, then bins that share out all others; `padding` stands beyond a
    text's ends."""

    hashes: np.ndarray
    counts: np.ndarray
    groups: int
    per_group: int

    def __post_init__(self):
        self.rank = np.argsort(self.hashes)
        self.sorted = np.append(self.hashes[self.rank], 0).astype(np.uint32)
        self.rank = np.append(self.rank, 0)

    @property
    def padding(self) -> int:
        return self.groups * self.per_group

    @property
    def bins(self) -> int:
        return self.padding - len(self.hashes)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.sorted[:-1], hashes)
        known = (self.sorted[at] == hashes) & (at < len(self.hashes))
        return np.where(known, self.rank[at], len(self.hashes) + hashes % np.uint32(self.bins)).astype("<u2")


class WindowNetwork:
    """log P(token | `side` tokens on each side): the group of the token, then the token within its group.

    The hidden layer is the tanh of a sum of vectors, one for each neighbour, from a table for each of their places.
    Groups hold tokens of like frequency; the biases start at the corpus frequencies, so that an untrained
    network is the unigram model.
    """

    def __init__(self, vocabulary: Vocabulary, side: int = 2, hidden: int = 16, seed: int = 41):
        rng = np.random.default_rng(seed)
        v, self.side, self.groups, self.per_group = vocabulary.padding, side, vocabulary.groups, vocabulary.per_group
        p = ((vocabulary.counts + 0.5) / (vocabulary.counts + 0.5).sum()).reshape(self.groups, self.per_group)
        self.offsets = np.array([*range(-side, 0), *range(1, side + 1)])
        self.p = {
            "context": rng.normal(0, 0.1, (2 * side, v + 1, hidden)), "bias": np.zeros(hidden),
            "group": np.zeros((hidden, self.groups)), "group_bias": np.log(p.sum(axis=1)), "word": np.zeros((self.groups, hidden, self.per_group)), "word_bias": np.log(p / p.sum(axis=1, keepdims=True)),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.ones = np.ones(max(self.groups, self.per_group), np.float32)

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        h = np.take(self.p["context"][0], context[0], axis=0)
        for k in range(1, len(self.offsets)):
            h += np.take(self.p["context"][k], context[k], axis=0)
        h += self.p["bias"]
        return np.tanh(h, out=h)

    @staticmethod
    def _bounded(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no logit can come near overflow: hidden units lie within 1, so the weights' sums bound them."""
        return (np.abs(w).sum(axis=-2) + np.abs(b)).max(axis=-1) < 60

    def _exp(self, z: np.ndarray, bounded: bool) -> np.ndarray:
        """Sums of the exponentials of the rows, which take the place of z."""
        if not bounded:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z @ self.ones[: z.shape[1]]

    def _bounds(self, target: np.ndarray) -> list[int]:
        """Where each group begins among rising targets, and the end."""
        return np.searchsorted(target, np.arange(self.groups + 1) * self.per_group).tolist()

    def log_likelihood(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of each target; context has a row for each place around it."""
        order = np.argsort(target, kind="stable")
        target = target[order]
        h, (group, within) = self._hidden(context[:, order]), np.divmod(target, self.per_group)
        at, own, sums = np.arange(len(target)), np.empty(len(target), np.float32), np.empty(len(target), np.float32)
        z = h @ self.p["group"]
        z += self.p["group_bias"]
        if not self._bounded(self.p["group"], self.p["group_bias"]):
            z -= z.max(axis=1, keepdims=True)
        first = z[at, group]
        total = self._exp(z, True)
        bounds, bounded = self._bounds(target), self._bounded(self.p["word"], self.p["word_bias"]).tolist()
        for g in range(self.groups):
            lo, hi = bounds[g], bounds[g + 1]
            if lo < hi:
                z = h[lo:hi] @ self.p["word"][g]
                z += self.p["word_bias"][g]
                if not bounded[g]:
                    z -= z.max(axis=1, keepdims=True)
                own[lo:hi] = z[at[: hi - lo], within[lo:hi]]
                sums[lo:hi] = self._exp(z, True)
        out = np.empty(len(own))
        out[order] = own + first - np.log(sums) - np.log(total)
        return out

    def step(self, context: np.ndarray, target: np.ndarray, speed: float, seen: dict[str, np.ndarray]) -> None:
        """One Adagrad step on a batch; seen holds the sums of squares."""
        order, n = np.argsort(target, kind="stable"), len(target)
        context, target = context[:, order], target[order]
        h, (group, within) = self._hidden(context), np.divmod(target, self.per_group)
        at, ones = np.arange(n), np.ones(n, np.float32)
        z = h @ self.p["group"] + self.p["group_bias"]
        z /= self._exp(z, bool(self._bounded(self.p["group"], self.p["group_bias"])))[:, None]
        z[at, group] -= 1
        back = z @ self.p["group"].T
        slopes = {k: np.zeros_like(self.p[k]) for k in ("word", "word_bias")}
        slopes |= {"group": h.T @ z, "group_bias": z.sum(axis=0)}
        bounds, bounded = self._bounds(target), self._bounded(self.p["word"], self.p["word_bias"])
        for g in range(self.groups):
            lo, hi = bounds[g], bounds[g + 1]
            if lo < hi:
                w = self.p["word"][g]
                z = h[lo:hi] @ w
                z += self.p["word_bias"][g]
                z /= self._exp(z, bool(bounded[g]))[:, None]
                z[at[: hi - lo], within[lo:hi]] -= 1
                back[lo:hi] += z @ w.T
                np.matmul(h[lo:hi].T, z, out=slopes["word"][g])
                slopes["word_bias"][g] = ones[: hi - lo] @ z
        back *= 1 - h * h
        slopes["bias"] = back.sum(axis=0)
        for k, slope in slopes.items():
            slope /= n
            self.p[k] -= self._step(seen[k], slope, speed)
        back /= n
        for k in range(len(self.offsets)):
            order = np.argsort(context[k], kind="stable")
            rows = context[k][order]
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            rows = rows[starts]
            squares = np.take(seen["context"][k], rows, axis=0)
            change = self._step(squares, np.add.reduceat(np.take(back, order, axis=0), starts, axis=0), speed)
            seen["context"][k][rows] = squares
            self.p["context"][k][rows] -= change

    @staticmethod
    def _step(squares: np.ndarray, slope: np.ndarray, speed: float) -> np.ndarray:
        """What to take off; squares gets those of slope added."""
        root = slope * slope
        squares += root
        np.sqrt(squares, out=root)
        root += 1e-5
        slope *= speed
        slope /= root
        return slope

    def contexts(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Neighbours of the places at of a row of texts with padding around each, a row for each offset."""
        return row[at[None, :] + self.offsets[:, None]]

    def pack(self) -> bytes:
        return b"".join(self.p[k].tobytes() for k in PARTS)

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in PARTS:
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size


def with_hashes(docs: DataFrame, text_col: str = "text", hashes_col: str = "hashes") -> DataFrame:
    """docs with the words of the whole text, as runs of letters, in place of it: their CRC-32 as little-endian unsigned
    32-bit integers. Words of one CRC-32 are one word."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = Hashes()
        for texts in batches:
            yield pd.Series([hashes.of(t).tobytes() for t in texts], dtype=object)

    kept = [f"`{c}`" for c in docs.columns if c.lower() not in (text_col.lower(), hashes_col.lower())]
    return docs.select(*kept, encode(F.col(text_col).cast("string")).alias(hashes_col))


def count_words(hashed: DataFrame, hashes_col: str = "hashes", groups: int = 64, per_group: int = 96, bins: int = 256) -> Vocabulary:
    """Vocabulary of groups times per_group tokens from the counts of all words of all documents (hashed as by with_hashes).

    A bin's count is the sum over all words outside the vocabulary that hash into it.
    """
    if groups * per_group >= 1 << 16:
        raise ValueError("the vocabulary has more tokens than 16 bits can number")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for x in b["hashes"]:
                held.append(x)
                size += len(x)
                if size >= 8 << 20:
                    yield table(held)
                    held, size = [], 0
        yield table(held)

    def table(held: list[bytes]) -> pd.DataFrame:
        found, n = np.unique(np.frombuffer(b"".join(held), "<u4"), return_counts=True)
        return pd.DataFrame({"hash": found.astype(np.int64), "n": n.astype(np.int64)})

    counts = cut(hashed.select(F.col(hashes_col).alias("hashes")).mapInPandas(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    rows = counts.orderBy(F.desc("n"), "hash").limit(groups * per_group - bins).collect()
    vocabulary = Vocabulary(np.array([r["hash"] for r in rows], np.uint32), np.zeros(groups * per_group), groups, per_group)
    vocabulary.counts[: len(rows)] = [r["n"] for r in rows]
    for r in counts.groupBy((F.col("hash") % vocabulary.bins).alias("bin")).agg(F.sum("n").alias("n")).collect():
        vocabulary.counts[len(rows) + r["bin"]] = r["n"]
    for r in rows:
        vocabulary.counts[len(rows) + r["hash"] % vocabulary.bins] -= r["n"]
    return vocabulary


def _laid_out(texts: list[bytes], vocabulary: Vocabulary, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts in one row with padding around each, their places, and each text's number of tokens."""
    sizes = np.fromiter((len(t) // 4 for t in texts), np.int64, len(texts))
    row = np.full(int(sizes.sum()) + side * (len(texts) + 1), vocabulary.padding, "<u2")
    at = np.arange(int(sizes.sum())) + side * np.repeat(np.arange(1, len(texts) + 1), sizes)
    row[at] = vocabulary.tokens(np.frombuffer(b"".join(texts), "<u4"))
    return row, at, sizes


def _averaged(copies: Iterator[tuple[int, bytes, bytes]], rows: int, width: int, head: int, places: int) -> tuple[int, bytes, bytes]:
    """One network of several (tokens, count of each token, parameters), weighted by tokens; a neighbour's vector is
    weighted by how often each copy met that token."""
    total, weight, n = np.zeros(width), np.zeros(rows), 0
    for m, counts, flat in copies:
        own, x = np.frombuffer(counts, np.float32) + 1e-3, np.frombuffer(flat, np.float32)
        total[:head] += (x[:head].reshape(-1, rows, head // rows // places) * own[None, :, None]).reshape(-1)
        total[head:] += m * x[head:].astype(np.float64)
        weight += own
        n += m
    total[:head] = (total[:head].reshape(-1, rows, head // rows // places) / weight[None, :, None]).reshape(-1)
    total[head:] /= max(n, 1)
    return n, weight.astype(np.float32).tobytes(), total.astype(np.float32).tobytes()


def fit_network(hashed: DataFrame, vocabulary: Vocabulary, hashes_col: str = "hashes", rounds: int = 1, batch: int = 8192, speed: float = 0.15, per_copy: int = 1_000_000, fan_in: int = 8) -> WindowNetwork:
    """Network trained on every token of every text (hashed as by with_hashes) in each round.

    In each round every partition trains a copy of the network on its own texts; partitions are joined, without
    a shuffle, while they hold less than per_copy tokens on average. Copies are averaged on executors fan_in by
    fan_in, and again, until fan_in of them at most come to the driver.
    """
    network = WindowNetwork(vocabulary)
    rows, head, width = vocabulary.padding + 1, network.p["context"].size, sum(network.p[k].size for k in PARTS)
    places = len(network.offsets)
    copies = max(1, min(hashed.rdd.getNumPartitions(), int(vocabulary.counts.sum()) // per_copy))
    hashed = hashed.select(F.col(hashes_col).alias("hashes")).coalesce(copies)
    schema = "part int, n long, counts binary, network binary"
    for k in range(rounds):
        sent = hashed.sparkSession.sparkContext.broadcast((network, vocabulary, k))

        def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, words, turn = sent.value
            own = WindowNetwork(words)
            own.p = {name: x.copy() for name, x in start.p.items()}
            seen = {name: np.zeros_like(x) for name, x in own.p.items()}
            rng = np.random.default_rng(turn)
            counts, held, size, used = np.zeros(words.padding + 1, np.float32), [], 0, 0
            for b in batches:
                for text in b["hashes"]:
                    held.append(text)
                    size += len(text) // 4
                    if size >= 16 * batch:
                        used += _train_on(own, held, words, batch, speed, seen, rng, counts)
                        held, size = [], 0
            used += _train_on(own, held, words, batch, speed, seen, rng, counts)
            if used:
                yield pd.DataFrame({"part": [0], "n": [used], "counts": [counts.tobytes()], "network": [own.pack()]})

        def average(group: pd.DataFrame) -> pd.DataFrame:
            n, counts, flat = _averaged(zip(group["n"], group["counts"], group["network"], strict=True), rows, width, head, places)
            return pd.DataFrame({"part": [int(group["part"].iloc[0]) // fan_in], "n": [n], "counts": [counts], "network": [flat]})

        found, left = hashed.mapInPandas(train, schema).withColumn("part", F.spark_partition_id()), copies
        while left > fan_in:
            found, left = found.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(average, schema), -(-left // fan_in)
        trained = sorted(tuple(r) for r in found.collect())
        if trained:
            network.unpack(np.frombuffer(_averaged([r[1:] for r in trained], rows, width, head, places)[2], np.float32))
        sent.unpersist()
    return network


def _train_on(network: WindowNetwork, texts: list[bytes], vocabulary: Vocabulary, batch: int, speed: float, seen: dict, rng: np.random.Generator, counts: np.ndarray) -> int:
    """Steps over all tokens of the texts in random order; counts gets how often each token occurs."""
    if not texts:
        return 0
    row, places, _ = _laid_out(texts, vocabulary, network.side)
    counts += np.bincount(row[places], minlength=len(counts))
    places = rng.permutation(places)
    for k in range(0, len(places), batch):
        at = places[k : k + batch]
        network.step(network.contexts(row, at), row[at], speed, seen)
    return len(places)


def with_pseudo_likelihood(docs: DataFrame, network: WindowNetwork, vocabulary: Vocabulary, text_col: str = "text", hashes_col: str | None = None) -> DataFrame:
    """docs with n_tokens, pll and pll_per_token (columns of these names are replaced).

    pll: the sum over all tokens of the whole text of log P(token | its neighbours on both sides); pll_per_token its
    mean. Texts without words (null and empty ones too) have 0 tokens and 0.0 for both. Words are runs of letters.
    Repeated rows score alike; an empty table gives an empty result; very long texts are scored a few thousand tokens
    at a time. With hashes_col, docs has the hashes of with_hashes, and text_col is not read. The network, of fixed
    size, is sent to the executors; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast((network, vocabulary))

    @F.pandas_udf("n long, pll double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net, words = sent.value
        hashes = Hashes() if hashes_col is None else None
        for given in batches:
            rows = []
            for k in range(0, len(given), 64):
                texts = given.iloc[k : k + 64]
                rows += _scores(net, words, [hashes.of(t).tobytes() for t in texts] if hashes is not None else [t or b"" for t in texts])
            yield pd.DataFrame(rows, columns=["n", "pll"])

    scored = free_name(docs, "_score_")
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("n_tokens", "pll", "pll_per_token")]
    n, pll = F.col(f"{scored}.n"), F.col(f"{scored}.pll")
    given = F.col(text_col).cast("string") if hashes_col is None else F.col(hashes_col)
    return docs.select(*kept, score(given).alias(scored)).select(*kept, n.alias("n_tokens"), pll.alias("pll"), F.when(n > 0, pll / n).otherwise(0.0).alias("pll_per_token"))


def _scores(network: WindowNetwork, vocabulary: Vocabulary, texts: list[bytes], slice_size: int = 4096) -> list[tuple[int, float]]:
    """Tokens and summed log-probabilities of each text."""
    row, at, sizes = _laid_out(texts, vocabulary, network.side)
    value = np.empty(len(at))
    for k in range(0, len(at), slice_size):
        places = at[k : k + slice_size]
        value[k : k + slice_size] = network.log_likelihood(network.contexts(row, places), row[places])
    ends = np.cumsum(sizes).tolist()
    return [(n, float(value[e - n : e].sum())) for n, e in zip(sizes.tolist(), ends, strict=True)]


def score_corpus(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs, with n_tokens, pll and pll_per_token in place of text, by a network trained on all of docs.

    The text is read once, to write the hashes of its words to the checkpoint folder; from there words are counted, and
    the network learns and scores.
    """
    name = free_name(docs, "_hashes")
    hashed = cut(with_hashes(docs, text_col, name))
    words = count_words(hashed, name)
    return with_pseudo_likelihood(hashed, fit_network(hashed, words, name, **how), words, hashes_col=name).drop(name)
