"""Maximum inner product search: score-aware anisotropic quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CENTRES = 16


@dataclass
class Quantiser:
    """Codebooks (spaces, 16, dims of a space) for vectors padded with zeros to whole spaces, and the loss's eta."""

    books: np.ndarray
    eta: float

    @classmethod
    def fit(cls, x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 4, seed: int = 11) -> Quantiser:
        """From sample rows x. A residual parallel to its vector weighs eta = (d - 1) t^2 / (1 - t^2) times one
        across it, after the loss for inner products above t times the norm.

        Spaces are first clustered one by one; then codes and centres are improved by turns under the joint loss.
        """
        spaces = -(-x.shape[1] // width)
        eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
        parts = cls._parts(x, spaces, width)
        rng = np.random.default_rng(seed)
        start = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)]
        books = np.ascontiguousarray(start.transpose(1, 0, 2)).astype(np.float64)
        for _ in range(8):
            codes = cls._nearest(parts, books)
            for m in range(spaces):
                for c in np.unique(codes[:, m]):
                    books[m, c] = parts[codes[:, m] == c, m].mean(axis=0)
        q = cls(books, eta)
        for _ in range(rounds):
            codes = q.encode(x)
            q._improve(x, codes)
        return q

    @staticmethod
    def _parts(x: np.ndarray, spaces: int, width: int) -> np.ndarray:
        padded = np.zeros((len(x), spaces * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), spaces, width)

    @staticmethod
    def _nearest(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
        far = (books**2).sum(axis=2)[None] - 2 * np.einsum("nmw,mcw->nmc", parts, books)
        return far.argmin(axis=2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, spaces): nearest centres, then space by space the code of least joint loss."""
        spaces, _, width = self.books.shape
        parts = self._parts(x, spaces, width)
        codes = self._nearest(parts, self.books)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        at = np.arange(spaces)
        residual = parts - self.books[at, codes]
        along = np.einsum("nmw,nmw->nm", residual, unit)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for m in range(spaces):
                r = parts[:, m, None, :] - self.books[m][None]
                a = np.einsum("ncw,nw->nc", r, unit[:, m])
                loss = (r**2).sum(axis=2) + (self.eta - 1) * (total[:, None] - along[:, m, None] + a) ** 2
                codes[:, m] = loss.argmin(axis=1)
                chosen = a[np.arange(len(x)), codes[:, m]]
                total += chosen - along[:, m]
                along[:, m] = chosen
        return codes.astype(np.uint8)

    def _improve(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre to the solution of its weighted least squares, the other spaces held."""
        spaces, _, width = self.books.shape
        parts = self._parts(x, spaces, width)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        at = np.arange(spaces)
        along = np.einsum("nmw,nmw->nm", parts - self.books[at, codes], unit)
        total = along.sum(axis=1)
        for m in range(spaces):
            for c in np.unique(codes[:, m]):
                own = codes[:, m] == c
                u, p = unit[own, m], parts[own, m]
                rest = total[own] - along[own, m] + (p * u).sum(axis=1)
                left = own.sum() * np.eye(width) + (self.eta - 1) * u.T @ u
                self.books[m, c] = np.linalg.solve(left, p.sum(axis=0) + (self.eta - 1) * u.T @ rest)
            along[:, m] = ((parts[:, m] - self.books[m, codes[:, m]]) * unit[:, m]).sum(axis=1)
            total = along.sum(axis=1)

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        """Two codes in a byte, one row for each pair of spaces."""
        if codes.shape[1] % 2:
            codes = np.column_stack([codes, np.zeros(len(codes), np.uint8)])
        return np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).T)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, the products with every pair of centres that a byte can name: (queries, pairs, 256)."""
        spaces, _, width = self.books.shape
        each = np.einsum("nmw,mcw->nmc", self._parts(q, spaces, width), self.books)
        if spaces % 2:
            each = np.concatenate([each, np.zeros((len(q), 1, CENTRES))], axis=1)
        return (each[:, 0::2, :, None] + each[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)


def search(quantiser: Quantiser | None, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, ids and exact products of the k best of the `rerank` best by the table scan, its own id left out.

    ids rise; at equal estimates the smaller ids go on to be reranked, and at equal products they come first. codes has
    a packed row for each id; where all ids are reranked, no quantiser is needed.
    """
    codes = np.ascontiguousarray(codes.T)
    out = []
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        tables = [None] * len(part) if len(ids) <= rerank else quantiser.tables(part)
        for qid, q, table in zip(query_ids[at : at + 256], part, tables, strict=True):
            if table is not None:
                estimate = table[0][codes[0]]
                for j in range(1, len(codes)):
                    estimate += table[j][codes[j]]
                estimate[ids == qid] = -np.inf
                least = np.partition(estimate, len(ids) - rerank)[len(ids) - rerank]
                above = np.flatnonzero(estimate > least)
                best = np.concatenate([above, np.flatnonzero(estimate == least)[: rerank - len(above)]])
                best.sort()
            else:
                best = np.arange(len(ids))
            best = best[ids[best] != qid]
            exact = (vectors[best] * q).sum(axis=1)
            order = np.lexsort([ids[best], -exact])[:k]
            out.append((ids[best][order], exact[order]))
    return out


def _rows(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """A column of lists or byte strings of one length as a matrix."""
    column = column.combine_chunks()
    flat = np.frombuffer(b"".join(column.to_pylist()), kind) if pa.types.is_binary(column.type) else column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sorted(table: pa.Table) -> list[np.ndarray]:
    """Ids in rising order, their vectors and codes; of rows with one id, the one whose vector's bytes are least."""
    ids, vectors = table.column("id").combine_chunks().to_numpy(zero_copy_only=False), _rows(table.column("vector"), np.float64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i].tobytes())) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    held = ids[order]
    order = np.asarray(order, np.int64)[np.concatenate([[True], held[1:] != held[:-1]])]
    return [ids[order], vectors[order], *([_rows(table.column("codes"), np.uint8)[order]] if "codes" in table.column_names else [])]


def nearest(vectors: DataFrame, id_col: str, vector_col: str, is_query: str, k: int = 20, rerank: int = 200, sample: int = 8192, candidate_block: int = 16384, query_block: int = 32768) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): for each row where is_query holds, the k other rows of largest
    inner product among those found, in double precision; ties go to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Vectors of other
    lengths have no product with a query; each length is searched by itself. Of rows that share an id, one counts. An
    empty table gives an empty result.

    A quantiser for each length that has queries learns from about `sample` vectors in all, drawn by hashed id, 256 of a
    length at least; lengths of no more than `rerank` vectors need none. Every vector is coded, once, and scanned.
    Queries and candidates are dealt into blocks by hashed id, and each pair of blocks is one task: it scans the block's
    codes for each query, reranks the `rerank` best by exact products and returns the k best. Neither side is broadcast,
    and memory is bounded by the blocks; work grows with queries times candidates, as asked.
    """
    spark = vectors.sparkSession
    real = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & real).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"), F.size(vector_col).alias("d"))
    lengths = {r["d"]: (r["n"], r["q"]) for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).filter("q > 0").collect()}
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_length = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("d")]
    rows = rows.filter(F.col("d").isin(list(lengths)))
    large = {d: n for d, (n, _) in lengths.items() if n > rerank}
    books: dict[int, Quantiser] = {}
    if large:
        share = max(256, sample // len(large))
        bound = by_length({d: int(min(1.0, share / n) * (1 << 40)) for d, n in large.items()})
        drawn = rows.filter(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 40)) <= bound).select("id", "vector", "d").toArrow()
        for d in large:
            own = drawn.filter(pa.compute.equal(drawn.column("d"), d))
            own = own if own.num_rows else rows.filter(F.col("d") == d).select("id", "vector").limit(1).toArrow()
            books[d] = Quantiser.fit(_sorted(own)[1])
    sent = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, codes = b.column("d").to_numpy(), [b""] * b.num_rows
            for d in np.unique(sizes):
                if (q := sent.value.get(int(d))) is not None:
                    at = np.flatnonzero(sizes == d)
                    packed = q.packed(q.encode(_rows(pa.chunked_array([b.column("vector").take(pa.array(at))]), np.float64))).T
                    for k, x in zip(at.tolist(), packed, strict=True):
                        codes[k] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "vector", "d")), pa.array(codes, pa.binary())], names=["id", "vector", "d", "codes"])

    n_c = {d: max(1, round(n / candidate_block)) for d, (n, _) in lengths.items()}
    n_q = {d: -(-q // query_block) for d, (_, q) in lengths.items()}
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), by_length(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), by_length(n) - 1))
    candidates = rows.select("id", "vector", "d").mapInArrow(coded, "id long, vector array<double>, d int, codes binary").select("id", "vector", "d", "codes", block(n_c, 19).alias("c"), every(n_q).alias("q"))
    queries = rows.filter("asks").select("id", "vector", "d", block(n_q, 23).alias("q"), every(n_c).alias("c"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (qids, q), (ids, v, codes) = _sorted(left), _sorted(right)
            found = [(np.full(len(i), qid), i, s) for qid, (i, s) in zip(qids, search(sent.value.get(q.shape[1]), qids, q, ids, v, codes, k, rerank), strict=True)]
        columns = [np.concatenate([x[j] for x in found] or [np.zeros(0)]) for j in range(3)]
        return pa.table({"query_id": columns[0].astype(np.int64), "vec_id": columns[1].astype(np.int64), "score": columns[2].astype(np.float64)})

    keys = ("d", "c", "q")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
