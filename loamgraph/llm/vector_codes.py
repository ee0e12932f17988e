"""Vector codes: integer codebooks for the parts of vectors, fitted in rounds of exact distances and grouped sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import stored

#: Components are integers of this magnitude at most, so that no sum of squared differences leaves 64 bits.
LARGEST = 1 << 27
#: Rows whose distances to a codebook are held at once.
ROWS = 4096
#: Parts among which the rows of one label are dealt when they get their label's sum.
SALTS = 32


def integer_vectors(vectors: DataFrame, *, scale: int = 1024) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``(vec_id, label, v array<bigint>)``: floor(scale * x) of each component.

    Rows whose vector is null, or holds a null, an infinity or NaN, are left out.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", "label", v.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if flat.size and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST}; choose a smaller scale")
    return flat.reshape(len(column), dims)


def _edges(dims: int, parts: int) -> list[int]:
    return [dims * k // parts for k in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the first of equal ones; squared distance) of each row: |x|^2 - 2 x c + |c|^2, all in 64-bit integers."""
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ np.ascontiguousarray(book.T)) + (book * book).sum(axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _sums(books: Broadcast, dims: int):
    """Vectors -> one row (part, entry, n, sums...) for each entry that some part of this task is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _edges(dims, len(books.value))
        widest = max(b - a for a, b in zip(cut, cut[1:]))
        n = [np.zeros(len(b), np.int64) for b in books.value]
        total = [np.zeros((len(b), widest), np.int64) for b in books.value]
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(k, ROWS), dims)
                for p, book in enumerate(books.value):
                    part = x[:, cut[p] : cut[p + 1]]
                    at, _ = nearest(part, book)
                    n[p] += np.bincount(at, minlength=len(book))
                    np.add.at(total[p][:, : part.shape[1]], at, part)
        for p in range(len(books.value)):
            used = np.flatnonzero(n[p])
            if len(used):
                columns = [np.full(len(used), p), used, n[p][used], *total[p][used].T]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "n", *[f"s{i}" for i in range(widest)]])

    return run


def _codes(books: Broadcast, dims: int):
    """(vec_id, label, v) -> (vec_id, label, code, error); null codes and errors for vectors of another length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _edges(dims, len(books.value))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                rows = batch.slice(k, ROWS)
                fits = np.diff(rows.column(2).offsets.to_numpy()) == dims
                x = _matrix(rows.column(2).filter(pa.array(fits)), dims)
                at, far = zip(*[nearest(x[:, cut[p] : cut[p + 1]], book) for p, book in enumerate(books.value)])
                places = np.flatnonzero(fits)
                code, error = np.full(len(fits), None, object), np.full(len(fits), None, object)
                code[places] = [bytes(c).hex() for c in np.stack(at, axis=1).astype(np.uint8)]
                error[places] = sum(far).tolist()
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def first_books(kept: DataFrame, *, parts: int, entries: int) -> tuple[list[np.ndarray], int]:
    """The parts of the ``entries`` kept vectors of the smallest vec_ids, and their length, that of the very first; ``([], 0)`` without vectors.

    Of equal vec_ids the smaller vector comes first; rows without vec_id come last. Only so many rows come to the driver.
    """
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(1).collect()
    if not first:
        return [], 0
    dims = len(first[0]["v"])
    rows = kept.where(F.size("v") == dims).orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    x = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dims)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST}; choose a smaller scale")
    cut = _edges(dims, parts)
    return [x[:, a:b] for a, b in zip(cut, cut[1:])], dims


def fit(kept: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[list[np.ndarray], int]:
    """``integer_vectors`` rows -> the codebooks of all parts after ``rounds`` rounds, and the length of vectors.

    A round broadcasts the codebooks (``entries`` rows of a vector's length). Each task sums the parts that are nearest to an entry, a grouped shuffle
    merges the sums, and the driver gets one row for each entry in use, whose new components are floor(sum / count).
    Vectors of another length than the first one take no part.
    """
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    books, dims = first_books(kept, parts=parts, entries=entries)
    spark, own = kept.sparkSession, kept.where(F.size("v") == dims).select("v")
    for _ in range(rounds if books else 0):
        widest = max(b.shape[1] for b in books)
        names = [f"s{i}" for i in range(widest)]
        held = spark.sparkContext.broadcast(books)
        each = own.mapInArrow(_sums(held, dims), ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
        merged = each.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        books = [b.copy() for b in books]
        for r in merged.collect():
            book = books[r["part"]]
            book[r["entry"]] = np.array(r[3 : 3 + book.shape[1]], np.int64) // r["n"]
    return books, dims


def checksum(books: list[np.ndarray]) -> str:
    """Of all components in decimal, by part, entry and place in the part, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``(vec_id, code, error, label_error, codebooks_sha256)``, a row for each vector that is kept.

    Vectors are made integers (rows with null or non-finite components go), cut into ``parts`` consecutive parts as equal as can be, and each part is
    named by its nearest codebook entry. ``error``: squared distances summed over parts; ``label_error``: errors summed over equal
    labels, null labels together. Equal vectors and repeated rows fare alike; rows without vec_id are kept. A vector of another length than that of the
    smallest vec_id has null code and error. Components beyond 2^27 (after scaling) are refused with an error, as distances would
    no longer be exact. No rows kept: no rows. Other columns are not looked at.
    """
    kept = stored(integer_vectors(vectors, scale=scale), "integer-vectors")
    books, dims = fit(kept, parts=parts, entries=entries, rounds=rounds)
    name, kind = kept.schema["vec_id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()
    schema = f"vec_id {name}, label {kind}, code string, error long"
    if not books:
        return kept.sparkSession.createDataFrame([], "vec_id " + name + ", code string, error long, label_error long, codebooks_sha256 string")
    told = stored(kept.mapInArrow(_codes(kept.sparkSession.sparkContext.broadcast(books), dims), schema), "vector-codes")
    sums = told.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A label may hold any share of the rows: its sum is copied for each part of them; a merge join, as the copies are made after sizes are known.
    dealt = told.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).alias("t")
    joined = dealt.join(sums.hint("merge").alias("s"), F.col("t.label").eqNullSafe(F.col("s.label")) & (F.col("t.salt") == F.col("s.salt")))
    return joined.select("t.vec_id", "t.code", "t.error", "s.label_error", F.lit(checksum(books)).alias("codebooks_sha256"))


def oracle(*, parts: int = 4, dims: int = 64, rounds: int = 4) -> str:
    """The same rows in SQL, for 64 components, 4 parts and 256 entries: one assignment and one update after the other."""
    width = dims // parts
    ctes = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, label, p, CAST(v[p * {width} + 1 : p * {width} + {width}] AS DOUBLE[]) AS x FROM kept, range({parts}) r(p))",
        "books0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e FROM cut) WHERE e < 256)",
    ]
    for k in range(rounds + 1):
        far = "CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT)"
        ctes.append(f"near{k} AS MATERIALIZED (SELECT vec_id, label, p, any_value(x) AS x, min({far} * 256 + e) AS m FROM cut JOIN books{k} USING (p) GROUP BY vec_id, label, p)")
        if k < rounds:
            ctes.append(
                f"books{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM books{k} b LEFT JOIN (SELECT p, e, list(CAST(f AS DOUBLE) ORDER BY d) AS c FROM"
                f" (SELECT p, m % 256 AS e, d, floor(sum(x[d]) / count(*)) AS f FROM near{k}, range(1, {width + 1}) r(d) GROUP BY 1, 2, 3) GROUP BY p, e) u ON b.p = u.p AND b.e = u.e)"
            )
    last = f"SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label"
    sha = f"(SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) FROM books{rounds})"
    return f"WITH {', '.join(ctes)}, told AS ({last}) SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {sha} AS codebooks_sha256 FROM told"


ORACLE = oracle()
