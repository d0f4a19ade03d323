"""Vectors: hashed bag-of-words embedding, nearest neighbours, clusters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.session import materialise

DIM = 64
#: Models of a worker process, by the column that asks for them.
_models: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def _model(name: str, load: Callable) -> Callable[[list[str]], list[list[float]]]:
    if name not in _models:
        _models[name] = load()
    return _models[name]


def encoded(text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 256) -> Column:
    """Vectors of texts by a model. ``load`` gives a function from texts to vectors; a worker calls it once, and the model takes
    ``batch`` texts at a time."""
    name = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(name, load)
        for t in parts:
            rows = t.tolist()
            yield pd.Series([[float(x) for x in v] for i in range(0, len(rows), batch) for v in model(rows[i : i + batch])], index=t.index, dtype=object)

    return run(text)


def embed(df: DataFrame, key: str, text: str, dim: int = DIM, prefix: str = "", load: Callable | None = None) -> DataFrame:
    """``key, embedding``: counts of words by ``md5(word) mod dim``, at unit length; zeros for texts without words.

    ``prefix`` stands before each text, as an instruction before questions does; a null text is an empty one. With ``load`` a
    model gives the vectors instead (see ``encoded``)."""
    if load is not None:
        return df.select(key, encoded(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))), load).alias("embedding"))
    word = F.explode(F.regexp_extract_all(F.lower(F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))), F.lit("[a-z0-9_]+"), F.lit(0)))
    slot = F.conv(F.right(F.md5("w"), F.lit(2)), 16, 10).cast("int") % dim
    n = df.select(key, word.alias("w")).select(key, slot.alias("slot")).groupBy(key, "slot").agg(F.count("*").cast("double").alias("n"))
    vec = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    out = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.coalesce("norm", F.lit(1.0))).cast("double"))
    return df.select(key).join(vec, key, "left").select(key, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(out).alias("embedding"))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def cosine(a: Column | str, b: Column | str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, d: s + d)
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def knn(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", most_bytes: int = 64 << 20) -> DataFrame:
    """The ``k`` nearest items (item_id, embedding) of each query (query_id, embedding) by squared distance, then id.

    Queries are a stated set read against all items in blocks: each item partition compares its own items with the queries as
    matrices, keeps k for each, and only these are shuffled. Null vectors are left out, texts' vectors have one length. The queries are broadcast while they stay below ``most_bytes``; more
    go in blocks of that size, each of which reads all items again; for as many queries as items see ``neighbours.knn``."""
    spark = items.sparkSession
    q = materialise(queries.filter("embedding is not null").select(F.col(query_id).alias("query"), F.col("embedding").cast("array<double>").alias("q")), "queries")
    size = q.agg(F.sum(F.size("q") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-size // most_bytes))
    x = items.filter("embedding is not null").select(F.col(item_id).alias("item"), F.col("embedding").cast("array<double>").alias("v"))
    x = x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # vectors lie in few files, and each meets all queries
    kinds = [dict(d.dtypes)[c] for d, c in ((q, "query"), (x, "item"))]
    out = None
    for i in range(blocks):
        rows = (q.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) if blocks > 1 else q).collect()  # bounded by most_bytes
        if not rows:
            continue
        asked = spark.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["q"] for r in rows], np.float64)))
        part = x.mapInPandas(partial(_nearest, asked, k), f"query {kinds[0]}, item {kinds[1]}, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{query_id} {kinds[0]}, {item_id} {kinds[1]}, distance double, pos int")
    w = W.partitionBy("query").orderBy("distance", "item")
    top = out.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    return top.select(F.col("query").alias(query_id), F.col("item").alias(item_id), "distance", "pos")


def _nearest(asked, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``query, item, distance`` of the ``k`` items of these batches (item, v) that are nearest to each query, by id in ties.

    A product of matrices tells which may be among them, with room for rounding; their distances are then summed in order, as
    ``squared_l2`` does. Between batches only the best ``k`` are kept."""
    ids, m = asked.value
    norm, held = (m * m).sum(1), None
    bound = np.full(len(ids), np.inf)
    for b in batches:
        for i in range(0, len(b), 2048):
            part = b.iloc[i : i + 2048].sort_values("item", kind="stable")
            v = np.array(part["v"].tolist(), np.float64)
            own = (v * v).sum(1)
            for j in range(0, len(ids), 2048):
                a = m[j : j + 2048]
                d = norm[j : j + 2048, None] + own - 2 * a @ v.T
                room = 1e-5 + 1e-9 * (norm[j : j + 2048] + own.max())
                kth = bound[j : j + 2048]
                if d.shape[1] > k and np.isinf(kth).any():
                    kth = np.minimum(kth, np.partition(d, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero(d <= (kth + room)[:, None])
                if not len(r):
                    continue
                exact = np.zeros(len(r))
                for n in range(v.shape[1]):
                    exact += (v[c, n] - a[r, n]) ** 2
                new = pd.DataFrame({"query": r + j, "item": part["item"].to_numpy()[c], "distance": np.round(exact, 6)})
                held = new if held is None else pd.concat([held, new])
            if held is not None and len(held) > 2 * k * len(ids):
                held = _top(held, k)
                last = held.groupby("query")["distance"].nth(k - 1)
                bound[held.loc[last.index, "query"].to_numpy()] = last.to_numpy()
    if held is not None:
        top = _top(held, k)
        yield top.assign(query=[ids[q] for q in top["query"]])


def _top(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["query", "distance", "item"]).groupby("query").head(k).reset_index(drop=True)


def clusters(items: DataFrame, k: int = 8, item_id: str = "item_id", seed: int = 42) -> DataFrame:
    """``item_id, cluster``: k-means labels with at most as many clusters as items; with one item or none, cluster 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = min(k, items.limit(k).count())
    if k <= 1:
        return items.select(item_id, F.lit(0).alias("cluster"))
    v = items.select(item_id, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select(item_id, F.col("prediction").alias("cluster"))


def note_clusters(chunks: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """``source, cluster``: each note's label is that of its last chunk; ``chunks`` has chunk_id, source, chunk_ix, embedding."""
    label = clusters(chunks, min(k, chunks.select("source").distinct().limit(k).count()), "chunk_id", seed)
    return chunks.select("chunk_id", "source", "chunk_ix").join(label, "chunk_id").groupBy("source").agg(F.max_by("cluster", "chunk_ix").alias("cluster"))
