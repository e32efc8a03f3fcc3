"""Ranked lexical search over inverted treaps.

Documents are dealt into shards. In a shard every asked term has a treap of its postings: a search
tree by document and a heap by impact, so that the top of a subtree bounds what the term adds to any
document in it. A query walks the treaps of its terms together, over ever smaller intervals of
documents, and leaves an interval as soon as the sum of those tops cannot enter the best k.
"""

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_values, hashed_words, scratch, slices, small_batches, stored

#: A shard ends at so many documents, or when it has so many postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
#: Subtrees of so few postings are one bucket with its maximum.
BUCKET = 32
#: Intervals of so few documents are scored whole.
LEAF = 256
#: Characters of queries that one block may hold; more queries make more blocks, each against all documents.
BLOCK_CHARS = 8_000_000

_VALUES = byte_values("terms")


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all terms of the texts, and where those of each text begin and end."""
    return hashed_words(texts, _VALUES)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Treaps:
    """The treaps of a shard: for each term the postings from firsts[term] to firsts[term + 1], by document.

    Nodes of all terms lie in the same arrays. An inner node has a posting as its key, the largest of
    its impacts as its top (of equal ones the middle one), and two subtrees; a bucket has its top only.
    Node 0 is the empty subtree.
    """

    def __init__(self, n_docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.argsort(term * n_docs + doc, kind="stable")
        self.n_docs, self.doc, self.impact = n_docs, doc[order], impact[order]
        self.at = (term * n_docs + doc)[order]
        firsts = np.searchsorted(term[order], np.arange(n_terms + 1)).tolist()
        self.root = np.zeros(n_terms, np.int64)
        keys, tops, lefts, rights = [-1], [0], [0], [0]
        for t in range(n_terms):
            if firsts[t] < firsts[t + 1]:
                self.root[t] = len(keys)
                todo = [(firsts[t], firsts[t + 1], -1, lefts)]
                while todo:
                    low, high, parent, side = todo.pop()
                    own = self.impact[low:high]
                    top = own.max()
                    if parent >= 0:
                        side[parent] = len(keys)
                    tops.append(top)
                    lefts.append(0)
                    rights.append(0)
                    if high - low <= BUCKET:
                        keys.append(-1)
                        continue
                    best = np.flatnonzero(own == top)
                    key = low + int(best[len(best) // 2])
                    node = len(keys)
                    keys.append(int(self.doc[key]))
                    if low < key:
                        todo.append((low, key, node, lefts))
                    if key + 1 < high:
                        todo.append((key + 1, high, node, rights))
        self.key, self.top, self.left, self.right = (np.array(x, np.int64) for x in (keys, tops, lefts, rights))

    def _within(self, nodes: np.ndarray, low: int, high: int) -> np.ndarray:
        """The subtrees below nodes that hold the documents from low to before high, without what lies above them."""
        nodes = nodes.copy()
        while True:
            key = self.key[nodes]
            over, under = key >= high, (key >= 0) & (key < low)
            if not (over.any() or under.any()):
                return nodes
            nodes[over] = self.left[nodes[over]]
            nodes[under] = self.right[nodes[under]]

    def _scores(self, own: np.ndarray, weights: np.ndarray, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(self.at, own * self.n_docs + low), np.searchsorted(self.at, own * self.n_docs + high)
        many = b - a
        places = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
        out = np.zeros(high - low, np.int64)
        np.add.at(out, self.doc[places] - low, np.repeat(weights, many) * self.impact[places])
        return out

    def best(self, own: np.ndarray, weights: np.ndarray, k: int, held: list[int]) -> list[tuple[int, int]]:
        """(score, document) of all that may be among the k best, given the scores of others (a heap of k at most)."""
        some = self.root[own] > 0
        own, weights, out = own[some], weights[some], []
        todo = [(0, self.n_docs, self.root[own])] if len(own) else []

        def take(score: int, doc: int) -> None:
            if score > 0 and (len(held) < k or score >= held[0]):
                out.append((score, doc))
                heapq.heappush(held, score)
                if len(held) > k:
                    heapq.heappop(held)

        while todo:
            low, high, nodes = todo.pop()
            sums = weights * self.top[nodes]
            bound = int(sums.sum())
            if bound == 0 or len(held) >= k and bound < held[0]:
                continue
            keys = self.key[nodes]
            if high - low <= LEAF or (keys < 0).all():
                scores = self._scores(own, weights, low, high)
                at = np.flatnonzero(scores >= max(1, held[0] if len(held) >= k else 1))
                for i in at[np.argsort(-scores[at], kind="stable")].tolist():
                    take(int(scores[i]), low + i)
                continue
            doc = int(keys[np.argmax(np.where(keys < 0, -1, sums))])
            take(int(self._scores(own, weights, doc, doc + 1)[0]), doc)
            sides = [(a, b, self._within(nodes, a, b)) for a, b in ((low, doc), (doc + 1, high)) if a < b]
            # a bucket is in both sides: its top bounds either
            todo += sorted(sides, key=lambda s: int((weights * self.top[s[2]]).sum()))
        return out


def _forward(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """The shards: ids and numbers of terms of their documents (by id, null last), postings of the
    vocabulary's terms, and for each of those how many documents hold it."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[key].dataType))] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("n", "seen", "df")] + [T.StructField(c, T.BinaryType()) for c in ("doc", "term", "tf")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        ids: list = []
        n: list[np.ndarray] = []
        found: list[tuple[np.ndarray, ...]] = []
        id_type = None

        def shard() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            doc, term, tf = (np.concatenate(x) for x in zip(*found, strict=True))
            seen, df = np.unique(term, return_counts=True)
            row = [[ids[i] for i in order], np.concatenate(n)[order].tolist(), seen.tolist(), df.tolist(), place[doc].astype("<i4").tobytes(), term.astype("<i4").tobytes(), tf.astype("<i4").tobytes()]
            types = [pa.list_(id_type), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], kind.names)

        for batch in batches:
            id_type, keys = batch.schema.field(0).type, batch.column(0).to_pylist()
            for first, part in slices(batch.column(1).to_pylist()):
                words, bounds = terms(part)
                at = np.minimum(np.searchsorted(asked, words), len(asked) - 1)
                hit = np.flatnonzero(asked[at] == words)
                own = np.repeat(np.arange(len(part)), np.diff(bounds))[hit]
                pair, tf = np.unique(own * len(asked) + at[hit], return_counts=True)
                for begin in range(0, len(part), SHARD_DOCS):  # a slice of short texts may hold more than a shard
                    end = min(begin + SHARD_DOCS, len(part))
                    if ids and (len(ids) + end - begin > SHARD_DOCS or sum(len(f[0]) for f in found) > SHARD_POSTINGS):
                        yield shard()
                        ids, n, found = [], [], []
                    a, b = np.searchsorted(pair, [begin * len(asked), end * len(asked)])
                    found.append((pair[a:b] // len(asked) - begin + len(ids), pair[a:b] % len(asked), tf[a:b]))
                    n.append(np.diff(bounds)[begin:end])
                    ids += keys[first + begin : first + end]
        if ids:
            yield shard()

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, kind)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k best documents of each query: (query_key, rank int, key, score long).

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, only A to Z in lower
    case. A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's length norm
    m = 75 + 25 n N div L, and its score sums weight * (10^9 tf div (1000 tf + 12 m)) over the
    query's terms, repeats included; N documents have terms, L in all. Only scores above 0 are told,
    equal ones in ascending order of the key, null last.

    Null and empty texts have no terms. Repeated document rows are documents each, repeated queries
    are answered each. Empty tables give no rows. Other columns are not read. Only the key and the
    asked terms of a text are kept, so that its length does not matter.

    Two passes: the first writes the shards and counts, over all documents; the second builds the
    treaps of each shard and answers all queries of the block on it, a task's later shards with the
    bounds that its earlier ones gave. A task hands on k rows a query at most. Terms are told by
    64-bit hashes; a word of the documents is taken for another, asked one with a chance of 2^-64.
    """
    spark = docs.sparkSession
    listed = queries.select(F.col(query_key).alias("i"), F.col(query_text).cast("string").alias("t")).where("t is not null")
    blocks = (listed.agg(F.sum(F.length("t"))).first()[0] or 0) // BLOCK_CHARS + 1
    kind = T.StructType([T.StructField("q", T.LongType()), T.StructField(query_key, queries.schema[query_key].dataType), T.StructField("_id", docs.schema[key].dataType), T.StructField("_score", T.LongType())])
    out = kind.names[1], key

    def against(block: int) -> DataFrame | None:
        rows = listed.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect()
        words, bounds = terms([r.t for r in rows])
        vocabulary = np.unique(words)
        if not len(vocabulary):
            return None
        asked = [np.unique(np.searchsorted(vocabulary, words[a:b]), return_counts=True) for a, b in zip(bounds, bounds[1:], strict=False)]
        with scratch(spark):
            shards = stored(_forward(docs, key, text, vocabulary), "shards")
            counts = shards.select(F.explode("n").alias("n")).where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
            df = dict(map(tuple, shards.select(F.explode(F.arrays_zip("seen", "df")).alias("x")).groupBy("x.seen").agg(F.sum("x.df")).collect()))
            n_docs, n_terms = counts[0], counts[1] or 0
            weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
            sent = spark.sparkContext.broadcast((n_docs, n_terms, len(vocabulary), [r.i for r in rows], [(t, many * weight[t]) for t, many in asked]))
            query_type, id_type = (to_arrow_type(kind[c].dataType) for c in (1, 2))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                n_docs, n_terms, n_asked, names, asked = sent.value
                best: list[list[tuple]] = [[] for _ in asked]
                for batch in batches:
                    for i in range(batch.num_rows):
                        ids, n, doc, term, tf = (batch.column(c)[i].as_py() for c in ("ids", "n", "doc", "term", "tf"))
                        doc, term, tf = (np.frombuffer(x, "<i4").astype(np.int64) for x in (doc, term, tf))
                        m = np.array([75 + 25 * x * n_docs // max(n_terms, 1) for x in n], np.int64)
                        treaps = Treaps(len(ids), term, doc, impacts(tf, m[doc]), n_asked)
                        for own, (t, weights) in zip(best, asked, strict=True):
                            more = treaps.best(t, weights, k, sorted(-s for s, *_ in own))
                            if more:
                                own += [(-s, ids[d] is None, ids[d]) for s, d in more]
                                own.sort()
                                del own[k:]
                rows = [(q, names[q], d, -s) for q, own in enumerate(best) for s, _, d in own]
                types = [pa.int64(), query_type, id_type, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], kind.names)

            with small_batches(spark):
                told = shards.select("ids", "n", "doc", "term", "tf").mapInArrow(run, kind)
                best = Window.partitionBy("q").orderBy(F.desc("_score"), F.asc_nulls_last("_id"))
                ranked = told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                return stored(ranked.select(F.col(query_key).alias("_query"), "rank", "_id", "_score"), "ranked", keep=True)

    found = [f for f in map(against, range(blocks)) if f is not None]
    if not found:
        found = [spark.createDataFrame([], kind).select(F.col(query_key).alias("_query"), F.lit(1).alias("rank"), "_id", "_score")]
    return reduce(DataFrame.unionAll, found).select(F.col("_query").alias(out[0]), "rank", F.col("_id").alias(out[1]), F.col("_score").alias("score"))


def oracle_sql(k: int = 20) -> str:
    """DuckDB SQL for the ranking of documents by benchmark items."""
    split = "list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {split} AS terms FROM documents),
        items AS (SELECT row_number() OVER () AS q, item_id, {split} AS terms FROM benchmark),
        totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
        postings AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs),
        asked AS (SELECT q, item_id, term, count(*) AS many FROM (SELECT q, item_id, unnest(terms) AS term FROM items) GROUP BY q, item_id, term),
        scores AS (SELECT q, item_id, d, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms) * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN docs USING (d), totals GROUP BY q, item_id, d, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= {k}"""
