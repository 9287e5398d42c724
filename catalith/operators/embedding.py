"""Objects close to given vectors, and what that says about a question. Vectors come from outside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from catalith.functions import text as X

# Nearest objects of a phrase, the least cosine, and the weight of a seed.
TOP_K, THRESHOLD, WEIGHT = 5, 0.5, 0.8
#: Query vectors that are sent to the tasks at a time.
BLOCK = 1000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _matrix(a: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors of this length, and the vectors."""
    ok = np.flatnonzero(np.array([v is not None and len(v) == size and None not in v for v in a.to_pylist()], bool))
    return ok, np.array(a.take(pa.array(ok)).to_pylist(), float).reshape(len(ok), -1) if len(ok) else np.zeros((0, 0))


def nearest(queries: DataFrame, objects: DataFrame, qid: str, oid: str, vector: str, k: int = TOP_K, least: float = -1.0, block: int = BLOCK) -> DataFrame:
    """qid, oid, cosine, place: the ``k`` most similar objects of each query, exactly; equal cosines by the smaller id.

    Queries go out in blocks of a bounded size, each against all objects; a task keeps the best k of its own rows for each query, only those
    are shuffled. Null and empty vectors match nothing, a zero vector has the cosine 0 to all. Vectors are compared with those of their length."""
    q_type, o_type = queries.schema[qid].dataType.simpleString(), objects.schema[oid].dataType.simpleString()
    q_arrow = to_arrow_type(queries.schema[qid].dataType)
    spark = queries.sparkSession
    out = spark.createDataFrame([], f"qid {q_type}, oid {o_type}, cosine double")
    held: dict[int, list[tuple]] = {}

    def against(rows: list[tuple]) -> DataFrame:
        size = len(rows[0][1])
        wire = spark.sparkContext.broadcast(([r[0] for r in rows], _unit(np.array([r[1] for r in rows], float))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = wire.value
            for b in batches:
                ok, m = _matrix(b.column("v"), size)
                if not len(ok):
                    continue
                oids = b.column("o").take(pa.array(ok))
                c = np.round(q @ _unit(m).T, 12)
                order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(oids.to_numpy(zero_copy_only=False), kind="stable")), c.shape), -c))[:, :k]
                i = np.repeat(np.arange(len(ids)), order.shape[1])
                j = order.ravel()
                keep = c[i, j] >= least
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i[keep]], q_arrow), oids.take(pa.array(j[keep])), pa.array(c[i[keep], j[keep]])], names=["qid", "oid", "cosine"])

        return objects.select(F.col(oid).alias("o"), F.col(vector).alias("v")).mapInArrow(run, f"qid {q_type}, oid {o_type}, cosine double")

    for r in queries.select(qid, vector).toLocalIterator():
        if r[1] and None not in r[1]:
            own = held.setdefault(len(r[1]), [])
            own.append((r[0], r[1]))
            if len(own) == block:
                out = out.unionByName(against(held.pop(len(r[1]))))
    for own in held.values():
        out = out.unionByName(against(own))
    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "oid")
    return out.withColumn("place", F.row_number().over(w).cast("int")).filter(F.col("place") <= k)


def embedding_seeds(phrases: DataFrame, objects: DataFrame, least: float = THRESHOLD, k: int = TOP_K, weight: float = WEIGHT) -> DataFrame:
    """qid, node, weight, reason: phrases(pid, qid, phrase, vector) and objects(node, vector); an object counts once for a question, by its closest phrase (of equals the first)."""
    near = nearest(phrases, objects, "pid", "node", "vector", k, least).select(F.col("qid").alias("p"), F.col("oid").alias("node"), "cosine")
    own = near.join(phrases.select(F.col("pid").alias("p"), "qid", "phrase"), "p").groupBy("qid", "node").agg(F.min(F.struct(-F.col("cosine"), "p", "phrase")).alias("m"))
    cosine = -F.col("m.col1")
    return own.select("qid", "node", (weight * cosine).alias("weight"), F.concat(F.lit("embedding '"), "m.phrase", F.lit("' ("), F.format_string("%.2f", cosine), F.lit(")")).alias("reason"))


# Phrases of a question at most, and from which length on the text after a blank line is a document of its own.
MAX_PHRASES, QUESTION_PART = 80, 400


def question_phrases(questions: DataFrame) -> DataFrame:
    """pid, qid, phrase: the tokens of each question, then its n-grams with blanks, the first MAX_PHRASES different ones; short numbers say nothing."""
    head = F.split_part(F.col("text"), F.lit("\n\n"), F.lit(1))
    part = F.when(F.contains(F.col("text"), F.lit("\n\n")) & (F.length("text") > QUESTION_PART), head).otherwise(F.col("text"))
    tokens = F.filter(X.tokenize(part), lambda t: ~(t.rlike("^[0-9]+$") & (F.length(t) < X.MIN_NUMERIC)))
    said = questions.filter("text is not null").select("qid", tokens.alias("t"))
    grams = F.transform(X.ngrams(F.col("t")), lambda g: F.replace(g, F.lit("_"), F.lit(" ")))
    each = said.select("qid", F.posexplode(F.slice(F.array_distinct(F.concat("t", grams)), 1, MAX_PHRASES)).alias("n", "phrase"))
    return each.select(F.concat(F.col("qid").cast("string"), F.lit(":"), F.format_string("%03d", "n")).alias("pid"), "qid", "phrase")


def object_texts(o) -> DataFrame:
    """node, text to embed of every table, column and term of Objects: names (a column's after its table's), other names, synonyms and description, as words."""
    words = lambda c: F.array_join(X.tokenize(c, keep_stop=True), " ")
    join = lambda *parts: F.regexp_replace(F.btrim(F.concat_ws(" ", *parts)), " +", " ")
    other = words(F.array_join("business", " "))
    t = o.tables.select("node", join(words(F.col("bare")), other, words(F.col("description"))).alias("text"))
    c = o.columns.select("node", join(words(F.element_at(F.split("table_key", "\\."), -1)), words(F.col("name")), other, words(F.col("description"))).alias("text"))
    k = o.terms.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("phrase")), " ").alias("p"), F.max("description").alias("d")).select("node", join(words(F.col("p")), words(F.col("d"))).alias("text"))
    return t.unionByName(c).unionByName(k)
