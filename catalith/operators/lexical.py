"""The inverted index over catalog objects, BM25F documents, and what a question activates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import get_close_matches

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import text as X
from catalith.operators import merge as M
from catalith.session import store, store_all
from catalith.sources.snapshots import Catalog


@dataclass
class Objects:
    """The merged catalog as node tables: tables(node, table_key, bare, description, tags, business, source), columns(node, table_key, col, name, description, tags, business, samples), terms(node, term, phrase), targets(node, target). business: other names of an object (an array)."""

    tables: DataFrame
    columns: DataFrame
    terms: DataFrame
    targets: DataFrame
    edges: DataFrame
    kept: dict[str, object] = field(default_factory=dict, repr=False)

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the index that is written once for this catalog, when it is first asked for."""
        if name not in self.kept:
            self.kept[name] = store(make())
        return self.kept[name]

    def count(self, name: str, df: DataFrame) -> int:
        """The rows of a table, counted once."""
        if name not in self.kept:
            self.kept[name] = df.count()
        return self.kept[name]


def scoped(o: Objects, source: str) -> Objects:
    """Only what a source lists: its tables, their columns, edges with both ends in it, and the terms that still point at something."""
    t = store(o.tables.filter(F.array_contains(F.split("source", ","), source)))
    keys = t.select("table_key")
    c = store(o.columns.join(keys, "table_key", "left_semi"))
    nodes = t.select(F.col("node").alias("target")).unionByName(c.select(F.col("node").alias("target")))
    targets = store(o.targets.join(nodes, "target", "left_semi").select("node", "target"))
    e = o.edges.join(keys.withColumnRenamed("table_key", "from_key"), "from_key", "left_semi").join(keys.withColumnRenamed("table_key", "to_key"), "to_key", "left_semi")
    return Objects(t, c, store(o.terms.join(targets.select("node").distinct(), "node", "left_semi")), targets, store(e.select(*o.edges.columns)))


def objects(cat: Catalog) -> Objects:
    """Written once: every later stage reads them, none parses payloads again."""
    words = M.merge_properties(cat).filter(F.col("property").isin(*BUSINESS_NAMES)).groupBy("table_key").agg(F.array_sort(F.collect_list("value")).alias("business"))
    none = F.array().cast("array<string>")
    t = M.merge_tables(cat).join(words, "table_key", "left").select(F.concat(F.lit("t:"), "table_key").alias("node"), "table_key", F.element_at(F.split("table_key", "\\."), -1).alias("bare"), "description", F.col("tags").alias("tags"), F.coalesce("business", none).alias("business"), "source")
    mc = store(M.merge_columns(cat))
    more = M.column_extras(cat)
    c = mc.join(more, ["table_key", "col"], "left").select(F.concat(F.lit("c:"), "table_key", F.lit("."), "col").alias("node"), "table_key", "col", "name", "description", "samples", "is_primary_key", "data_type", "ord", F.coalesce("tags", F.lit("")).alias("tags"), F.array_compact(F.array("business")).alias("business"))
    k = cat.terms.select("term", F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>"))).alias("p"), "description")
    node = F.concat(F.lit("k:"), "term")
    terms = k.select(node.alias("node"), "term", F.explode("p").alias("phrase"), "description").select("node", "term", F.lower(F.trim("phrase")).alias("phrase"), "description").filter("phrase <> ''").distinct()
    tt = M.term_targets(cat, mc)
    target = F.when(F.col("target_col").isNotNull(), F.concat(F.lit("c:"), "target_table", F.lit("."), "target_col")).otherwise(F.concat(F.lit("t:"), "target_table"))
    return Objects(*store_all(t, c, terms, tt.select(node.alias("node"), target.alias("target")).distinct(), M.distinct_edges(cat)))


def business_tokens() -> Column:
    return F.flatten(F.transform("business", X.name_tokens))


def postings(o: Objects) -> DataFrame:
    """token, node, weight: the largest weight with which a token stands for an object."""
    part = lambda df, tokens, w: df.select("node", F.explode(tokens).alias("token"), F.lit(w).alias("weight"))
    t, c, k = o.tables, o.columns, o.terms
    rows = (
        part(t, X.name_tokens(F.col("bare")), X.NAME_WEIGHT).unionByName(part(t, X.tokenize(F.col("description")), X.DESC_WEIGHT)).unionByName(part(t, X.tokenize(F.regexp_replace("tags", ",", " ")), X.TAG_WEIGHT))
        .unionByName(part(c, X.name_tokens(F.col("name")), X.NAME_WEIGHT)).unionByName(part(c, X.tokenize(F.col("description")), X.DESC_WEIGHT)).unionByName(part(c, X.tokenize(F.regexp_replace("tags", ",", " ")), X.TAG_WEIGHT))
        .unionByName(part(t, business_tokens(), X.BUSINESS_WEIGHT)).unionByName(part(c, business_tokens(), X.BUSINESS_WEIGHT))
        .unionByName(part(k, X.name_tokens(F.col("phrase")), X.NAME_WEIGHT)).unionByName(part(k, X.tokenize(F.col("description")), X.TERM_DESC_WEIGHT))
    )
    return rows.groupBy("token", "node").agg(F.max("weight").alias("weight"))


def node_count(o: Objects) -> int:
    """How many tables, columns and terms there are, at least 1."""
    nodes = o.tables.select("node").unionByName(o.columns.select("node")).unionByName(o.terms.select("node").distinct())
    return max(1, o.count("nodes", nodes))


def idf(post: DataFrame, n: int) -> DataFrame:
    """token, df, idf: rarity between IDF_FLOOR and about 1 among n objects."""
    return post.groupBy("token").agg(F.count("*").alias("df")).select("token", "df", F.greatest(F.lit(X.IDF_FLOOR), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) / F.log(F.lit(n + 1.0))).alias("idf"))


def names(o: Objects) -> DataFrame:
    """gram, node: whole names of objects, also without stopwords where two or more words remain."""
    n = o.tables.select("node", F.col("bare").alias("name")).unionByName(o.columns.select("node", "name"))
    full, rest = X.tokenize(F.col("name"), keep_stop=True), X.tokenize(F.col("name"))
    rows = n.select("node", F.array_join(full, "_").alias("a"), F.when(F.size(rest) >= 2, F.array_join(rest, "_")).alias("b"))
    return rows.select("node", F.explode(F.array_compact(F.array("a", "b"))).alias("gram")).filter("gram <> ''").distinct()


def values(o: Objects) -> DataFrame:
    """gram, n_words, value, node of the sample values that are evidence: not short, not numbers."""
    v = o.columns.select("node", F.explode("samples").alias("v")).select("node", F.lower(F.trim("v")).alias("value"))
    w = X.words(F.col("value"))
    ok = (F.length("value") >= X.MIN_VALUE_CHARS) & ~F.regexp_replace("value", "[.-]", "").rlike("^[0-9]*$") & (F.size(w) > 0) & F.exists(w, lambda x: ~x.rlike("^[0-9]+$")) & ((F.size(w) > 1) | (F.length(F.get(w, F.lit(0))) >= X.MIN_VALUE_CHARS))
    return v.filter(ok).select(F.array_join(w, "_").alias("gram"), F.size(w).alias("n_words"), "value", "node").distinct()


def question_words(q: DataFrame) -> DataFrame:
    """qid, text, tokens, raw, words of questions(qid, text)."""
    return q.select("qid", "text", X.tokenize(F.col("text")).alias("tokens"), X.tokenize(F.col("text"), keep_stop=True).alias("raw"), X.words(F.col("text")).alias("words"))


def token_forms(q: DataFrame, min_numeric: int = X.MIN_NUMERIC) -> DataFrame:
    """qid, form, weight, ord, why: each form of a question's tokens once, as at its first occurrence."""
    f = q.select("qid", F.posexplode(X.query_forms(F.col("tokens"), min_numeric)).alias("ord", "f"))
    return f.groupBy("qid", "f.form").agg(F.min(F.struct("ord", "f.weight", "f.why")).alias("m")).select("qid", "form", "m.weight", "m.ord", "m.why")


def _fuzzy(forms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Forms without a posting to the closest tokens, by the ratio of matching blocks.

    Tokens are prefiltered by length (lossless for the cutoff) and first joined on a shared pair of letters, which a ratio above the cutoff needs for words of this length."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2))))
    a = forms.select("form").distinct().filter(F.length("form") >= X.FUZZY_MIN).withColumn("p", F.explode(pairs(F.col("form"))))
    b = vocab.filter(F.length("token") >= 2).withColumn("p", F.explode(pairs(F.col("token"))))
    near = a.join(b, "p").filter(2 * F.least(F.length("form"), F.length("token")) >= X.FUZZY_CUTOFF * (F.length("form") + F.length("token"))).groupBy("form", "token").agg(F.count("*").alias("n"))

    def best(batches):
        for b in batches:
            forms, tokens = b.column("form").to_pylist(), b.column("token").to_pylist()
            keep = [bool(get_close_matches(f, [t], n=1, cutoff=X.FUZZY_CUTOFF)) for f, t in zip(forms, tokens)]
            from difflib import SequenceMatcher

            ratio = [SequenceMatcher(None, t, f).ratio() if k else 0.0 for f, t, k in zip(forms, tokens, keep)]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("form").filter(mask), b.column("token").filter(mask), pa.array(ratio).filter(mask)], names=["form", "close", "ratio"])

    scored = near.select("form", "token").mapInArrow(best, "form string, close string, ratio double")
    w = Window.partitionBy("form").orderBy(F.desc("ratio"), F.desc("close"))
    return scored.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= X.FUZZY_MATCHES).select("form", "close")


def said_phrases(questions: DataFrame, o: Objects) -> DataFrame:
    """qid, node, phrase of the glossary phrases in each question: an equi join on a phrase's first word, then the exact test."""
    low = questions.filter("text is not null").select("qid", F.lower("text").alias("q"), F.explode(F.array_distinct(X.words(F.col("text")))).alias("w"))
    first = o.terms.select("node", "phrase", F.get(X.words(F.col("phrase")), F.lit(0)).alias("w")).filter("w is not null")
    return low.join(first, "w").filter(F.expr("regexp_like(q, concat('(?<![a-z0-9])\\\\Q', phrase, '\\\\E(?![a-z0-9])'))")).select("qid", "node", "phrase").distinct()


def matched_terms(questions: DataFrame, o: Objects) -> DataFrame:
    """qid, term (the phrase as the question has it), target: the table or column (or null) that each glossary phrase in a question stands for."""
    target = F.expr("substring(target, 3)")
    return said_phrases(questions, o).join(o.targets, "node", "left").select("qid", F.col("phrase").alias("term"), target.alias("target")).distinct()


def activate(questions: DataFrame, o: Objects, fuzzy: bool = True, post: DataFrame | None = None, rarity: bool = True, names_with_stopwords: bool = True, min_numeric: int = X.MIN_NUMERIC, why: bool = True) -> DataFrame:
    """qid, node, weight, reasons (only with ``why``): what questions(qid, text) say about the catalog.

    rarity: scale tokens by it; names_with_stopwords: whole names are also looked for among all words; min_numeric: digits of a number that counts.
    Four stages add up: glossary phrases and their targets, sample values, whole names, single tokens with their forms (scaled by rarity; a
    form without a posting stands for close tokens). post: the postings, if they are at hand. reasons are in the order of the stages. Null questions activate nothing."""
    q = question_words(questions.filter("text is not null"))
    low = q.select("qid", F.lower("text").alias("q"), "words")
    said = said_phrases(questions, o)
    stage = lambda n, ord_, why: F.struct(F.lit(n).alias("stage"), ord_.cast("long").alias("ord"), why.alias("why"))
    part = lambda df, node, w, s: df.select("qid", node.alias("node"), w.cast("double").alias("weight"), s.alias("s"))
    long_first = -F.length("phrase")
    a = part(said, F.col("node"), F.lit(X.PHRASE_WEIGHT), stage(1, long_first, F.concat(F.lit("glossary phrase '"), "phrase", F.lit("'"))))
    b = part(said.join(o.targets, "node"), F.col("target"), F.lit(X.TARGET_WEIGHT), stage(1, long_first, F.concat(F.lit("glossary target of '"), "phrase", F.lit("'"))))
    v = o.keep("values", lambda: values(o))
    grams = low.select("qid", "q", F.explode(F.array_distinct(X.ngrams(F.col("words"), 1, X.MAX_VALUE_WORDS))).alias("gram"))
    short = grams.join(v.filter(F.col("n_words") <= X.MAX_VALUE_WORDS), "gram").select("qid", "node", "value").distinct()
    lead = v.filter(F.col("n_words") > X.MAX_VALUE_WORDS).withColumn("gram", F.array_join(F.slice(F.split("gram", "_"), 1, X.MAX_VALUE_WORDS), "_"))
    long_ = grams.join(lead, "gram").filter(F.expr("regexp_like(q, concat('(?<![a-z0-9])\\\\Q', value, '\\\\E(?![a-z0-9])'))")).select("qid", "node", "value").distinct()
    val = short.unionByName(long_).distinct()
    c = part(val, F.col("node"), F.lit(X.VALUE_WEIGHT), stage(2, F.lit(0), F.concat(F.lit("value '"), "value", F.lit("' in question"))))
    g = q.select("qid", F.posexplode(F.concat(X.ngrams(F.col("tokens")), X.ngrams(F.col("raw"))) if names_with_stopwords else X.ngrams(F.col("tokens"))).alias("ord", "gram")).join(o.keep("names", lambda: names(o)), "gram").groupBy("qid", "node").agg(F.min(F.struct("ord", "gram")).alias("m"))
    d = part(g, F.col("node"), F.lit(X.NGRAM_WEIGHT), stage(3, F.col("m.ord"), F.concat(F.lit("n-gram '"), F.col("m.gram"), F.lit("' == name"))))
    post = o.keep("post", lambda: postings(o)) if post is None else post
    rare = o.keep("rare", lambda: idf(post, node_count(o)))
    scaled = post.join(rare, "token").select("token", "node", (F.col("weight") * (F.col("idf") if rarity else F.lit(1.0))).alias("w"))
    forms = store(token_forms(q, min_numeric))
    hits = forms.join(scaled.withColumnRenamed("token", "form"), "form")
    e = part(hits, F.col("node"), F.col("weight") * F.col("w"), stage(4, F.col("ord"), F.col("why")))
    rows = a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)
    if fuzzy:
        lost = forms.join(rare.select(F.col("token").alias("form")), "form", "left_anti")
        f = lost.join(_fuzzy(lost, rare.select("token")), "form").join(scaled.withColumnRenamed("token", "close"), "close")
        rows = rows.unionByName(part(f, F.col("node"), F.lit(X.FUZZY_WEIGHT) * F.col("w"), stage(4, F.col("ord"), F.concat(F.lit("fuzzy '"), "form", F.lit("'~'"), "close", F.lit("'")))))
    if not why:
        return rows.groupBy("qid", "node").agg(F.sum("weight").alias("weight"))
    out = rows.groupBy("qid", "node").agg(F.sum("weight").alias("weight"), F.collect_list("s").alias("s"))
    return out.select("qid", "node", "weight", F.transform(F.array_sort("s"), lambda x: x["why"]).alias("reasons"))


# Properties that hold other names of a table (of a column the last one only), and what a token in each field of a table's document weighs.
BUSINESS_NAMES = ("dbt_name", "business_name")
FIELD_WEIGHT = {"name": 1.0, "columns": 1.0, "business": 0.9, "tags": 0.5, "desc": 0.35}


def table_documents(o: Objects) -> DataFrame:
    """table_key, field, token with repeats."""
    t, c = o.tables, o.columns
    part = lambda df, field, tokens: df.select("table_key", F.lit(field).alias("field"), F.explode(tokens).alias("token"))
    return (
        part(t, "name", X.name_tokens(F.col("bare"))).unionByName(part(t, "desc", X.tokenize(F.col("description")))).unionByName(part(t, "tags", X.tokenize(F.regexp_replace("tags", ",", " "))))
        .unionByName(part(c, "columns", X.name_tokens(F.col("name")))).unionByName(part(c, "desc", X.tokenize(F.col("description")))).unionByName(part(c, "tags", X.tokenize(F.regexp_replace("tags", ",", " "))))
        .unionByName(part(t, "business", business_tokens())).unionByName(part(c, "business", business_tokens()))
    )


def bm25f(questions: DataFrame, o: Objects, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, table_key, score of the tables that share a token with a question."""
    n = o.count("tables", o.tables)
    tf = o.keep("tf", lambda: table_documents(o).groupBy("table_key", "field", "token").agg(F.count("*").alias("tf")))
    length = tf.groupBy("table_key", "field").agg(F.sum("tf").alias("len"))
    avg = length.groupBy("field").agg((F.sum("len") / max(n, 1)).alias("avg"))
    df = tf.groupBy("token").agg(F.countDistinct("table_key").alias("df")).select("token", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))
    weight = F.create_map(*[x for k, w in FIELD_WEIGHT.items() for x in (F.lit(k), F.lit(w))])
    each = tf.join(length, ["table_key", "field"]).join(F.broadcast(avg), "field")  # five fields
    norm = lambda: each.groupBy("table_key", "token").agg(F.sum(weight[F.col("field")] * F.col("tf") / (1.0 - b + b * F.col("len") / F.col("avg"))).alias("t"))
    forms = question_words(questions.filter("text is not null")).select("qid", F.explode(X.query_forms(F.col("tokens"))).alias("f")).groupBy("qid", F.col("f.form").alias("token")).agg(F.max("f.weight").alias("qw"))
    weighed = o.keep(f"bm25f {b}", lambda: norm().join(df, "token"))
    return forms.join(weighed, "token").groupBy("qid", "table_key").agg(F.sum(F.col("qw") * F.col("idf") * F.col("t") * (k1 + 1.0) / (k1 + F.col("t"))).alias("score"))


def bm25_single(questions: DataFrame, o: Objects, method: str = "lucene", k1: float = 1.2, b: float = 0.75, delta: float = 1.0) -> DataFrame:
    """qid, table_key, score of plain BM25 (``lucene``) or BM25+ over one text of a table: names three times, business names and tags and descriptions once."""
    repeat = {"name": 3, "columns": 3, "business": 3, "tags": 1, "desc": 1}
    times = F.create_map(*[x for k, n in repeat.items() for x in (F.lit(k), F.lit(n))])
    tf = table_documents(o).groupBy("table_key", "token").agg(F.sum(times[F.col("field")]).alias("tf"))
    n = o.count("tables", o.tables)
    length = tf.groupBy("table_key").agg(F.sum("tf").alias("len"))
    avg = (length.agg(F.sum("len")).first()[0] or 0) / max(n, 1) or 1.0
    plus = method == "bm25+"
    df = tf.groupBy("token").agg(F.count("*").alias("df")).select("token", (F.log((n + 1.0) / F.col("df")) if plus else F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).alias("idf"))
    part = F.col("tf") * (k1 + 1 if plus else 1.0) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avg)) + (delta if plus else 0.0)
    forms = question_words(questions.filter("text is not null")).select("qid", F.explode(X.query_forms(F.col("tokens"))).alias("f")).groupBy("qid", F.col("f.form").alias("token")).agg(F.max("f.weight").alias("qw"))
    return forms.join(tf, "token").join(length, "table_key").join(df, "token").groupBy("qid", "table_key").agg(F.sum(F.col("qw") * F.col("idf") * part).alias("score"))


def ranks(scores: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "table_key"))


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """qid, table_key, score: reciprocal ranks added up over rankings(qid, table_key, score)."""
    parts = [r.select("qid", "table_key", (1.0 / (F.lit(k) + ranks(r))).alias("p")) for r in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("qid", "table_key").agg(F.sum("p").alias("score"))
