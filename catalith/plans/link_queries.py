"""Queries of inference, families, text functions, the lexical index and ranking, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import text as X
from catalith.operators import families as FA
from catalith.operators.embedding import nearest
from catalith.operators import infer as I
from catalith.operators import lexical as L
from catalith.operators import merge as M
from catalith.operators import paths as P
from catalith.operators import ranking as R
from catalith.plans import link as K
from catalith.plans.sqltext import CATALOG, COST, strings
from catalith.session import ensure_checkpoint_dir, store, store_all, table
from catalith.sources.snapshots import catalog


#: The last catalog and its index, by application and the state of the files it was built from.
_INDEX: dict[str, tuple] = {}


def _state(spark: SparkSession, sf: str) -> tuple:
    """Path, length and time of the files that a catalog is built from."""
    out = [spark.sparkContext.applicationId, sf]
    for name in ("snapshots", "connections"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(out)


def _cat(spark: SparkSession, sf: str):
    """The merged catalog. Like a linker that stays in memory it is built once; other files, files that changed, or a shared folder that was emptied build it anew."""
    now = _state(spark, sf)
    if _INDEX.get("state") != now or not spark._jvm.org.apache.hadoop.fs.Path(_INDEX["mark"]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(_INDEX["mark"])):
        cat = catalog(table(spark, sf, "snapshots"), table(spark, sf, "connections"))
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
        mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()
        _INDEX.clear()
        _INDEX.update(state=now, catalog=cat, mark=mark.toString())
    return _INDEX["catalog"]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select(F.col("item_id").alias("qid"), "text")


def catalog_objects(spark: SparkSession, sf: str) -> L.Objects:
    """The index of the merged catalog, built once like it."""
    cat = _cat(spark, sf)
    if "objects" not in _INDEX:
        _INDEX["objects"] = L.objects(cat)
    return _INDEX["objects"]


def infer_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return I.by_name(M.merge_columns(_cat(spark, sf))).select("from_key", "from_col", "to_key", "to_col")


def infer_shared_key(spark: SparkSession, sf: str) -> DataFrame:
    return I.by_shared_key(M.merge_columns(_cat(spark, sf))).select("from_key", "from_col", "to_key", "to_col", "confidence")


def infer_edges(spark: SparkSession, sf: str) -> DataFrame:
    cat = _cat(spark, sf)
    return I.infer(M.merge_columns(cat), cat.edges)


def _days(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyyMMdd")
    return table(spark, sf, "events").select(F.concat(F.lit("raw."), F.col("event_type"), F.lit("_"), day).alias("name"))


def family_shards(spark: SparkSession, sf: str) -> DataFrame:
    return FA.fold_shards(_days(spark, sf), "name")


def family_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "snapshots").groupBy(FA.signature(F.col("source")).alias("signature")).agg(F.countDistinct("source").alias("n_sources"))


def family_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Column overlap of the pairs of tables that a relation joins."""
    cat = _cat(spark, sf)
    cols = M.merge_columns(cat).groupBy("table_key").agg(F.collect_set("col").alias("cols"))
    pairs = M.relations(M.distinct_edges(cat)).select("u", "v")
    a, b = cols.select(F.col("table_key").alias("u"), F.col("cols").alias("a")), cols.select(F.col("table_key").alias("v"), F.col("cols").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", F.round(FA.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def text_tokens(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "documents").select("doc_id", F.posexplode(X.tokenize(F.col("text"))).alias("pos", "token"))
    return q.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def text_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    t = questions(spark, sf).select(F.explode(X.tokenize(F.col("text"))).alias("token")).distinct()
    return t.select("token", X.lemma(F.col("token")).alias("lemma"))


def text_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf).select("qid", F.posexplode(X.ngrams(X.tokenize(F.col("text")))).alias("pos", "gram"))
    return q.groupBy("gram").agg(F.count("*").alias("n"), F.min("qid").alias("first_qid"))


def lexical_postings(spark: SparkSession, sf: str) -> DataFrame:
    return L.postings(catalog_objects(spark, sf))


def lexical_idf(spark: SparkSession, sf: str) -> DataFrame:
    o = catalog_objects(spark, sf)
    return L.idf(L.postings(o), L.node_count(o)).select("token", "df", F.round("idf", 6).alias("idf"))


def lexical_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """Mention edges of the tokens that are no hubs, by token."""
    p = L.postings(catalog_objects(spark, sf))
    return p.groupBy("token").agg(F.count("*").alias("n"), F.round(F.sum(F.col("weight") * X.MENTION_SCALE), 6).alias("mass")).filter(F.col("n") <= X.HUB_POSTINGS)


def lexical_values(spark: SparkSession, sf: str) -> DataFrame:
    return L.values(catalog_objects(spark, sf))


def _token_seeds(q: DataFrame, o: L.Objects) -> DataFrame:
    post = o.keep("post", lambda: L.postings(o))
    scaled = post.join(L.idf(post, L.node_count(o)), "token").select("token", "node", (F.col("weight") * F.col("idf")).alias("w"))
    forms = L.token_forms(L.question_words(q))
    return forms.join(scaled, forms["form"] == scaled["token"]).groupBy("qid", "node").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("weight"))


def seeds_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token evidence of each question: weight by object, without the fuzzy fallback."""
    return _token_seeds(questions(spark, sf), catalog_objects(spark, sf))


def seeds_names(spark: SparkSession, sf: str) -> DataFrame:
    o = catalog_objects(spark, sf)
    q = L.question_words(questions(spark, sf))
    g = q.select("qid", F.explode(F.concat(X.ngrams(F.col("tokens")), X.ngrams(F.col("raw")))).alias("gram")).distinct()
    return g.join(L.names(o), "gram").select("qid", "node").distinct()


def activation(spark: SparkSession, sf: str) -> DataFrame:
    a = L.activate(questions(spark, sf), catalog_objects(spark, sf))
    return a.select("qid", "node", F.round("weight", 6).alias("weight"), F.array_join("reasons", "; ").alias("reasons"))


def bm25f(spark: SparkSession, sf: str) -> DataFrame:
    return L.bm25f(questions(spark, sf), catalog_objects(spark, sf)).select("qid", "table_key", F.round("score", 6).alias("score"))


def fused(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal-rank fusion of BM25F and of the token evidence on tables."""
    o, q = catalog_objects(spark, sf), questions(spark, sf)
    sparse, tokens = store_all(L.bm25f(q, o).withColumn("score", F.round("score", 6)), _token_seeds(q, o))
    own = tokens.filter("node like 't:%'").select("qid", F.expr("substring(node, 3)").alias("table_key"), F.col("weight").alias("score"))
    return L.fuse([sparse, own]).select("qid", "table_key", F.round("score", 6).alias("score"))


def rank_specificity(spark: SparkSession, sf: str) -> DataFrame:
    return R.specificity(catalog_objects(spark, sf)).select("node", F.round("spec", 6).alias("spec"))


def rank_transition(spark: SparkSession, sf: str) -> DataFrame:
    """Transition probabilities between tables and columns (without token nodes)."""
    o = catalog_objects(spark, sf)
    e = R.graph_edges(o, L.postings(o)).filter("etype in ('contains', 'relation')")
    return R.transition(e).select("u", "v", F.round("p", 6).alias("p"))


def rank_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    o = catalog_objects(spark, sf)
    post = o.keep("post", lambda: L.postings(o))
    seeds, edges = store_all(L.activate(questions(spark, sf), o, post=post), R.graph_edges(o, post))
    return R.pagerank(edges, seeds.select("qid", "node", "weight")).select("qid", "node", F.round("score", 8).alias("score"))


def rank_pagerank_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """PageRank of tables and columns for the token seeds of each question, to five digits: what SQL can state of the walk."""
    o = catalog_objects(spark, sf)
    post = o.keep("post", lambda: L.postings(o))
    step = o.keep("step weight", lambda: R.transition(R.graph_edges(o, post)))
    out = R.pagerank(None, _token_seeds(questions(spark, sf), o), step=step, kinds="tc", least=4e-6)  # what is less is 0 to five digits
    return out.select("qid", "node", F.round("score", 5).alias("score")).filter("score > 0")


def activation_exact(spark: SparkSession, sf: str) -> DataFrame:
    """What each question says about the catalog, without the fuzzy stage: glossary phrases and targets, values, names and tokens added up."""
    a = L.activate(questions(spark, sf), catalog_objects(spark, sf), fuzzy=False)
    return a.select("qid", "node", F.round("weight", 5).alias("weight"))


def rank_table_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Table scores of the token seeds themselves: own, best three columns and the rest, with the direct bonus."""
    o = catalog_objects(spark, sf)
    seeds = store(_token_seeds(questions(spark, sf), o))
    scores = R.direct_evidence(R.table_scores(seeds.withColumnRenamed("weight", "score"), o.columns), seeds, o.columns)
    return R.relative(scores).select("qid", "table_key", F.round("evidence", 5).alias("evidence"))


def _joinable(spark: SparkSession, sf: str) -> DataFrame:
    return store(M.relations(M.distinct_edges(_cat(spark, sf)), [k for k in M.JOIN_COST if k != "lineage"]))


def paths_from_table(spark: SparkSession, sf: str) -> DataFrame:
    """All join paths of up to three hops from the first table that has a relation: the part of paths_from_tables that SQL checks."""
    pairs = _joinable(spark, sf)
    first = pairs.agg(F.min("u").alias("u")).first()
    p = P.paths_within(pairs, first.u if first else "", 3)
    return p.select(F.array_join("path", " > ").alias("path"), F.round("cost", 4).alias("cost"))


def paths_from_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All join paths from every table that has a relation, up to the operator's cutoff."""
    return P.paths_within(_joinable(spark, sf)).select(F.array_join("path", " > ").alias("path"), F.round("cost", 4).alias("cost"))


def link_tables(spark: SparkSession, sf: str) -> DataFrame:
    return K.link(questions(spark, sf), catalog_objects(spark, sf)).tables.select("qid", "table_key", F.round("score", 6).alias("score"), "anchor")


def link_ddl(spark: SparkSession, sf: str) -> DataFrame:
    cat, o, q = _cat(spark, sf), catalog_objects(spark, sf), questions(spark, sf)
    return K.render(K.link(q, o), q, o, M.merge_tables(cat))


def embedding_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of all vectors for every vector whose id is divisible by 100."""
    e = table(spark, sf, "embeddings")
    return nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding").select("qid", "place", "oid", F.round("cosine", 5).alias("cosine"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "infer_by_name": infer_by_name, "infer_shared_key": infer_shared_key, "infer_edges": infer_edges,
    "family_shards": family_shards, "family_signatures": family_signatures, "family_jaccard": family_jaccard,
    "text_tokens": text_tokens, "text_lemmas": text_lemmas, "text_ngrams": text_ngrams,
    "lexical_postings": lexical_postings, "lexical_idf": lexical_idf, "lexical_hubs": lexical_hubs, "lexical_values": lexical_values,
    "seeds_tokens": seeds_tokens, "seeds_names": seeds_names, "activation": activation, "bm25f": bm25f, "fused": fused,
    "rank_specificity": rank_specificity, "rank_transition": rank_transition, "rank_pagerank": rank_pagerank, "rank_pagerank_tokens": rank_pagerank_tokens, "activation_exact": activation_exact, "rank_table_evidence": rank_table_evidence,
    "paths_from_table": paths_from_table, "paths_from_tables": paths_from_tables, "link_tables": link_tables, "link_ddl": link_ddl, "embedding_nearest": embedding_nearest,
}

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _tok(expr: str, keep: bool = False) -> str:
    stop = "" if keep else f" AND t NOT IN ({_STOP})"
    return f"[t for t in string_split_regex(lower(regexp_replace(coalesce({expr}, ''), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+') if (len(t) >= 2 OR regexp_matches(t, '^[0-9]$')){stop}]"


def shard(expr: str) -> str:
    return f"regexp_replace(lower(trim({expr})), '^(.*?)_?(\\d{{8}}|\\d{{6}}|(19|20)\\d{{2}})$', '\\1_*')"


def _lemma(t: str) -> str:
    return f"CASE WHEN len({t}) > 4 AND {t} LIKE '%ies' THEN {t}[:-4] || 'y' WHEN len({t}) > 4 AND {t} LIKE '%ses' THEN {t}[:-3] WHEN len({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN {t}[:-2] ELSE {t} END"


_ABBR = "abbr(short, long) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in X.ABBREVIATIONS.items()) + ")"
_GRAMS = "[array_to_string(l[i:i + n - 1], '_') for i in range(1, len(l) - n + 2)]"


def _grams(expr: str, lo: int = 2, hi: int = 3) -> str:
    return "list_concat(" + ", ".join(f"[array_to_string({expr}[i:i + {n - 1}], '_') for i in range(1, greatest(len({expr}) - {n} + 2, 1))]" for n in range(lo, hi + 1)) + ")"


_KEYED = """, pc AS (SELECT table_key, col, is_primary_key, ord, array_to_string(string_split(table_key, '.')[:-2], '.') AS grp, string_split(table_key, '.')[-1] AS bare,
      CASE WHEN len(regexp_extract(col, '^(.+?)_?(id|key|code|number|no|num)$', 1)) >= 3 AND regexp_extract(col, '^(.+?)_?(id|key|code|number|no|num)$', 1) NOT IN ('id','key','code','number','name','value','type','date','time','year','month','day','status')
        THEN regexp_extract(col, '^(.+?)_?(id|key|code|number|no|num)$', 1) END AS stem FROM mc),
    nm AS (SELECT DISTINCT table_key, grp, regexp_replace(bare, '_\\*$', '') AS n FROM pc),
    stems AS (SELECT table_key, grp, n AS stem FROM nm UNION SELECT table_key, grp, n[:-2] FROM nm WHERE n LIKE '%s' UNION SELECT table_key, grp, n[:-4] || 'y' FROM nm WHERE n LIKE '%ies'),
    r1 AS (SELECT a.table_key AS from_key, a.col AS from_col, s.table_key AS to_key, arg_min(b.col, b.ord) AS to_col FROM pc a JOIN stems s ON s.grp = a.grp AND s.stem = a.stem AND s.table_key <> a.table_key
      JOIN pc b ON b.table_key = s.table_key AND (b.col IN ('id', a.col, a.stem || '_id', a.stem || 'id') OR b.is_primary_key) GROUP BY ALL),
    hold AS (SELECT * FROM pc WHERE col NOT IN ('id','key','code','number','name','value','type','date','time','year','month','day','status') AND NOT contains(col, '.') AND (regexp_matches(col, '^(.+?)_?(id|key|code|number|no|num)$') OR is_primary_key)),
    hs AS (SELECT grp, col, count(*) AS n, min(table_key) FILTER (is_primary_key) AS holder FROM hold GROUP BY ALL HAVING count(*) BETWEEN 2 AND 12),
    hh AS (SELECT h.grp, h.col, h.table_key, holder FROM hold h JOIN hs USING (grp, col)),
    r2 AS (SELECT table_key AS from_key, col AS from_col, holder AS to_key, col AS to_col, 0.7::DOUBLE AS confidence FROM hh WHERE holder IS NOT NULL AND table_key <> holder
      UNION ALL SELECT a.table_key, a.col, b.table_key, b.col, 0.4::DOUBLE FROM hh a JOIN hh b ON a.grp = b.grp AND a.col = b.col AND a.table_key < b.table_key WHERE a.holder IS NULL)
"""
_LEX = ", " + _ABBR + f""",
    o AS (SELECT table_key, min(rk * 100000 + pos) AS ord FROM ct GROUP BY ALL),
    mt AS (SELECT table_key, string_split(table_key, '.')[-1] AS bare, arg_min(description, rk * 100000 + pos) FILTER (description IS NOT NULL) AS description FROM ct GROUP BY ALL),
    tags AS (SELECT DISTINCT table_key, unnest({strings('t', 'tags')}) AS tag FROM ct),
    md AS (SELECT table_key, col, mc.name, arg_min(nullif(c->>'description', ''), (rk * 1000 + pos) * 1000 + cpos) FILTER (nullif(c->>'description', '') IS NOT NULL) AS description FROM cc JOIN mc USING (table_key, col) GROUP BY table_key, col, mc.name),
    ph AS (SELECT DISTINCT term, lower(trim(p)) AS phrase FROM (SELECT term, unnest(list_concat([term], coalesce({strings('g', 'synonyms')}, []))) AS p FROM cg) WHERE trim(p) <> ''),
    named AS (SELECT 't:' || table_key AS node, table_key, 'name' AS field, bare AS name FROM mt UNION ALL SELECT 'c:' || table_key || '.' || col, table_key, 'columns', name FROM mc UNION ALL SELECT 'k:' || term, NULL, 'term', phrase FROM ph),
    nt AS (SELECT node, table_key, field, unnest({_tok('name', True)}) AS token FROM named),
    nx AS (SELECT * FROM nt UNION ALL SELECT node, table_key, field, long FROM nt JOIN abbr ON short = token UNION ALL SELECT node, table_key, field, {_lemma('token')} FROM nt WHERE {_lemma('token')} <> token),
    dt AS (SELECT 't:' || table_key AS node, table_key, 'desc' AS field, 0.35 AS w, unnest({_tok('description')}) AS token FROM mt
      UNION ALL SELECT 'c:' || table_key || '.' || col, table_key, 'desc', 0.35, unnest({_tok('description')}) FROM md
      UNION ALL SELECT 't:' || table_key, table_key, 'tags', 0.5, unnest({_tok('tag')}) FROM tags
      UNION ALL SELECT 'c:' || table_key || '.' || col, table_key, 'tags', 0.5, unnest({_tok('tag')}) FROM (SELECT DISTINCT table_key, col, unnest({strings('c', 'tags')}) AS tag FROM cc)
      UNION ALL SELECT 'k:' || term, NULL, 'term', 0.3, unnest({_tok('description')}) FROM cg),
    post AS (SELECT token, node, CAST(max(w) AS DOUBLE) AS weight FROM (SELECT token, node, 1.0 AS w FROM nx UNION ALL SELECT token, node, w FROM dt) GROUP BY ALL),
    nn AS (SELECT (SELECT count(*) FROM mt) + (SELECT count(*) FROM mc) + (SELECT count(DISTINCT term) FROM cg) AS n),
    rare AS (SELECT token, count(*) AS df, greatest(0.05, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) / ln(any_value(n) + 1)) AS idf FROM post, nn GROUP BY token),
    q AS (SELECT item_id AS qid, text, {_tok('text')} AS tokens, {_tok('text', True)} AS raw FROM eval_items),
    qt AS (SELECT qid, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM q),
    said AS (SELECT * FROM qt WHERE NOT (regexp_matches(t, '^[0-9]+$') AND len(t) < 4)),
    forms0 AS (SELECT qid, t AS form, 1.0 AS w, i * 100 AS ord FROM said UNION ALL SELECT qid, {_lemma('t')}, 0.8, i * 100 + 1 FROM said WHERE {_lemma('t')} <> t
      UNION ALL SELECT qid, long, 0.8, i * 100 + 2 FROM said JOIN abbr ON short = t UNION ALL SELECT qid, short, 0.8, i * 100 + 3 FROM said JOIN abbr ON long = t),
    forms AS (SELECT qid, form, arg_min(w, ord) AS w, max(w) AS maxw FROM forms0 GROUP BY ALL),
    tokseed AS (SELECT qid, node, round(CAST(sum(w * weight * idf) AS DOUBLE), 6) AS weight FROM forms JOIN post ON form = token JOIN rare USING (token) GROUP BY ALL)
"""
_BM = """, docs AS (SELECT table_key, field, token FROM nx WHERE table_key IS NOT NULL UNION ALL SELECT table_key, field, token FROM dt WHERE table_key IS NOT NULL),
    nd AS (SELECT count(*) AS n FROM mt), tf AS (SELECT table_key, field, token, count(*) AS tf FROM docs GROUP BY ALL), ln AS (SELECT table_key, field, count(*) AS len FROM docs GROUP BY ALL),
    av AS (SELECT field, sum(len) / (SELECT n FROM nd) AS avg FROM ln GROUP BY ALL), dfq AS (SELECT token, ln(((SELECT n FROM nd) - count(DISTINCT table_key) + 0.5) / (count(DISTINCT table_key) + 0.5) + 1.0) AS idf FROM tf GROUP BY ALL),
    nrm AS (SELECT table_key, token, sum(CASE field WHEN 'name' THEN 1.0 WHEN 'columns' THEN 1.0 WHEN 'tags' THEN 0.5 ELSE 0.35 END * tf / (0.25 + 0.75 * len / avg)) AS t FROM tf JOIN ln USING (table_key, field) JOIN av USING (field) GROUP BY ALL),
    bm AS (SELECT qid, table_key, round(CAST(sum(maxw * idf * t * 2.2 / (1.2 + t)) AS DOUBLE), 6) AS score FROM forms f JOIN nrm ON nrm.token = f.form JOIN dfq ON dfq.token = f.form GROUP BY ALL)
"""

_TARGETS = f""", tsaid AS (SELECT DISTINCT term, array_to_string([lower(trim(translate(s, '"`[]', ''))) for s in string_split(x, '.')], '.') AS k FROM (SELECT term, unnest({strings('g', 'targets')}) AS x FROM cg)),
    ttk AS (SELECT DISTINCT table_key FROM ct), tparts AS (SELECT term, k, array_to_string(string_split(k, '.')[:-2], '.') AS head, string_split(k, '.')[-1] AS tail FROM tsaid),
    tbare AS (SELECT string_split(table_key, '.')[-1] AS b, min(table_key) AS one FROM ttk GROUP BY ALL HAVING count(*) = 1),
    tg AS (SELECT DISTINCT 'k:' || term AS node, CASE WHEN x.table_key IS NULL AND m.col IS NOT NULL THEN 'c:' || coalesce(h.table_key, one) || '.' || m.col ELSE 't:' || coalesce(x.table_key, h.table_key, one) END AS target FROM tparts p LEFT JOIN ttk x ON x.table_key = k
      LEFT JOIN ttk h ON h.table_key = head LEFT JOIN mc m ON m.table_key = head AND m.col = tail AND h.table_key IS NOT NULL LEFT JOIN tbare ON b = k WHERE coalesce(x.table_key, h.table_key, one) IS NOT NULL)
"""
_GRAPH = """, fkp AS (SELECT DISTINCT from_key, to_key, from_columns[i] AS a, to_columns[i] AS b FROM (SELECT *, unnest(range(1, least(len(from_columns), len(to_columns)) + 1)) AS i FROM de)),
    cn AS (SELECT 'c:' || table_key || '.' || col AS node FROM mc),
    ge AS (SELECT least(u, v) AS u, greatest(u, v) AS v, CAST(max(w) AS DOUBLE) AS w FROM (
      SELECT 't:' || table_key AS u, 'c:' || table_key || '.' || col AS v, 0.5 AS w FROM mc
      UNION ALL SELECT 't:' || from_key, 't:' || to_key, c FROM (SELECT least(from_key, to_key) AS from_key, greatest(from_key, to_key) AS to_key, min(""" + COST + """) AS c FROM de WHERE from_key <> to_key GROUP BY ALL)
      UNION ALL SELECT 'c:' || from_key || '.' || a, 'c:' || to_key || '.' || b, 0.8 FROM fkp WHERE 'c:' || from_key || '.' || a IN (SELECT node FROM cn) AND 'c:' || to_key || '.' || b IN (SELECT node FROM cn)
      UNION ALL SELECT node, target, 0.7 FROM tg
      UNION ALL SELECT 'w:' || token, node, weight * 0.3 FROM post WHERE token IN (SELECT token FROM post GROUP BY token HAVING count(*) <= 200)) WHERE u <> v GROUP BY ALL),
    gb AS (SELECT u, v, w FROM ge UNION ALL SELECT v, u, w FROM ge), stp AS MATERIALIZED (SELECT u, v, 0.85::DOUBLE * w / sum(w) OVER (PARTITION BY u) AS p FROM gb),
    home AS MATERIALIZED (SELECT qid, node, 0.15::DOUBLE * weight / sum(weight) OVER (PARTITION BY qid) AS h FROM tokseed WHERE weight > 0), x0 AS (SELECT qid, node, h AS s FROM home)
"""


def _rounds(n: int) -> str:
    """The rounds of the walk as one CTE each: x1 by a plain step, then Chebyshev's weights."""
    out, omega = [], 1.0
    for k in range(n):
        omega = R.next_weight(omega, k == 0, R.ALPHA)
        back = f" UNION ALL SELECT qid, node, {1 - omega!r}::DOUBLE * s FROM x{k - 1}" if k else ""
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT qid, node, sum(s) AS s FROM (SELECT qid, v AS node, {omega!r}::DOUBLE * s * p AS s FROM x{k} JOIN stp ON u = node UNION ALL SELECT qid, node, {omega!r}::DOUBLE * h FROM home{back}) GROUP BY ALL)")
    return ", " + ", ".join(out)


_ROUNDS = 45
_SAMPLES = f""", sv AS (SELECT table_key, col, v, min(((rk * 1000 + pos) * 1000 + cpos) * 100 + sp) AS r FROM (
        SELECT table_key, col, rk, pos, cpos, unnest({strings('c', 'sample_values')}) AS v, generate_subscripts({strings('c', 'sample_values')}, 1) AS sp FROM cc) WHERE v IS NOT NULL GROUP BY ALL),
      kept AS (SELECT *, row_number() OVER (PARTITION BY table_key, col ORDER BY r) AS n FROM sv),
      vw AS (SELECT 'c:' || table_key || '.' || col AS node, lower(trim(v)) AS value, [x for x in string_split_regex(lower(trim(v)), '[^a-z0-9]+') if x <> ''] AS l FROM kept WHERE n <= 20),
      vals AS (SELECT DISTINCT array_to_string(l, '_') AS gram, len(l) AS n_words, value, node FROM vw
      WHERE len(value) >= 3 AND NOT regexp_matches(regexp_replace(value, '[.-]', '', 'g'), '^[0-9]*$') AND len(l) > 0 AND len([x for x in l if NOT regexp_matches(x, '^[0-9]+$')]) > 0 AND (len(l) > 1 OR len(l[1]) >= 3))"""

SQL: dict[str, str] = {
    "rank_pagerank_tokens": CATALOG + _LEX + _TARGETS + _GRAPH + _rounds(_ROUNDS) + f"SELECT qid, node, round(score, 5) AS score FROM (SELECT qid, node, s / sum(s) OVER (PARTITION BY qid) AS score FROM x{_ROUNDS}) WHERE round(score, 5) > 0 AND (node LIKE 't:%' OR node LIKE 'c:%')",
    "activation_exact": CATALOG + _LEX + _TARGETS + _SAMPLES + f""", low AS (SELECT item_id AS qid, ' ' || lower(text) || ' ' AS t, [x for x in string_split_regex(lower(text), '[^a-z0-9]+') if x <> ''] AS l FROM eval_items WHERE text IS NOT NULL),
      esc AS (SELECT 'k:' || term AS node, phrase, '[^a-z0-9]' || regexp_escape(phrase) || '[^a-z0-9]' AS pat FROM ph),
      s1 AS (SELECT DISTINCT qid, node, phrase FROM low JOIN esc ON regexp_matches(t, pat)),
      vg AS (SELECT DISTINCT qid, unnest({_grams('l', 1, 6)}) AS gram FROM low) ,
      s2 AS (SELECT DISTINCT qid, node, value FROM vg JOIN vals USING (gram) WHERE n_words <= 6 UNION SELECT qid, node, value FROM low JOIN vals ON n_words > 6 AND regexp_matches(t, '[^a-z0-9]' || regexp_escape(value) || '[^a-z0-9]')),
      grams AS (SELECT DISTINCT qid, unnest(list_concat({_grams('tokens')}, {_grams('raw')})) AS gram FROM q),
      full_names AS (SELECT node, array_to_string({_tok('name', True)}, '_') AS gram FROM named WHERE field <> 'term' UNION SELECT node, array_to_string({_tok('name')}, '_') FROM named WHERE field <> 'term' AND len({_tok('name')}) >= 2),
      every AS (SELECT qid, node, 1.5::DOUBLE AS w FROM s1 UNION ALL SELECT qid, target, 1.2 FROM s1 JOIN tg USING (node) UNION ALL SELECT qid, node, 1.5 FROM s2
        UNION ALL SELECT qid, node, 1.6 FROM (SELECT DISTINCT qid, node FROM grams JOIN full_names USING (gram)) UNION ALL SELECT qid, node, CAST(f.w * weight * idf AS DOUBLE) FROM forms f JOIN post ON form = token JOIN rare USING (token))
      SELECT qid, node, round(sum(w), 5) AS weight FROM every GROUP BY ALL""",
    "infer_by_name": CATALOG + _KEYED + "SELECT * FROM r1",
    "infer_shared_key": CATALOG + _KEYED + "SELECT * FROM r2",
    "infer_edges": CATALOG + _KEYED + """, every AS (SELECT 1 AS rule, *, 0.6::DOUBLE AS confidence FROM r1 UNION ALL SELECT 2, * FROM r2)
      SELECT from_key, from_col, to_key, to_col, confidence FROM every e WHERE NOT EXISTS (SELECT 1 FROM ce WHERE (ce.from_key = e.from_key AND ce.to_key = e.to_key) OR (ce.from_key = e.to_key AND ce.to_key = e.from_key))
      QUALIFY row_number() OVER (PARTITION BY least((from_key, from_col), (to_key, to_col)), greatest((from_key, from_col), (to_key, to_col)) ORDER BY rule, from_key, from_col) = 1""",
    "family_shards": """WITH n AS (SELECT 'raw.' || event_type || '_' || strftime(ts, '%Y%m%d') AS name FROM events)
      SELECT regexp_replace(lower(name), '^(.*?)_?(\\d{8}|\\d{6}|(19|20)\\d{2})$', '\\1_*') AS canonical, min(name) AS representative, count(DISTINCT name) AS n_members, max(name) AS last FROM n GROUP BY 1""",
    "family_signatures": "SELECT regexp_replace(lower(trim(source)), '[0-9]+', '*', 'g') AS signature, count(DISTINCT source) AS n_sources FROM snapshots GROUP BY 1",
    "family_jaccard": CATALOG + """, cs AS (SELECT table_key, list(DISTINCT col) AS c FROM mc GROUP BY ALL), p AS (SELECT DISTINCT least(from_key, to_key) AS u, greatest(from_key, to_key) AS v FROM de WHERE from_key <> to_key)
      SELECT u, v, round(len(list_intersect(a.c, b.c)) / greatest(len(list_distinct(list_concat(a.c, b.c))), 1), 6) AS jaccard FROM p JOIN cs a ON a.table_key = u JOIN cs b ON b.table_key = v""",
    "text_tokens": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_tok('text')}) AS token FROM documents) GROUP BY ALL",
    "text_lemmas": f"SELECT token, {_lemma('token')} AS lemma FROM (SELECT DISTINCT unnest({_tok('text')}) AS token FROM eval_items)",
    "text_ngrams": f"SELECT gram, count(*) AS n, min(qid) AS first_qid FROM (SELECT qid, unnest({_grams('t')}) AS gram FROM (SELECT item_id AS qid, {_tok('text')} AS t FROM eval_items)) GROUP BY ALL",
    "lexical_postings": CATALOG + _LEX + "SELECT token, node, weight FROM post",
    "lexical_idf": CATALOG + _LEX + "SELECT token, df, round(CAST(idf AS DOUBLE), 6) AS idf FROM rare",
    "lexical_hubs": CATALOG + _LEX + "SELECT token, count(*) AS n, round(sum(weight * 0.3::DOUBLE), 6) AS mass FROM post GROUP BY ALL HAVING count(*) <= 200",
    "seeds_tokens": CATALOG + _LEX + "SELECT qid, node, weight FROM tokseed",
    "seeds_names": CATALOG + _LEX + f""", grams AS (SELECT DISTINCT qid, unnest(list_concat({_grams('tokens')}, {_grams('raw')})) AS gram FROM q),
      full_names AS (SELECT node, array_to_string({_tok('name', True)}, '_') AS gram FROM named WHERE field <> 'term' UNION SELECT node, array_to_string({_tok('name')}, '_') FROM named WHERE field <> 'term' AND len({_tok('name')}) >= 2)
      SELECT DISTINCT qid, node FROM grams JOIN full_names USING (gram)""",
    "bm25f": CATALOG + _LEX + _BM + "SELECT qid, table_key, score FROM bm",
    "fused": CATALOG + _LEX + _BM + """, own AS (SELECT qid, node[3:] AS table_key, weight AS score FROM tokseed WHERE node LIKE 't:%'),
      r AS (SELECT qid, table_key, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY score DESC, table_key)) AS p FROM bm UNION ALL SELECT qid, table_key, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY score DESC, table_key)) FROM own)
      SELECT qid, table_key, round(sum(p), 6) AS score FROM r GROUP BY ALL""",
    "rank_specificity": CATALOG + """, n AS (SELECT DISTINCT 't:' || table_key AS node, string_split(table_key, '.')[-1] AS name FROM ct UNION ALL SELECT 'c:' || table_key || '.' || col, col FROM mc)
      SELECT node, round(CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN 1.0 / ln(1 + count(*) OVER (PARTITION BY name)) ELSE 1.0 END, 6) AS spec FROM n""",
    "rank_transition": CATALOG + """, e AS (SELECT 't:' || table_key AS u, 'c:' || table_key || '.' || col AS v, 0.5::DOUBLE AS w FROM mc
      UNION ALL SELECT 't:' || least(from_key, to_key), 't:' || greatest(from_key, to_key), CAST(min(CASE kind WHEN 'foreign_key' THEN 1.0 WHEN 'relationship_test' THEN 1.0 WHEN 'join_hint' THEN 1.0 WHEN 'catalog_relation' THEN 1.3 WHEN 'lineage' THEN 1.6 WHEN 'inferred' THEN 2.5 ELSE 2.0 END) AS DOUBLE)
        FROM de WHERE from_key <> to_key GROUP BY ALL), b AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e)
      SELECT u, v, round(w / sum(w) OVER (PARTITION BY u), 6) AS p FROM b""",
    "rank_table_evidence": CATALOG + _LEX + """, own AS (SELECT qid, node[3:] AS table_key, weight FROM tokseed WHERE node LIKE 't:%'),
      col AS (SELECT qid, table_key, weight, row_number() OVER (PARTITION BY qid, table_key ORDER BY weight DESC, node) AS n FROM tokseed JOIN mc ON node = 'c:' || table_key || '.' || col),
      sc AS (SELECT qid, table_key, sum(s) AS s FROM (SELECT qid, table_key, weight AS s FROM own UNION ALL SELECT qid, table_key, weight * CASE n WHEN 1 THEN 1 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0.02 END FROM col) GROUP BY ALL),
      bst AS (SELECT qid, max(s) AS best FROM sc GROUP BY ALL),
      fin AS (SELECT qid, table_key, sum(s) AS s FROM (SELECT * FROM sc UNION ALL SELECT qid, table_key, 0.35 * least(weight, 2) * best FROM own JOIN bst USING (qid) UNION ALL SELECT qid, table_key, 0.1 * least(weight, 2) * best FROM col JOIN bst USING (qid)) GROUP BY ALL)
      SELECT qid, table_key, round(s / max(s) OVER (PARTITION BY qid), 5) AS evidence FROM fin""",
    "paths_from_table": CATALOG + """, pr AS (SELECT least(from_key, to_key) AS u, greatest(from_key, to_key) AS v, CAST(min(CASE kind WHEN 'foreign_key' THEN 1.0 WHEN 'relationship_test' THEN 1.0 WHEN 'join_hint' THEN 1.0 WHEN 'catalog_relation' THEN 1.3 ELSE 2.5 END) AS DOUBLE) AS w
        FROM de WHERE from_key <> to_key AND kind IN ('foreign_key', 'relationship_test', 'join_hint', 'catalog_relation', 'inferred') GROUP BY ALL),
      b2 AS (SELECT u, v, w FROM pr UNION ALL SELECT v, u, w FROM pr),
      go AS (SELECT min(u) AS u, [min(u)] AS path, 0::DOUBLE AS cost FROM pr UNION ALL SELECT b2.v, list_append(path, b2.v), cost + w FROM go JOIN b2 ON b2.u = go.u WHERE NOT list_contains(path, b2.v) AND len(path) <= 3)
      SELECT array_to_string(path, ' > ') AS path, round(cost, 4) AS cost FROM go WHERE len(path) > 1""",
    "embedding_nearest": """WITH c AS (SELECT q.vec_id AS qid, o.vec_id AS oid, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), 12) AS c FROM embeddings q JOIN embeddings o ON q.vec_id % 100 = 0)
      SELECT qid, CAST(place AS INTEGER) AS place, oid, round(c, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, oid) AS place FROM c) WHERE place <= 5""",
    "lexical_values": CATALOG + f""", sv AS (SELECT table_key, col, v, min(((rk * 1000 + pos) * 1000 + cpos) * 100 + sp) AS r FROM (
        SELECT table_key, col, rk, pos, cpos, unnest({strings('c', 'sample_values')}) AS v, generate_subscripts({strings('c', 'sample_values')}, 1) AS sp FROM cc) WHERE v IS NOT NULL GROUP BY ALL),
      kept AS (SELECT *, row_number() OVER (PARTITION BY table_key, col ORDER BY r) AS n FROM sv),
      w AS (SELECT 'c:' || table_key || '.' || col AS node, lower(trim(v)) AS value, [x for x in string_split_regex(lower(trim(v)), '[^a-z0-9]+') if x <> ''] AS l FROM kept WHERE n <= 20)
      SELECT DISTINCT array_to_string(l, '_') AS gram, CAST(len(l) AS INTEGER) AS n_words, value, node FROM w
      WHERE len(value) >= 3 AND NOT regexp_matches(regexp_replace(value, '[.-]', '', 'g'), '^[0-9]*$') AND len(l) > 0 AND len([x for x in l if NOT regexp_matches(x, '^[0-9]+$')]) > 0 AND (len(l) > 1 OR len(l[1]) >= 3)""",
}
