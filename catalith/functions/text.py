"""Normalization of names and questions as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no schema vocabulary.
STOPWORDS = """
    a an and are as at be by for from get give has have how i in is it its list me of on or our per show
    that the their there these this to top was we were what which who with all any each find return using where when
    than then into over many much most least highest lowest between before after during last first recent please table tables
    column columns query database select rows row
    among given if more less within can you your based use used calculate calculated determine provide identify want analyze understand
    also same those only both other such like should would could will one two three across along well include including included
    consider considering excluding exclude according corresponding respectively specifically information details detail overall whose them
    they not no yes does do did had just make made compute computed report listing displaying display output result results
    answer question need needs looking look focus focusing taking take account thus so but else while
""".split()

# Short forms and what they stand for.
ABBREVIATIONS = {
    "acct": "account", "addr": "address", "amt": "amount", "avg": "average", "cat": "category", "cnt": "count",
    "cust": "customer", "dept": "department", "desc": "description", "dim": "dimension", "dt": "date", "emp": "employee",
    "fct": "fact", "id": "identifier", "inv": "invoice", "loc": "location", "mgr": "manager", "no": "number",
    "num": "number", "org": "organization", "pct": "percent", "prod": "product", "qty": "quantity", "stg": "staging",
    "tbl": "table", "ts": "timestamp", "txn": "transaction", "usr": "user", "yr": "year", "mth": "month",
    "grp": "group", "cd": "code", "nm": "name", "ref": "reference", "src": "source", "agg": "aggregate",
}

# Weights of what is indexed, and of what a question says.
NAME_WEIGHT, TAG_WEIGHT, BUSINESS_WEIGHT, DESC_WEIGHT, TERM_DESC_WEIGHT = 1.0, 0.5, 0.9, 0.35, 0.3
TOKEN_WEIGHT, EXPANSION_WEIGHT, FUZZY_WEIGHT, NGRAM_WEIGHT, VALUE_WEIGHT, PHRASE_WEIGHT, TARGET_WEIGHT = 1.0, 0.8, 0.6, 1.6, 1.5, 1.5, 1.2
NGRAM_MAX, MAX_VALUE_WORDS, MIN_VALUE_CHARS, MIN_NUMERIC = 3, 6, 3, 4
IDF_FLOOR, HUB_POSTINGS, MENTION_SCALE = 0.05, 200, 0.3
FUZZY_CUTOFF, FUZZY_MIN, FUZZY_MATCHES = 0.86, 5, 3


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lemma(t: Column) -> Column:
    """A token without its plural ending."""
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & t.endswith("ses"), F.substr(t, F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substr(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def tokenize(text: Column, keep_stop: bool = False) -> Column:
    """Lower-case alphanumeric tokens in text order, split at camelCase and all else; single letters are dropped, so are stopwords."""
    split = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", "_")), "[^a-z0-9]+")
    tokens = F.filter(split, lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]$"))
    return tokens if keep_stop else F.filter(tokens, lambda t: ~t.isin(STOPWORDS))


def words(text: Column) -> Column:
    """Lower-case alphanumeric words of any length."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def ngrams(tokens: Column, lo: int = 2, hi: int = NGRAM_MAX) -> Column:
    """Joined n-grams, shorter ones first."""

    def of(n: int) -> Column:
        last = F.size(tokens) - n + 1
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), "_"))

    return F.concat(*[of(n) for n in range(lo, hi + 1)])


def expansions() -> Column:
    return F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])


def shortenings() -> Column:
    back: dict[str, list[str]] = {}
    for k, v in ABBREVIATIONS.items():
        back.setdefault(v, []).append(k)
    return F.create_map(*[x for k, v in back.items() for x in (F.lit(k), _strings(v))])


def name_tokens(name: Column) -> Column:
    """Tokens of a name, stopwords too, then the expansion of each short form and each lemma; repeats count."""
    tokens = tokenize(name, keep_stop=True)
    long = F.transform(tokens, lambda t: F.array_compact(F.array(F.try_element_at(expansions(), t), F.when(lemma(t) != t, lemma(t)))))
    return F.concat(tokens, F.flatten(long))


def query_forms(tokens: Column, min_numeric: int = MIN_NUMERIC) -> Column:
    """(form, weight, why) of each question token: itself, its lemma, what it abbreviates and its short forms."""
    form = lambda f, w, why: F.struct(f.alias("form"), F.lit(w).alias("weight"), why.alias("why"))

    def of(t: Column) -> Column:
        short = F.transform(F.coalesce(F.try_element_at(shortenings(), t), F.array().cast("array<string>")), lambda s: form(s, EXPANSION_WEIGHT, F.concat(F.lit("abbrev '"), t, F.lit("'->'"), s, F.lit("'"))))
        long = F.try_element_at(expansions(), t)
        own = F.array(
            form(t, TOKEN_WEIGHT, F.concat(F.lit("token '"), t, F.lit("'"))),
            form(F.when(lemma(t) != t, lemma(t)), EXPANSION_WEIGHT, F.concat(F.lit("lemma '"), lemma(t), F.lit("'"))),
            form(long, EXPANSION_WEIGHT, F.concat(F.lit("abbrev '"), t, F.lit("'->'"), long, F.lit("'"))),
        )
        return F.filter(F.concat(own, short), lambda s: s["form"].isNotNull())

    said = F.filter(tokens, lambda t: ~(t.rlike("^[0-9]+$") & (F.length(t) < min_numeric)))
    return F.flatten(F.transform(said, of))
