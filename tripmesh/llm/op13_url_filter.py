"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

A rule names a host and the start of a path; it fits that host and its subdomains,
and the longest one that fits decides. Where none fits, boosted trees
decide. They learn from the urls that rules judge (or from any table of urls and labels): lengths,
depth, shares of digits and other signs, entropy, parameters, and the log odds of
blocked urls among those with the same suffix of the host. Suffix statistics cover all labelled rows, in
hashed buckets, so their table has a bound and is broadcast; an url in training sees them without
its own fold, so that it does not learn from its own label.

The trees are fitted on at most about ``max_labels`` distinct urls, taken by hash, which is the only bound; every row is judged. Features are
column expressions; equal urls get equal verdicts, wherever they are.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no
rule, and is judged by its features. With no labelled url everything the rules leave is allowed; with
labels of one kind, that kind is the verdict. Repeated rows are judged alike. Two rules of one length that
both fit: the first by text. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmesh.llm.common import ROW, let, plain, read_table, saved

MAX_LABELS = 100_000
FOLDS = 5
BUCKETS = 8192
SMOOTHING = 4.0
ROUNDS, DEPTH, STEP = 20, 4, 0.3
ALL = -1  # fold of rows that are in none


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


# --- urls and rules -------------------------------------------------------------

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def ruled(rules: tuple[Rule, ...], field: str) -> Column:
    """A field of the longest rule that fits the columns host and path; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        at_host = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit(f".{r.host}"))
        out = F.when(at_host & F.startswith(F.col("path"), F.lit(r.path)), F.lit(getattr(r, field))).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None) -> DataFrame:
    """url, host, path, rule and ruled (the verdict of the rule); the carried columns are in ``common.ROW``."""
    row = F.struct(*[F.col(f"`{c}`") for c in (pages.columns if carry is None else carry)]).alias(ROW)
    out = pages.select(row, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return out.withColumns({"rule": ruled(rules, "text"), "ruled": ruled(rules, "verdict")})


# --- features -------------------------------------------------------------------


def _share(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    total = F.length(text)

    def summed(chars: Column) -> Column:
        def add(acc: Column, c: Column) -> Column:
            share = (total - F.length(F.replace(text, c, F.lit("")))) / total
            return acc - share * F.log2(share)

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), add)

    return F.when(total > 0, let(F.regexp_extract_all(text, F.lit("(?s)."), 0), summed)).otherwise(0.0)


def lexical() -> dict[str, Column]:
    """Features over the columns url, host and path."""
    url = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    last = F.regexp_extract(path, r"(?s)([^/]*)$", 1)

    def count(of: Column, pattern: str) -> Column:
        return F.regexp_count(of, F.lit(pattern))

    return {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "last_length": F.length(last),
        "depth": count(path, "[^/]+"),
        "host_parts": count(host, "[^.]+"),
        "longest_part": F.array_max(F.transform(F.split(host, r"\."), F.length)),
        "hyphens": count(host, "-"),
        "digit_ratio": _share(count(url, "[0-9]"), F.length(url)),
        "host_digits": _share(count(host, "[0-9]"), F.length(host)),
        "sign_ratio": _share(count(url, "[^A-Za-z0-9]"), F.length(url)),
        "capital_ratio": _share(count(url, "[A-Z]"), F.length(url)),
        "escapes": count(url, "%[0-9A-Fa-f]{2}"),
        "parameters": count(query, "[^&;]+"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "extension": F.contains(last, F.lit(".")).cast("int"),
        "secure": F.startswith(F.lower(url), F.lit("https:")).cast("int"),
        "host_entropy": entropy(host),
        "path_entropy": entropy(path),
    }


def bucket(labels: int) -> Column:
    """Bucket of the last labels of the host."""
    parts = F.split("host", r"\.")
    suffix = F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")
    return F.pmod(F.xxhash64(F.lit(labels), suffix), F.lit(BUCKETS))


def fold() -> Column:
    return F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(FOLDS))


def suffix_odds(labelled: DataFrame) -> DataFrame:
    """(bucket, fold, odds): log odds of blocked urls, without those of one fold; at most BUCKETS x (FOLDS + 1) rows."""
    each = labelled.select(F.explode(F.array(bucket(1), bucket(2))).alias("bucket"), fold().alias("fold"), "blocked")
    counts = each.groupBy("bucket", "fold").agg(F.sum("blocked").alias("b"), F.count("*").alias("n"))
    totals = counts.groupBy("bucket").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("b", "n")))).alias("own"))
    totals = totals.select("*", F.explode(F.sequence(F.lit(ALL), F.lit(FOLDS - 1))).alias("fold"))
    own = F.try_element_at("own", F.col("fold").cast("long"))
    b, n = F.col("b") - F.coalesce(own["b"], F.lit(0)), F.col("n") - F.coalesce(own["n"], F.lit(0))
    return totals.select("bucket", "fold", F.log((b + SMOOTHING / 2) / (n - b + SMOOTHING / 2)).alias("odds"))


def with_features(rows: DataFrame, odds: DataFrame, in_fold: Column) -> DataFrame:
    """Rows with url, host and path, and the vector column features."""
    names = lexical()
    rows = rows.withColumns({"near": bucket(2), "far": bucket(1), "fold": in_fold.cast("int")})
    for place in ("far", "near"):
        side = odds.select(F.col("bucket").alias(place), "fold", F.col("odds").alias(f"{place}_odds"))
        rows = rows.join(F.broadcast(side), [place, "fold"], "left").fillna(0.0, [f"{place}_odds"])
    numbers = F.struct(*[c.cast("double").alias(n) for n, c in names.items()]).alias("lexical")
    rows = rows.withColumn("lexical", numbers).select("*", *[F.col(f"lexical.{n}").alias(f"lexical_{n}") for n in names])
    inputs = [*[f"lexical_{n}" for n in names], "far_odds", "near_odds"]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).drop("lexical", "near", "far", "fold", *inputs)


# --- trees ----------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    odds: DataFrame
    trees: GBTClassificationModel


@dataclass(frozen=True)
class Constant:
    verdict: str


def fit(labelled: DataFrame, max_labels: int = MAX_LABELS) -> Model | Constant:
    """A model of labelled urls: (url, blocked), blocked being 1 or 0. Rows with a null are left out."""
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", F.col("blocked").cast("int").alias("blocked"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = rows.groupBy("url", "host", "path").agg(F.max("blocked").alias("blocked"))
    urls = saved(urls, "labelled-urls")
    n, n_blocked = urls.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if n_blocked in (0, n):
        return Constant("block" if n_blocked else "allow")
    odds = saved(suffix_odds(rows), "suffix-odds")
    taken = F.pmod(F.xxhash64(F.lit(7), "url"), F.lit(1 << 20)) < int(min(1.0, max_labels / n) * (1 << 20))
    data = with_features(urls.where(taken), odds, fold()).select("features", F.col("blocked").cast("double").alias("label"))
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=1).fit(data)
    return Model(odds, trees)


def judged(pages: DataFrame, model: Model | Constant, rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None) -> DataFrame:
    """host, path, rule, verdict and by (rule or trees) of every row; the carried columns are in ``common.ROW``."""
    rows = with_rules(pages, rules, carry)
    if isinstance(model, Constant):
        guess = F.lit(model.verdict)
    else:
        rows = model.trees.transform(with_features(rows, model.odds, F.lit(ALL)))
        guess = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    by = F.when(F.col("ruled").isNull(), F.lit("trees")).otherwise(F.lit("rule"))
    return rows.select(ROW, "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"), by.alias("by"))


def ruled_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The urls that rules judge, as labels."""
    return with_rules(pages, rules, []).where("ruled IS NOT NULL").select("url", (F.col("ruled") == "block").cast("int").alias("blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return plain(judged(pages, fit(ruled_urls(pages)), carry=["page_id"]), "host", "path", "rule", "verdict")
