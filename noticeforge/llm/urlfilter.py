"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

DataFrame and SQL functions only. The model is trained from a small labelled table
in its dual form: a link between two training rows is the product of their hashed
feature vectors, training folds over the rows' coefficients inside one expression,
and the weights of the feature buckets are sums over rows. At most BUCKETS weights
come to the driver and go into the scoring expression.

Cases: a null url, and one without "://", has an empty host and path; no rule fits
it, and the model sees two empty strings, for which it allows; repeated rows give
repeated rows; very long urls cost time in proportion to their length.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32_768
GRAM = 4
#: Most labelled rows that training takes; more are an error, as the table is meant to be small.
MAX_LABELLED = 500
STEPS, RATE, DECAY = 80, 0.5, 0.002

#: (host, path, verdict); the longest one that fits decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_RULES = 1000

#: The labelled table: first labels of hosts, joined to urls below, written down from general knowledge of the web. Spam is 1.
SPAM_WORDS = "casino-bonus free-money viagra-shop poker-win payday-loans replica-watches hot-dates adult-cams lottery-prize bet-jackpot click-bait link-exchange seo-boost miracle-diet buy-followers crypto-profit free-iphone cheap-meds xxx-video porn-tube sex-chat fake-bags forex-rich win-cash slots-vegas weight-loss bulk-mailer ad-server banner-ads popup-ads tracking-pixel easy-credit debt-relief discount-pharmacy instant-riches spam-blast".split()
GOOD_WORDS = "library weather museum university recipes garden history science cityhall school travel music forum docs news bookshop farmers-market bank hospital sports railway chess theatre airport newspaper research kitchen archive gallery poetry physics village harbour orchard gazette cinema students parents teachers nations mountains dictionary parliament astronomy".split()
PATHS = "/ /about /index.html /contact?ref=1 /a/b/c /2021/05/post /item.php?id=9".split()


def labelled(spark: SparkSession) -> DataFrame:
    """url and label of the built-in table: every word once in each of two hosts."""
    rows = []
    for label, words in ((1, SPAM_WORDS), (0, GOOD_WORDS)):
        for i, w in enumerate(words):
            for k, top in enumerate(("com", "org")):
                sub = ("", "www.", "blog.", "m.")[(i + k) % 4]
                rows.append(f"('http://{sub}{w}.example.{top}{PATHS[(i + 3 * k) % len(PATHS)]}', {label})")
    return spark.sql(f"SELECT url, label FROM VALUES {', '.join(rows)} AS t(url, label)")


def host(url):
    """After the first "://" up to "/", "?", "#" or the end, A to Z in lower case."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url):
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def buckets(host_col: str, path_col: str):
    """Distinct buckets of the character n-grams of host and path, ends marked, each kind apart. Columns hold lists of characters."""
    def grams(mark: str, chars: str):
        n = F.size(chars) - GRAM + 1
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(F.lit(mark), F.array_join(F.slice(chars, i + 1, GRAM), "")))
        return F.transform(each, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(grams("h", host_col), grams("p", path_col)))


def features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with _host, _path and _buckets."""
    df = df.withColumns({"_host": host(F.col(url_col)), "_path": path(F.col(url_col))})
    chars = lambda c: F.split(F.concat(F.lit("^"), F.col(c), F.lit("$")), "")
    return df.withColumns({"_hc": chars("_host"), "_pc": chars("_path")}).withColumn("_buckets", buckets("_hc", "_pc")).drop("_hc", "_pc")


def train(table: DataFrame, url_col: str = "url", label_col: str = "label") -> tuple[float, dict[int, float]]:
    """Intercept and weights of buckets. Rows with a null label take no part."""
    rows = table.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    rows = features(rows.groupBy("url").agg(F.avg("y").alias("y"))).select(F.row_number().over(_by_url()).alias("i"), "y", "_buckets")
    n = rows.count()
    if not n:
        return -1.0, {}
    if n > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    entry = rows.select("i", F.explode("_buckets").alias("b"), (1 / F.sqrt(F.size("_buckets"))).alias("x"))
    other = entry.select(F.col("i").alias("j"), "b", F.col("x").alias("z"))
    kernel = entry.join(other, "b").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    kernel = kernel.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "k"))).alias("row"))
    one = rows.join(kernel, "i").groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "y", "row"))).alias("t"))
    zero = F.struct(F.transform("t", lambda r: F.lit(0.0)).alias("a"), F.lit(0.0).alias("c"))

    def step(state, _):
        def wrong(r):
            at = F.aggregate(r["row"], state["c"], lambda s, e: s + e["k"] * F.get(state["a"], e["j"] - 1))
            return r["y"] - 1 / (1 + F.exp(-at))

        error = F.transform("t", wrong)
        return F.struct(F.zip_with(state["a"], error, lambda a, e: a * (1 - DECAY) + RATE * e).alias("a"), (state["c"] + RATE * F.aggregate(error, F.lit(0.0), lambda s, e: s + e) / n).alias("c"))

    solved = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step).alias("s"))
    solved = solved.select("s.c", F.posexplode("s.a").alias("i", "a")).withColumn("i", F.col("i") + 1)
    weights = entry.join(solved, "i").groupBy("b").agg(F.sum(F.col("a") * F.col("x")).alias("w"), F.first("c").alias("c")).collect()
    return float(weights[0]["c"]), {r["b"]: float(r["w"]) for r in weights}


def _by_url():
    from pyspark.sql import Window

    return Window.orderBy("url")


def judge(df: DataFrame, model: tuple[float, dict[int, float]], rules=RULES, url_col: str = "url") -> DataFrame:
    """df with host, path, rule, score (the model's probability of blocking) and verdict; columns of these names are replaced."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    intercept, weights = model
    known = F.from_json(F.lit(json.dumps([weights.get(b, 0.0) for b in range(BUCKETS)])), "array<double>")
    table = F.from_json(F.lit(json.dumps([{"host": h, "path": p, "rule": h + p, "verdict": v} for h, p, v in rules])), "array<struct<host:string,path:string,rule:string,verdict:string>>")
    found = features(df.drop("host", "path", "rule", "score", "verdict"), url_col)
    fits = F.filter(table, lambda r: ((F.col("_host") == r["host"]) | F.endswith("_host", F.concat(F.lit("."), r["host"]))) & F.startswith("_path", r["path"]))
    best = F.aggregate(fits, F.lit(None).cast("struct<host:string,path:string,rule:string,verdict:string>"), lambda a, r: F.when(a.isNull() | (F.length(r["rule"]) > F.length(a["rule"])), r).otherwise(a))
    total = F.aggregate("_buckets", F.lit(0.0), lambda s, b: s + F.get(known, b))
    score = 1 / (1 + F.exp(-(intercept + total / F.sqrt(F.size("_buckets")))))
    found = found.withColumns({"_best": best, "score": score})
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    found = found.withColumns({"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), method)})
    return found.drop("_host", "_path", "_buckets", "_best")
