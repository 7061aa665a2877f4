"""URL filter: rules on host and path, and where none fits, logistic regression on hashed character n-grams. DataFrame functions only.

The regression is trained from a small labelled table of addresses (LABELLED, or another of at most MOST_LABELLED rows): full
gradient descent in its dual form. Each step needs only the overlaps of the training addresses with each other, so the whole
training is one SQL expression over that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut

BUCKETS, ORDERS = 1 << 16, (3, 4, 5)
#: Addresses that each labelled word stands in.
COPIES = 3
MOST_LABELLED = 2000
#: Of gradient descent. BIAS is the value of the feature that all addresses have; its weight is the intercept and is fitted like the others.
STEPS, RATE, PENALTY, BIAS = 15, 0.08, 0.1, 0.4

#: Rules (host, path, verdict) of the production filter.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# The labelled table: words that block lists and directories of harmless sites are about, by topic. Hosts are made of them by rule, below.
UNWANTED = (
    "casino", "poker", "slots", "roulette", "jackpot", "blackjack", "bingo", "lottery", "betting", "bets", "bookmaker", "wager", "gambling",
    "viagra", "cialis", "pills", "meds", "steroids", "slimming", "painkiller", "erection", "testosterone",
    "porn", "xxx", "sex", "adult", "nude", "escort", "webcam-girls", "hentai", "hookup", "fetish",
    "adserver", "adclick", "ads", "banner-ads", "popup", "popunder", "tracker", "tracking", "clickbait", "telemetry-pixel", "doubleclick",
    "spam", "bulk-mail", "linkfarm", "backlinks", "seo-boost", "buy-followers", "buy-likes",
    "malware", "phishing", "keygen", "warez", "cracked", "torrentz", "spyware", "botnet",
    "replica-watches", "counterfeit", "fake-id", "payday", "quick-loans", "forex-profit", "crypto-doubler", "ponzi", "giveaway", "prizes", "sweepstakes", "get-rich", "easy-money", "cheap", "free-gift", "winner",
)
WANTED = (
    "library", "museum", "archive", "dictionary", "encyclopedia", "grammar", "history", "poetry", "novels", "theatre", "opera", "orchestra", "painting", "sculpture", "pottery", "photography", "cinema", "documentary",
    "university", "college", "school", "academy", "teaching", "nursery", "science", "physics", "chemistry", "biology", "astronomy", "geology", "maths", "statistics", "engineering", "architecture", "linux", "python", "compiler", "database", "network", "hardware",
    "weather", "climate", "ocean", "forest", "mountain", "river", "garden", "orchard", "vineyard", "farming", "birds", "horses", "dogs", "bees", "fishing", "sailing", "cycling", "climbing", "walking", "running", "football", "cricket", "tennis", "chess",
    "news", "herald", "gazette", "tribune", "journal", "magazine", "radio", "television", "parliament", "council", "court", "law", "police", "charity", "church", "temple", "village", "town", "city", "county", "embassy",
    "hospital", "nursing", "dentist", "optician", "health", "kitchen", "recipes", "bakery", "cheese", "coffee", "restaurant", "hotel", "travel", "railway", "airport", "maps", "bank", "insurance", "accounting", "careers",
    "furniture", "plumbing", "carpentry", "electricity", "knitting", "sewing", "toys", "puzzles", "family", "parents", "wedding", "genealogy", "translation", "language", "software", "support", "forum", "community", "association", "institute", "foundation", "government", "research", "international", "national", "northern", "western", "other", "thing", "water", "under", "street", "station", "market", "bridge", "castle", "island", "harbour",
)
#: Words that stand beside those of either kind.
BESIDE = ("", "online", "best", "the", "my", "world", "home", "group", "house", "zone", "club", "today", "net", "central", "direct", "time")
_BEGINNINGS, _DOMAINS, _PATHS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org"), ("/", "/index.html", "/about", "/article/2019/07", "/page?id=4", "/a/b/c", "/contact")


def labelled() -> list[tuple[str, int]]:
    """(url, 1 for unwanted or 0): each word COPIES times, beside words, domains and paths that are dealt alike to both kinds."""
    rows = []
    for bad, words in ((1, UNWANTED), (0, WANTED)):
        for k, word in enumerate(words):
            for j in range(COPIES):
                near = BESIDE[(k * 5 + j * 7) % len(BESIDE)]
                names = [x for x in ((word, near) if (k + j) % 3 else (near, word)) if x]
                name = ("-" if (k + j) % 2 else "").join(names)
                rows.append((f"https://{_BEGINNINGS[(k + j) % 4]}{name}.{_DOMAINS[(k + j) % 3]}{_PATHS[(k * 3 + j) % 7]}", bad))
    return rows


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (then the first by its text), or null.

    A rule fits its host and all subdomains of it, where the path starts with the rule's.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct((-F.length(r["host"]) - F.length(r["path"])).alias("n"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def buckets(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams of ^host path$, the path in lower case. Each n-gram's code points make a number modulo 1000003, then BUCKETS."""
    text = F.concat(F.lit("^"), host, F.lower(path), F.lit("$"))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def grams(box: Column) -> Column:
        all_of = [
            F.transform(
                F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(box) - n + 1)), lambda i: F.size(box) >= n),
                lambda i: (F.aggregate(F.slice(box, i, F.lit(n)), F.lit(n).cast("long"), lambda h, c: (h * 131 + c) % 1000003) % BUCKETS).cast("int"),
            )
            for n in ORDERS
        ]
        return F.array_distinct(F.concat(*all_of))

    return F.get(F.transform(F.array(codes), grams), F.lit(0))


def fit(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, from a small table of (url, label 0 or 1). An empty table gives zeros: every address then has a chance of one half."""
    rows = labelled() if rows is None else rows
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"at most {MOST_LABELLED} labelled addresses")
    if not rows:
        return [0.0] * BUCKETS, 0.0
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(u).alias("url"), F.lit(float(y)).alias("y")) for k, (u, y) in enumerate(rows)])
    table = spark.range(0, 1, 1, 1).select(F.inline(listed))
    host, path = parts(F.col("url"))
    # A gram weighs its inverse document frequency over the root of the number of grams: what all addresses have says nothing.
    grams = table.select("k", "y", buckets(host, path).alias("b")).select("k", "y", F.explode("b").alias("b"), (1 / F.sqrt(F.size("b"))).alias("x"))
    rare = grams.groupBy("b").agg(F.log(F.lit(float(len(rows))) / F.count("*")).alias("idf"))
    grams = grams.join(rare, "b").withColumn("x", F.col("x") * F.col("idf"))
    other = grams.select(F.col("k").alias("k2"), "b", F.col("x").alias("x2"))
    overlap = grams.join(other, "b").groupBy("k", "k2").agg(F.sum(F.col("x") * F.col("x2")).alias("o"))
    by_row = overlap.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("k2", "o"))).alias("o")).join(table.select("k", "y"), "k")
    whole = by_row.agg(F.sort_array(F.collect_list(F.struct("k", "y", "o"))).alias("rows"))

    def step(a: Column, _: Column) -> Column:
        shared = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) * (BIAS * BIAS)  # the feature that all have
        margin = lambda r: F.aggregate(r["o"], shared, lambda s, o: s + o["o"] * F.get(a, o["k2"]))
        return F.transform(F.col("rows"), lambda r: F.get(a, r["k"]) * (1 - RATE * PENALTY) + RATE * (r["y"] - 1 / (1 + F.exp(-margin(r)))))

    duals = whole.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("rows", lambda r: F.lit(0.0)), step).alias("a"))
    dual = cut(duals.select(F.posexplode("a").alias("k", "a")))
    weights, intercept = [0.0] * BUCKETS, dual.agg(F.sum("a")).first()[0] * BIAS * BIAS
    for r in dual.join(grams, "k").groupBy("b").agg(F.sum(F.col("a") * F.col("x") * F.col("idf")).alias("w")).collect():
        weights[r["b"]] = r["w"]
    return weights, intercept


def probability(found: Column, weights: list[float], bias: float) -> Column:
    """Probability that an address is unwanted, from its buckets."""
    # One text literal, which becomes one constant array when the plan is made.
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    margin = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.sqrt(F.greatest(F.size(found), F.lit(1)))
    return 1 / (1 + F.exp(-(margin + F.lit(float(bias)))))


def judge(pages: DataFrame, *, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, model: tuple[list[float], float] | None = None) -> DataFrame:
    """`pages` with host, path, rule, verdict and unwanted (the model's probability) in a struct column `url_judgement`.

    The verdict is the rule's if one fits; else `block` from a probability of one half on, `allow` under it. Null and odd addresses
    have empty host and path, which only a rule with empty host could fit, and get the model's verdict like others. An own column
    `url_judgement` is replaced.
    """
    weights, bias = model or fit(pages.sparkSession)
    host, path = parts(F.col(url_col))
    split = pages.withColumn("url_judgement", F.struct(host.alias("host"), path.alias("path")))
    h, p = F.col("url_judgement.host"), F.col("url_judgement.path")
    best, chance = fitting_rule(h, p, rules), probability(buckets(h, p), weights, bias)
    judged = F.struct(h.alias("host"), p.alias("path"), best["rule"].alias("rule"), F.coalesce(best["verdict"], F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"), chance.alias("unwanted"))
    return split.withColumn("url_judgement", judged)
