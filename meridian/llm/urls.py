"""URL filters: longest-rule lookup, else logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled table (MAX_LABELLED rows at most, checked); its
n-grams come from the same SQL expression as those of the URLs it judges, and scoring is SQL functions only.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the feature hash; n-gram sizes; labelled rows that a fit takes at most.
BUCKETS = 65536
SIZES = (3, 4, 5)
MAX_LABELLED = 2000
#: Probability from which a URL is blocked; weight of an allowed URL in a fit, as a false block costs more than a miss.
THRESHOLD, ALLOW_WEIGHT = 0.5, 6.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of hosts and paths that a labelled URL is built from: games of chance, adult content, drugs, loans, pirated
#: goods, bait and junk, attacks, advertising and tracking; and what ordinary hosts and paths are named after.
BLOCK_WORDS = (
    "casino", "poker", "jackpot", "betting", "bets", "gambling", "roulette", "slots", "bingo", "bookmaker", "lottery",
    "xxx", "porn", "nude", "escort", "adult", "sex", "erotic", "webcam-girls", "hentai", "milf", "fetish", "camgirl", "nsfw",
    "pills", "viagra", "cialis", "steroids", "pharmacy-cheap", "weightloss-pill", "xanax",
    "payday-loan", "quick-cash", "get-rich", "forex-profit", "crypto-giveaway", "binary-options",
    "warez", "torrent", "crack", "keygen", "serial-key", "nulled", "pirate", "replica-watches",
    "free-gift", "click-here", "spam", "linkfarm", "win-prize", "freebies", "clickbait", "backlinks",
    "malware", "phishing", "trojan", "botnet", "ransomware", "verify-account", "scam", "hoax-login",
    "ads", "adserver", "adclick", "banner-ads", "popunder", "track", "tracker", "tracking-pixel", "doubleclick", "beacon-ad",
)
ALLOW_WORDS = (
    "news", "wiki", "docs", "blog", "library", "university", "museum", "science", "health", "recipes", "garden", "history",
    "weather", "travel", "school", "journal", "archive", "forum", "research", "sports", "music", "books", "cinema", "theatre",
    "kitchen", "farm", "market", "city", "council", "government", "hospital", "pharmacy", "bank", "insurance", "hotel",
    "railway", "airport", "bicycle", "football", "chess", "astronomy", "biology", "chemistry", "physics", "maths", "language",
    "dictionary", "poetry", "painting", "design", "software", "download", "support", "manual", "careers", "events", "calendar",
    "photos", "video", "radio", "adventure", "address", "admin", "trade", "traffic", "beta", "better", "alphabet", "bread",
    "home", "house", "family", "children", "people", "story", "letter", "paper", "pencil", "table", "chair", "flower", "tree", "animal",
    "water", "ocean", "desert", "valley", "country", "region", "county", "street", "station", "bridge", "tower", "palace", "temple",
    "kingdom", "nation", "festival", "concert", "dance", "song", "singer", "actor", "writer", "artist", "author", "editor", "reader",
    "student", "college", "academy", "course", "lesson", "exam", "degree", "training", "workshop", "meeting", "conference", "society",
    "medicine", "doctor", "nurse", "clinic", "surgery", "fitness", "yoga", "cooking", "baking", "dinner", "coffee", "cheese", "apple",
    "orange", "lemon", "cherry", "butter", "sugar", "restaurant", "tavern", "vineyard", "brewery", "shopping", "fashion", "jewelry",
    "clothing", "leather", "furniture", "lighting", "heating", "electric", "engine", "motor", "vehicle", "truck", "tractor", "boating",
    "marine", "naval", "military", "police", "justice", "court", "legal", "finance", "economy", "business", "industry", "factory",
    "company", "office", "service", "delivery", "logistics", "transport", "shipping", "energy", "solar", "climate", "nature", "wildlife",
    "bird", "horse", "fisher", "hunter", "camping", "climbing", "skiing", "skating", "racing", "rowing", "golf", "basketball", "volley",
    "computer", "network", "internet", "server", "database", "program", "python", "engineer", "machine", "robot", "electronics",
    "mathematics", "geometry", "statistics", "philosophy", "religion", "culture", "heritage", "anthropology", "sociology", "genealogy",
    "essex", "sextant", "winter", "window", "spa", "crackers", "traction", "attraction", "cheap-flights", "free-software", "open-source",
)
_TOPS, _SUBS = ("com", "net", "org", "io", "example.com", "example.net", "example.org"), ("", "", "www.", "m.", "blog.", "shop.")
_PLACES = ("en", "de", "fr", "es", "about", "articles/2024", "posts/2023", "category", "item", "view")
_TAILS = ("", "/", ".html", "/index.html", "/page.html", "/view")
#: Pairs of labelled URLs of a block word.
_PAIRS = 14


def _name(draw: random.Random) -> str:
    """An invented name, which says nothing of a host or path."""
    return "".join(draw.choice("bdfglmnprstvwhkcjz") + draw.choice(("", "", "h", "r", "l")) + draw.choice("aeiou") + draw.choice(("", "n", "r", "s", "l", "nd", "t")) for _ in range(draw.randint(1, 3)))


def labelled_urls() -> list[tuple[str, str]]:
    """The labelled table, always the same: pairs of URLs that differ in one place alone, where one has a block word
    and the other an ordinary word or an invented name, so that nothing else tells the labels apart."""
    draw, out = random.Random(7), []

    def plain() -> str:
        return draw.choice((_name(draw), _name(draw), draw.choice(ALLOW_WORDS), draw.choice(ALLOW_WORDS), f"{_name(draw)}-{draw.choice(ALLOW_WORDS)}"))

    def host(core: str) -> str:
        return f"http{draw.choice(('', 's'))}://{draw.choice(_SUBS)}{core}.{draw.choice(_TOPS)}"

    def path() -> str:
        return draw.choice((f"/{draw.choice(_PLACES)}/{draw.randint(1, 9999)}", f"/{draw.choice(_PLACES)}/{plain()}", f"/{plain()}/{draw.randint(1, 9999)}", f"/{plain()}", ""))

    for i in range(_PAIRS * len(BLOCK_WORDS)):
        name = plain()
        spot = draw.choice(("{}", "{}", f"{{}}-{name}", f"{name}-{{}}", f"{name}{{}}", f"{{}}{name}"))
        url = (host(spot) + path() if i // 2 % 2 else f"{host(plain())}{path()}/{spot}{path()}") + draw.choice(_TAILS)
        out.append((url.format(BLOCK_WORDS[i // _PAIRS]), url.format(plain())))
    # Two pairs alternate, so that every other row has whole pairs and both labels.
    return [(u, label) for two in zip(out[::2], out[1::2], strict=True) for at, label in enumerate(("block", "allow")) for u in (two[0][at], two[1][at])]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def buckets(host: Column, path: Column) -> Column:
    """Hash buckets of all character n-grams of host and path, whose beginnings differ; a word counts alike in either."""
    marked = (F.concat(F.lit("h^"), host, F.lit("$")), F.concat(F.lit("p^"), lower_ascii(path), F.lit("$")))
    return F.concat(*[_grams(text, n) for text in marked for n in SIZES])


def _grams(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n + 1, F.sequence(F.lit(2), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))


def fit(spark: SparkSession, labelled: list[tuple[str, str]] | None = None, rounds: int = 300, rate: float = 0.1, decay: float = 1e-5) -> tuple[list[float], float]:
    """Weights and bias by Adam on the weighted log loss, all rows in every step; block is the positive label."""
    labelled = labelled if labelled is not None else labelled_urls()
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs")
    if not labelled:
        return [0.0] * BUCKETS, 0.0
    table = spark.createDataFrame(labelled, "url string, label string")
    rows = table.select(buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("b"), (F.col("label") == "block").alias("y")).collect()
    row = np.repeat(np.arange(len(rows)), [len(r["b"]) for r in rows])
    col = np.array([b for r in rows for b in r["b"]], np.int64)
    x = np.array([1.0 / math.sqrt(len(r["b"])) for r in rows for _ in r["b"]])
    y = np.array([r["y"] for r in rows], np.float64)
    share = np.where(y > 0, 1.0, ALLOW_WEIGHT)
    share /= share.sum()
    w = np.zeros(BUCKETS + 1)  # the last is the bias
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, weights=w[col] * x, minlength=len(rows))
        e = (1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))) - y) * share
        grad = np.append(np.bincount(col, weights=e[row] * x, minlength=BUCKETS) + decay * w[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1.0 - 0.9**t)) / (np.sqrt(v / (1.0 - 0.999**t)) + 1e-10)
    return w[:-1].tolist(), float(w[-1])


def probability(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """The model's probability that a URL is to be blocked."""
    weights, bias = model
    table = F.expr(f"cast(split('{','.join(f'{x:.6f}' for x in weights)}', ',') as array<double>)")
    found = buckets(host, path)
    total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    z = F.lit(float(bias)) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits a host or its subdomains and starts the path: its string, its verdict."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name.otherwise(null), verdict.otherwise(null))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: tuple[list[float], float], threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) of pages(page_id, url).

    A null URL and one without :// have empty host and path, which the model judges as any other. Repeated rows
    are judged each; other columns are ignored.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("__verdict"), probability(F.col("host"), F.col("path"), model).alias("probability"))
    by_model = F.when(F.col("probability") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return base.select("page_id", "host", "path", "rule", F.coalesce("__verdict", by_model).alias("verdict"), "probability")
