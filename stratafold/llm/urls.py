"""URL filters: longest-match rules first, else a logistic model, native to Spark.

The model is a logistic regression on hashed character n-grams of host and path,
trained from a small labelled URL table.  Features are built-in column expressions
in training and scoring alike; weights are fixed-point integers, so scores are exact
sums.  Scoring is a projection: no join, shuffle or Python on the rows.

The labelled table is made from general vocabulary by a rule; every fifth host name is
held out of training, so that :func:`accuracy` can speak of names unseen.

Defined results: a null url, or one without ``://``, has an empty host and path, fits
no rule and is judged by the model's bias alone; very long urls are read whole, in
memory of a few times their length; repeated rows are judged alike; extra columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the query, as (verdict, host suffix and path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SIZES = (3, 4)
BUCKETS = 8192
SCALE = 1 << 24
#: A labelled table is refused above this, since it is trained on in the driver.
MAX_LABELLED = 20_000

#: General vocabulary of unwanted hosts: adult, gambling, medicine, advertising, fraud, malware.
UNWANTED = """adult porn xxx nude webcam erotic hentai escort hookup fetish striptease naked sexy dating
casino poker roulette blackjack jackpot slots bet betting bookmaker lottery bingo gamble baccarat vegas
pill viagra cialis pharmacy tramadol xanax slimming steroid meds diet-pills
ads adserver adclick tracker popunder banner clickbait affiliate doubleclick
spam phishing trojan keygen warez crack torrent botnet spyware linkfarm
payday loan prize winner replica rolex miracle forex giveaway ransom""".split()
#: General vocabulary of wanted hosts.
WANTED = """library museum history science garden news docs weather school recipes travel music health maps
books sports theatre council railway nature kitchen village physics chemistry painting writing reading
teacher student nursery hospital dentist bakery brewery fishing sailing climbing hiking cycling swimming
football chess orchestra choir gallery archive journal gazette herald tribune courier observer bulletin
university college institute academy faculty lecture seminar research statistics mathematics geometry
astronomy biology geology botany forest river mountain island harbour bridge station airport market
farmers builders plumbers carpenter electric energy solar wind water climate planet ocean earth
family parents children toys wedding photo camera film cinema radio television guitar piano violin
language dictionary grammar translation poetry novel author editor printing publishing software computer
network database server cloud code open source project forum wiki blog notes diary letters post mail
bank insurance pension housing estate planning parish church temple heritage castle palace monument""".split()
#: Neutral words that go with either kind.
AROUND = ["the", "my", "best", "online", "free", "daily", "new", "top", "city", "world", "shop", "hub", "win", "cheap", "x"]
SHAPES = [
    "http://{n}.net/{p}", "https://www.{n}.com/{p}.html", "https://blog.{n}.org/{p}/", "http://m.{n}.co.uk/{p}?id=7", "https://{n}.example.com/{p}#start",
    "http://www.{n}.example.net/en/{p}", "https://{n}.example.org/fr/{p}/", "http://{n}.info/de/{p}.html", "https://m.{n}.example.net/es/{p}?page=2",
]


def _dice(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def _invented(i: int) -> str:
    """A name of no meaning, from the letters alone."""
    consonants, vowels = "bcdfghjklmnprstvwz", "aeiou"
    return "".join((consonants, vowels)[k % 2][_dice(i, k) % (18, 5)[k % 2]] for k in range(4 + _dice(i) % 6))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, bad, held_out), made from a rule: each word alone
    and with neutral words, in several shapes of address with paths of either kind."""
    subjects = [(w, 1) for w in UNWANTED] + [(w, 0) for w in WANTED] + [(_invented(i), 0) for i in range(400)]
    rows = []
    for word, bad in subjects:
        for k in range(24 if bad else 6):
            other, join = AROUND[_dice(word, k) % len(AROUND)], ("-", "")[_dice(word, k, "join") % 2]
            name = (word, f"{other}{join}{word}", f"{word}{join}{other}")[k % 3]
            url = SHAPES[_dice(word, k, "shape") % len(SHAPES)].format(n=name, p=_dice(word, k, "path") % 1000)
            rows.append((url, bad, _dice(name) % 5 == 0))
    return spark.createDataFrame(rows, "url string, bad int, held_out boolean")


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]], host_col: Column, path_col: Column, pick: int) -> Column:
    """The verdict (pick 0) or text (pick 1) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1])):
        suffix, _, prefix = rule[1].partition("/")
        fits = ((host_col == suffix) | host_col.endswith("." + suffix)) & path_col.startswith("/" + prefix)
        out = F.when(fits, F.lit(rule[pick])).otherwise(out)
    return out


def buckets(host_col: Column, path_col: Column, sizes: tuple[int, ...] = SIZES, n: int = BUCKETS) -> Column:
    """Distinct hashed n-grams of "<host> <path>" with a mark at either end."""
    text = F.concat(F.lit("^"), host_col, F.lit(" "), path_col, F.lit("$"))
    # Cut into characters once: substrings by position would read the text for each.
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def grams(c: Column) -> Column:
        def of(size: int) -> Column:
            def gram(_: Column, i: Column) -> Column:
                return F.pmod(F.crc32(F.concat(*[F.get(c, i + k) for k in range(size)]).cast("binary")), F.lit(n)).cast("int")

            return F.transform(F.slice(c, 1, F.greatest(F.size(c) - (size - 1), F.lit(0))), gram)

        return F.array_distinct(F.concat(*[of(s) for s in sizes]))

    return F.element_at(F.transform(F.array(characters), grams), 1)


def train(labelled: DataFrame, rounds: int = 600, rate: float = 30.0, decay: float = 1e-5, n: int = BUCKETS) -> tuple[list[int], int]:
    """Fixed-point weights and bias, by full-batch gradient descent on the labelled
    table, which must be small: above MAX_LABELLED rows it is refused, never cut."""
    rows = labelled.where("bad is not null").select(buckets(host(F.col("url")), path(F.col("url")), n=n).alias("f"), "bad").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls")
    data = sorted((sorted(r["f"]), r["bad"]) for r in rows)
    sizes = np.array([max(len(f), 1) for f, _ in data])
    row, feature = np.repeat(np.arange(len(data)), [len(f) for f, _ in data]), np.array([i for f, _ in data for i in f], np.int64)
    bad, share = np.array([b for _, b in data], float), 1 / np.sqrt(sizes)
    weights, bias = np.zeros(n), 0.0
    seen = np.bincount(feature, minlength=n) > 0
    for _ in range(rounds if data else 0):
        z = bias + share * np.bincount(row, weights=weights[feature], minlength=len(data))
        error = (bad - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / len(data)
        step = np.bincount(feature, weights=(error * share)[row], minlength=n)
        bias += error.sum()
        weights += np.where(seen, rate * (step - decay * weights), 0.0)
    return [round(w * SCALE) for w in weights.tolist()], round(float(bias) * SCALE)


def score(features: Column, weights: list[int], bias: int) -> Column:
    """The model's log odds: the fixed-point sum over the root of the feature count."""
    # One literal that folds to a constant array.
    table = F.split(F.lit(" ".join(map(str, weights))), " ").cast("array<long>")
    total = F.aggregate(features, F.lit(0).cast("long"), lambda a, i: a + F.get(table, i))
    return (total / F.sqrt(F.greatest(F.size(features), F.lit(1))) + bias) / float(SCALE)


def judge(pages: DataFrame, weights: list[int], bias: int, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score)."""
    cut = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = cut.select("*", rule_of(rules, F.col("host"), F.col("path"), 1).alias("rule"), rule_of(rules, F.col("host"), F.col("path"), 0).alias("_said"), buckets(F.col("host"), F.col("path")).alias("_f"))
    scored = ruled.withColumn("score", score(F.col("_f"), weights, bias))
    verdict = F.coalesce("_said", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def accuracy(labelled: DataFrame, weights: list[int], bias: int) -> dict[int, float]:
    """The share of rows of each kind that the model alone judges right."""
    scored = labelled.select("bad", score(buckets(host(F.col("url")), path(F.col("url"))), weights, bias).alias("score"))
    return {r["bad"]: r["right"] for r in scored.groupBy("bad").agg(F.avg(((F.col("score") > 0).cast("int") == F.col("bad")).cast("int")).alias("right")).collect()}


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), *train(labelled_urls(spark).where("not held_out")))
