"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams.

The model is trained by full gradient steps over a small labelled URL table: each step is one DataFrame aggregation that
sums the gradient by bucket, and the weights of the next step stand in its plan as one literal of `buckets` numbers.  They
are rounded after each step, so the order in which tasks finish does not change them.  No sample is taken: all labelled
rows count in each step.  Scoring is a projection: no
shuffle, no Python, in time linear in the length of a URL.

Defined cases: a null URL, or one without "://", has an empty host and path; rules never fit it and the model judges
the empty strings by its bias.  URLs of any length are read whole.  Equal URLs get equal verdicts, repeated rows each stay.  Where two rules
of equal length fit, the one named first wins.  An empty table gives an empty result; an empty labelled table a model
that allows everything.  Columns of the input other than id and URL are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let

#: (verdict, host, path), the production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

# The labelled URL table of the production model: kinds of sites that a training corpus keeps out, and ordinary ones.
BLOCKED = """
http://www.lucky-casino.org/en/slots/12 https://casino-royal.net/play http://online-casinos.info/en/88 https://m.casinobonus.org/de/jackpot https://big-win-slots.net/en/7
http://poker-win.info/en/2 https://lotto-winner.org/fr/3 https://sports-bets.net/en/41 http://bet-now.info/de/17 https://freebets.org/en/9.html http://m.best-bets.info/odds?id=3
http://cheap-viagra.net/en/1 https://www.pills-online.org/en/53 http://discount-pills.info/buy.html https://cheapmeds.org/fr/6 http://diet-pills.net/de/8 https://cheap-replica.info/en/4
http://adult-videos.net/en/5 https://www.adultcams.org/en/3.html http://xxx-tube.info/watch?v=8 https://sexchat.net/en/99 http://hot-porn.org/fr/1 https://adult-dating.info/de/4
http://ads.tracker.net/pixel?id=4 https://adserver.info/en/banner https://track-click.org/en/6 http://www.ad-track.net/c?ref=x https://popup-ads.org/de/2 http://clicktracking.info/en/31
http://spam-links.org/en/2 https://link-farm.info/en/44 http://www.seo-spam.net/de/5 https://content-farm.org/en/3 http://spammail.info/fr/9 https://linkfarms.net/en/18
http://free-ringtones.info/en/6 https://payday-loans.org/en/23 http://fast-loan.net/de/1 https://warez-crack.info/en/70 http://free-cracks.org/fr/13 https://get-rich-quick.net/en/2
""".split()
ALLOWED = """
http://www.library.org/en/1204 https://museum.net/de/77 http://news.info/en/2019/05/article.html https://blog.harbour.org/fr/388 https://m.weather.net/en/5512 http://city-council.org/en/30
https://www.university.net/en/2841.html http://maths.info/de/912 https://recipes.org/fr/64#top http://gardening.net/en/73?page=2 https://history.org/en/417/ http://m.railways.info/de/5
https://opensource.org/licenses/9 http://docs.engine.net/en/api/3.html https://forum.bicycle.org/en/218?page=4 http://www.hospital.info/fr/12 https://blog.theatre.net/de/6021 http://choir.org/en/55
https://astronomy.net/en/7701 http://www.school.info/de/83/ https://encyclopedia.org/fr/1290.html http://birds.net/en/33#top https://blog.geology.info/en/9115 http://poetry.org/de/407
https://m.football.net/en/160?ref=x http://www.farming.org/en/2210 https://chemistry.info/fr/71 http://travel.net/de/504.html https://archive.org/en/details/77 http://music.info/en/318/
https://blog.thinker.net/en/4402 http://www.orchard.org/en/18?page=2 https://tension.info/de/66 http://m.stationery.net/fr/2051 https://thistle.org/en/930#top http://others.net/en/123.html
https://www.nation.org/fr/45 http://blog.whether.info/en/6 https://ration.net/en/7120 http://heating.org/de/29/ https://www.earth.info/en/84?utm_source=feed http://m.thither.net/de/370
https://shop.bakery.org/en/14 http://village.net/fr/950 https://www.parliament.info/en/bills/221 http://kitchen.org/en/3055.html https://blog.mountain.net/de/81 http://river.info/fr/460#top
""".split()


@dataclass(frozen=True)
class Model:
    """bias, weights by bucket, and how the n-grams are made."""

    bias: float
    weights: tuple[float, ...]
    sizes: tuple[int, ...]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where no "://" stands in the URL."""
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)([^?#]*)", k)
    return ascii_lower(part(1)), part(2)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct rule, verdict of the longest rule that fits; null where none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


#: A polynomial hash modulo a prime, by characters; host and path have seeds of their own.
FACTOR, PRIME, SEEDS = 65_599, 2_147_483_647, (1, 2)


def ngrams(host: Column, path: Column, buckets: int, sizes: tuple[int, ...]) -> Column:
    """The distinct buckets of all character n-grams of ^host$ and ^path$."""

    def of(text: Column, seed: int) -> Column:
        def hashed(codes: Column) -> Column:
            def grams(n: int) -> Column:
                def one(i: Column) -> Column:
                    h = F.lit(seed).cast("long")
                    for k in range(n):
                        h = (h * FACTOR + F.get(codes, i + k)) % PRIME
                    return (h % buckets).cast("int")

                last = F.size(codes) - n
                return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.array().cast("array<int>"))

            return F.flatten(F.array(*[grams(n) for n in sizes]))

        return let(F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), F.ascii), hashed)

    return F.array_distinct(F.concat(of(host, SEEDS[0]), of(path, SEEDS[1])))


def probability(found: Column, m: Model) -> Column:
    """Logistic function of the bias and the mean-scaled sum of the weights of the buckets found."""
    weights = F.split(F.lit(" ".join(f"{w:.6f}".rstrip("0").rstrip(".") if w else "0" for w in m.weights)), " ").cast("array<double>")  # folded to one literal
    total = F.aggregate(found, F.lit(0.0), lambda a, k: a + F.get(weights, k))
    return 1 / (1 + F.exp(-(m.bias + total / F.sqrt(F.greatest(F.size(found), F.lit(1))))))


#: Parameters of the production model: gradient steps with momentum, weight decay, and the share of the loss that the
#: blocked class has, however many rows it has.
BUCKETS, SIZES = 16_384, (3, 4, 5)
STEPS, RATE, MOMENTUM, DECAY, BLOCKED_SHARE = 20, 8.0, 0.9, 1e-3, 0.4


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked", buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, steps: int = STEPS) -> Model:
    """A model from URLs and whether they are to be blocked; rows without a label are not used.

    The driver holds one number for each bucket, whatever the size of the table.
    """
    host, path = parts(F.col(f"`{url}`"))
    rows = labelled.select(F.col(f"`{blocked}`").cast("boolean").alias("y"), host.alias("host"), path.alias("path")).filter("y IS NOT NULL")
    rows = cut(rows.select("y", ngrams(F.col("host"), F.col("path"), buckets, sizes).alias("found")), "labelled-urls")
    n = rows.agg(F.count_if("y").alias("yes"), F.count_if(~F.col("y")).alias("no")).first()
    if not n["yes"] or not n["no"]:
        return Model(4.0 if n["yes"] else -4.0, (0.0,) * buckets, sizes)
    share = F.when(F.col("y"), BLOCKED_SHARE / n["yes"]).otherwise((1 - BLOCKED_SHARE) / n["no"])
    w, speed = [0.0] * (buckets + 1), [0.0] * (buckets + 1)  # the last is the bias
    for _ in range(steps):
        error = (probability(F.col("found"), Model(w[-1], tuple(w[:-1]), sizes)) - F.when(F.col("y"), 1.0).otherwise(0.0)) * share
        each = rows.select("found", error.alias("e"))
        slope = each.select(F.explode(F.concat("found", F.array(F.lit(buckets)))).alias("k"), F.col("e"), F.sqrt(F.greatest(F.size("found"), F.lit(1))).alias("r"))
        sums = slope.groupBy("k").agg(F.sum(F.when(F.col("k") == buckets, F.col("e")).otherwise(F.col("e") / F.col("r"))).alias("d")).collect()  # buckets + 1 rows at most
        for r in sums:
            k = r["k"]
            speed[k] = round(MOMENTUM * speed[k] - RATE * (r["d"] + (DECAY * w[k] if k < buckets else 0.0)), 6)
            w[k] = round(w[k] + speed[k], 6)
    return Model(w[-1], tuple(w[:-1]), sizes)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, blocked of the production table."""
    one = lambda urls, y: f"SELECT explode(split('{' '.join(urls)}', ' ')) AS url, {y} AS blocked"
    return spark.sql(f"{one(BLOCKED, 'true')} UNION ALL {one(ALLOWED, 'false')}")


def judge(pages: DataFrame, model: Model, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (null without one), verdict (allow or block), score (the model's probability of block, null under a rule)."""
    host, path = parts(F.col(f"`{url}`"))
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.explode(F.array(F.struct(host.alias("host"), path.alias("path")))).alias("u")).select("page_id", "u.*")
    p = p.withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    score = F.when(F.col("r").isNull(), let(ngrams(F.col("host"), F.col("path"), len(model.weights), model.sizes), lambda b: probability(b, model)))
    p = p.select("page_id", "host", "path", F.col("r")["rule"].alias("rule"), F.col("r")["verdict"].alias("ruling"), score.alias("score"))
    return p.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
