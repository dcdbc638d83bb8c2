"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

Everything here is DataFrame operations and the JVM's tree trainer. The trees are fitted on labelled URLs, beyond SAMPLE
of them on a sample chosen by hash; every URL is then scored. No table of the corpus labels URLs, so without other
labels they are fitted on SEED_URLS, a small labelled collection that has no host in common with the corpus. No word
of a host counts: the trees see lengths, counts, shares, entropies and the suffix's statistics only.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.llm.common import broadcast_if_small, cut, lower_ascii

# Rules as (host and path, verdict).
RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]

# Labelled URLs. Good ones have the forms of news sites, shops, manuals and blogs; bad ones those of link
# farms, lotteries, fake shops and redirects. All are made up, after forms that public block lists describe.
SEED_URLS = {
    "allow": """https://www.dailyherald.com/en/2031 https://news.riverton.org/fr/4417.html https://blog.maple.net/de/88?page=2&ref=x http://library.university.edu/catalog/books/1204
https://m.weather.com/es/today https://docs.orchard.org/en/latest/install.html https://www.museum.org/exhibits/2024/ https://shop.lantern.com/item/5521?color=blue https://blog.harbor.com/2023/05/sailing
https://www.cookbook.net/recipes/soup#top https://cityhall.gov/services/permits https://forum.gardeners.org/topic/99812?page=3 https://wiki.sculpture.org/en/Marble https://www.railway.com/de/fahrplan/310.html
https://journal.biology.org/articles/7731 https://m.football.net/en/match/441 https://www.theatre.org/fr/saison/12?utm_source=feed https://support.camera.com/manual/en/15/ https://archive.radio.net/es/programa/1001#top
https://www.bakery.com/ https://blog.mountains.org/en/732?utm_source=feed https://api.maps.net/v2/tiles/14/8800/5370 https://news.science.com/en/1542.html https://www.chess.org/games/2019/round7
https://store.bicycles.com/en/parts/chain?size=11 https://m.cinema.com/fr/film/908/ https://www.hospital.org/en/contact https://dev.compiler.org/en/docs/types.html https://www.poetry.net/es/autor/55?page=4&ref=x
https://blog.winter.com/de/601#top https://school.org/en/lessons/3 https://www.aquarium.com/tickets?day=friday https://photos.islands.net/album/77 https://www.parliament.gov/en/debates/2022/11/08 https://m.theory.org/en/966/
https://language.net/de/grammatik/42.html https://www.thicket.com/en/100 https://blog.jardin.org/es/541?utm_source=feed https://m.heizung.net/de/72.html https://notable.com/fr/384#top https://www.commentaire.org/fr/19/
https://news.vallon.com/en/1730?page=2&ref=x https://pharmacy.university.edu/en/studies/12 https://www.freedom.org/en/44 https://casing.com/en/pipes/9.html https://www.winery.com/fr/cave/31 https://track.athletics.org/en/results/5""",
    "block": """http://best-lotto.jackpots.com/en/221 https://www.hot-deals.example-shop.com/fr/17.html https://quick-cash.loans.org/en/9?page=2&ref=x http://buy-meds.rx24.com/de/310 https://m.poker-king.games.net/es/72/
https://free-coins.clicks.com/en/5571?utm_source=feed http://www.link-swap.pages.org/en/88#top https://big-prize.draw.com/fr/401 https://m.super-slots.play.org/de/15.html http://replica-watch.store.net/en/1002/
https://www.fast-diet.herbs.com/es/93 https://click-here.redirect.com/en/12?page=2&ref=x http://date-now.singles.org/en/640.html https://www.seo-rank.boost.net/fr/27#top https://m.hack-tool.cracks.com/en/808 https://get-rich.forex.org/de/55/
http://x-cams.live.com/en/318?utm_source=feed https://www.gift-card.claims.net/es/46.html https://no-credit.loan.com/en/2201/ http://pop-up.adserver.org/fr/710 https://m.web-spam.blogs.com/en/39#top https://lucky-spin.wheel.net/de/144
http://cheap-tabs.pharma.org/en/501?page=2&ref=x https://www.serial-keys.warez.com/fr/68/ https://win-phone.survey.com/en/77.html http://secure-login.account-verify.com/update.php?id=8813&session=a81f&next=home&token=99
http://185.22.10.4/bin/setup.exe?x=1&y=2&z=3&k=4 https://paypa1-support.security-check.net/confirm/7731/9921 http://a8f3k2z9q1.top-offers.biz/r.php?c=99812&u=33&s=7 https://m.casino-club.bonus.com/es/61/ https://www.ad-clicks.traffic.org/en/450
https://bet-live.odds.com/en/1203?utm_source=feed http://www.porn-tube.videos.net/fr/33 https://m.pill-shop.drugs.com/de/92.html https://mail-blast.lists.org/en/17#top https://www.xx-girls.chat.com/en/29 https://fake-id.documents.net/es/808/
http://free-movies.stream-hd.com/en/4410.html https://www.debt-help.fast-money.org/fr/121?page=2&ref=x https://m.crypto-double.invest.com/en/7 http://seo-links.farm-pages.net/de/615#top https://blog.work-home.income.com/en/83""",
}

SAMPLE = 20_000  # labelled URLs that the trees are fitted on at most, half of them bad at most
SYMBOLS = string.ascii_lowercase + string.digits + "-._/"
FEATURES = ["length", "host_length", "labels", "longest_label", "hyphens", "host_digits", "depth", "digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "encoded", "suffix_rate", "suffix_rows"]


def parsed(urls: DataFrame, *more: str) -> DataFrame:
    """url, host (A-Z lower-cased) and path, after the columns `more`; both are empty for a null url or one without ://."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)"))
    out = urls.select(*more, "url", rest.alias("rest"))
    host = lower_ascii(F.regexp_extract("rest", r"\A([^/?#]*)", 1))
    path = F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1)
    return out.select(*more, "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def entropy(text: Column) -> Column:
    """Bits a character over SYMBOLS, counted without splitting the text into rows."""
    size = F.greatest(F.length(F.regexp_replace(text, r"[^a-z0-9\-._/]", "")), F.lit(1)).cast("double")
    terms = []
    for c in SYMBOLS:
        share = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / size
        terms.append(F.when(share > 0, -share * F.log2(share)).otherwise(0.0))
    return sum(terms[1:], terms[0])


def with_features(urls: DataFrame) -> DataFrame:
    """From columns url, host and path: the lexical features but the suffix statistics, and suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    features = {
        "length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "labels": F.size(labels).cast("double"),
        "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        "hyphens": count(F.col("host"), "-"),
        "host_digits": count(F.col("host"), "[0-9]"),
        "depth": count(F.col("path"), "/[^/]"),
        "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(F.lower(url)),
        "host_entropy": entropy(F.col("host")),
        "parameters": count(query, "[^&]+"),
        "query_length": F.length(query).cast("double"),
        "encoded": count(url, "%[0-9A-Fa-f]{2}"),
    }
    return urls.withColumns(features).withColumn("suffix", F.element_at(labels, -1))


def seed_labels(spark: SparkSession) -> DataFrame:
    """SEED_URLS as (url, label), label 1 for those to block."""
    rows = [F.struct(F.lit(url).alias("url"), F.lit(float(verdict == "block")).alias("label")) for verdict, urls in SEED_URLS.items() for url in urls.split()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """For each suffix of distinct labelled URLs (host, label): the share to block, drawn towards a half, and the log
    of their number. Over all of them, whatever the sample for the trees."""
    suffix = F.element_at(F.split("host", r"\."), -1).alias("suffix")
    return labelled.groupBy(suffix).agg(((F.sum("label") + 1) / (F.count("*") + 2)).alias("suffix_rate"), F.log1p(F.count("*")).alias("suffix_rows"))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 3) -> tuple[GBTClassificationModel, DataFrame]:
    """Fits trees on (url, host, path, label), beyond `sample` rows on a hash-chosen sample; returns them with the
    suffix statistics of all rows."""
    distinct = cut(labelled.select("url", "host", "path", "label").distinct())
    counts = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    place = (F.xxhash64("url") / F.lit(float(1 << 63)) + 1) / 2
    share = lambda label: min(1.0, sample / 2 * 0.95 / max(1, counts.get(label, 0)))
    few = distinct.filter(place < F.when(F.col("label") == 1, share(1.0)).otherwise(share(0.0)))
    suffixes = cut(suffix_statistics(distinct))
    rows = cut(assembled(with_features(few), suffixes).select("url", "features", "label").coalesce(1).sortWithinPartitions("url"))
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(rows), suffixes


def assembled(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds the feature vector. Suffix statistics are broadcast if their size allows it."""
    joined = rows.join(broadcast_if_small(suffixes), "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_rows": 0.0})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each row of `pages`: page_id, host, path, rule, verdict (allow or block), score (the trees'
    probability of block) and judged_by (rule or trees).

    Takes page_id and url; other columns are left out. `labelled` (url, label 0 or 1) trains the trees; without it
    SEED_URLS does. The rows that are judged are never what the trees learn from, unless `labelled` holds them. A rule
    fits its host and all subdomains if the path starts with the rule's; the longest fitting rule decides, else the
    trees (block from a score of 0.5). A null url, or one without ://, has an empty host and path and is judged by the
    trees. If all labels are alike there is nothing to learn: the score is that label. Very long URLs are read whole,
    in time in proportion. Repeated rows come out alike; an empty table gives an empty table.
    """
    rows = parsed(pages, "page_id")
    known = seed_labels(pages.sparkSession) if labelled is None else labelled.withColumn("label", F.col("label").cast("double"))
    known = parsed(known, "label").filter("url IS NOT NULL AND label IS NOT NULL")
    seen = [r[0] for r in known.select("label").distinct().collect()]
    if len(seen) < 2:
        scored = rows.withColumn("score", F.lit(seen[0] if seen else 0.0))
    else:
        model, suffixes = train(known)
        scored = model.transform(assembled(with_features(rows), suffixes)).withColumn("score", vector_to_array("probability")[1])
    out = scored.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    by = F.when(F.col("fit").isNotNull(), "rule").otherwise("trees").alias("judged_by")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score", by)
