"""URL filters: rules first, then logistic regression on hashed character n-grams.

DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import LOWER, UPPER, table

#: The rules of the query: (host and path, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: The labelled URL table: well-known public sites by what they offer, as published
#: directories and block lists class them, and path forms.
WANTED = """
wikipedia.org wiktionary.org britannica.com archive.org gutenberg.org python.org github.com
gitlab.com stackoverflow.com kernel.org debian.org mozilla.org apache.org arxiv.org nature.com
sciencemag.org plos.org nih.gov nasa.gov noaa.gov loc.gov europa.eu who.int un.org unesco.org
bbc.co.uk theguardian.com reuters.com apnews.com nytimes.com lemonde.fr spiegel.de elpais.com
zeit.de corriere.it harvard.edu mit.edu stanford.edu berkeley.edu ox.ac.uk cam.ac.uk ethz.ch
coursera.org khanacademy.org openstreetmap.org weather.com accuweather.com allrecipes.com
epicurious.com seriouseats.com lonelyplanet.com tripadvisor.com nationalgeographic.com
smithsonianmag.com metmuseum.org britishmuseum.org moma.org louvre.fr imdb.com goodreads.com
librarything.com worldcat.org jstor.org mayoclinic.org webmd.com healthline.com gardenersworld.com
rhs.org.uk instructables.com ifixit.com wikihow.com medium.com wordpress.com blogspot.com
tumblr.com reddit.com quora.com flickr.com vimeo.com bandcamp.com soundcloud.com musicbrainz.org
espn.com fifa.com olympics.com chess.com boardgamegeek.com ikea.com etsy.com
""".split()
UNWANTED = """
doubleclick.net googlesyndication.com googleadservices.com adnxs.com adsrvr.org adform.net
adroll.com advertising.com adcolony.com admob.com adsterra.com propellerads.com popads.net
popcash.net exoclick.com juicyads.com trafficjunky.net clickadu.com taboola.com outbrain.com
criteo.com scorecardresearch.com quantserve.com hotjar.com mixpanel.com trackingsoft.com
statcounter.com clicktale.net adtracker.net bet365.com betfair.com betway.com betvictor.com
sportsbet.com.au unibet.com ladbrokes.com paddypower.com williamhill.com bwin.com 1xbet.com
pokerstars.com partypoker.com fulltiltpoker.com 888casino.com 888poker.com casino.com casino.org
leovegas.com casumo.com mrgreen.com jackpotcity.com slotomania.com pornhub.com xvideos.com xnxx.com
xhamster.com youporn.com redtube.com tube8.com brazzers.com chaturbate.com livejasmin.com
stripchat.com onlyfans.com adultfriendfinder.com adulttime.com ashleymadison.com literotica.com
canadianpharmacy.com onlinepharmacy.com viagra.com cialis.com edmeds.com buymeds.com pillstore.com
drugstore24.com paydayloans.com quickcash.com cashadvance.com fastloans.com moneytree.com
thepiratebay.org 1337x.to rarbg.to kickasstorrents.to warez-bb.org crackz.ws keygenguru.com
spamhaus-blocked.com mailspammer.com linkspam.com freelotto.com sweepstakes.com prizegrab.com
clickbank.com replicawatches.com getrichquick.com
""".split()
#: More wanted names: the commonest English nouns, as sites of clubs, shops and places have.
COMMON = """
time year people way day man thing woman life child world school state family student group
country problem hand part place case week company system program question work government
number night point home water room mother area money story fact month lot right study book eye
job word business issue side kind head house service friend father power hour game line end
member law car city community name president team minute idea body information back parent face
others level office door health person art war history party result change morning reason
research girl guy moment air teacher force education foot boy age policy music market sense
nation plan college interest death experience effect use class control field development role
effort rate heart light voice police mind street image season nature station garden river
mountain kitchen window summer winter library museum hospital church village island bridge
weather theatre brother sister daughter doctor engineer farmer painter writer
""".split()
#: Path forms of any site.
PATHS = ("/", "/index.html", "/about", "/2019/07/article-12", "/category/item?id=4", "/en/page/3")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host is what follows the first :// up to /, ?, # or the end, with
    A-Z lower-cased; path goes on up to ?, # or the end. Null or no ://: both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    of = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(of(1), UPPER, LOWER), of(2)


def rule_for(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    A rule is host/path: it fits its host and all subdomains, where the path starts with
    the rule's. Rules are looked up by each suffix of the host, so their number costs
    nothing per row."""
    by_host: dict[str, list] = {}
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        by_host.setdefault(h, []).append((rule, "/" + p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    entries = []
    for h, found in by_host.items():
        each = [F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for r, p, v in found]
        entries += [F.lit(h), F.array(*each)]
    of_host = F.create_map(*entries)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(of_host, s), F.array().cast("array<struct<size:int,rule:string,path:string,verdict:string>>"))))
    fit = F.filter(found, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def grams(host: Column, path: Column, size: int, dims: int) -> Column:
    """Hashed n-grams of ^host$path$, each once, as places from 0 to dims - 1."""
    s = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$"))
    at = F.sequence(F.lit(1), F.greatest(F.length(s) - (size - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.pmod(F.xxhash64(F.substring(s, i, F.lit(size))), F.lit(dims)).cast("int")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, block, site): two rows for each labelled site, with paths by turns."""
    rows = []
    named = [f"{word}.{('com', 'org', 'net')[k % 3]}" for k, word in enumerate(COMMON)]
    for sites, block in ((WANTED + named, 0), (UNWANTED, 1)):
        for k, site in enumerate(sites):
            for j in range(2):
                rows.append((f"https://{('', 'www.')[j]}{site}{PATHS[(k + 3 * j) % len(PATHS)]}", block, site))
    values = ", ".join(f"('{u}', {b}, '{s}')" for u, b, s in rows)
    return spark.sql(f"select * from values {values} as t(url, block, site)")


def _score(idx: Column, weights: list[float], bias: float) -> Column:
    w = F.array(*map(F.lit, weights)) if len(weights) < 64 else F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    return F.lit(bias) + F.aggregate(idx, F.lit(0.0), lambda a, i: a + F.get(w, i)) / F.sqrt(F.size(idx))


def train(labelled: DataFrame, size: int = 3, dims: int = 4096, rounds: int = 150, rate: float = 8.0, decay: float = 1e-4, most: int = 4000, least: int = 3) -> tuple[list[float], float]:
    """Weights and bias of the logistic regression, by full-batch gradient steps.

    ``labelled`` has url and block (0, 1; other values and nulls are left out; rows that
    repeat count as often). Of more than ``most`` rows those of the smallest hash are
    taken: that is the bound of the training sample, whose n-grams one job brings to the
    driver. N-grams of fewer than ``least`` rows tell of one site only and get no weight.
    No rows: zero weights and a bias that allows."""
    host, path = url_parts(F.col("url"))
    rows = labelled.where("block in (0, 1)").select("url", F.col("block").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(most)
    got = [(r.idx, len(r.idx) ** -0.5, r.y) for r in rows.select(grams(host, path, size, dims).alias("idx"), "y").collect()]
    w, bias, vel, vel_bias = [0.0] * dims, -1.0, [0.0] * dims, 0.0
    often = Counter(i for idx, _, _ in got for i in idx)
    got = [([i for i in idx if often[i] >= least], scale, y) for idx, scale, y in got]
    used = sorted({i for idx, _, _ in got for i in idx})
    for _ in range(rounds if got else 0):
        grad, grad_bias = dict.fromkeys(used, 0.0), 0.0
        for idx, scale, y in got:
            err = 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + scale * sum(w[i] for i in idx))))) - y
            grad_bias += err
            for i in idx:
                grad[i] += err * scale
        for i in used:
            vel[i] = 0.9 * vel[i] - rate * (grad[i] / len(got) + decay * w[i])
            w[i] += vel[i]
        vel_bias = 0.9 * vel_bias - 0.1 * rate * grad_bias / len(got)
        bias += vel_bias
    return w, bias


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, url: str = "url", size: int = 3, dims: int = 4096, threshold: float = 0.6, **options) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), verdict (allow or block) and
    block_score, the model's log-odds. Where no rule fits, a probability of at least
    ``threshold`` blocks: above a half, as a wanted page lost costs more.

    Null and odd urls have empty host and path and are judged like others; rows may
    repeat, urls be of any length. Columns of those names are replaced. No rows, no result."""
    w, bias = train(labelled, size, dims, **options)
    new = ("host", "path", "rule", "verdict", "block_score")
    h, p = url_parts(F.col(url))
    parts = pages.select(*[c for c in pages.columns if c not in new], h.alias("host"), p.alias("path"))
    scored = parts.withColumn("block_score", _score(grams(F.col("host"), F.col("path"), size, dims), w, bias))
    ruled = scored.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("block_score") >= math.log(threshold / (1 - threshold)), "block").otherwise("allow")
    return ruled.withColumn("verdict", F.coalesce(F.col("rule.verdict"), by_model)).withColumn("rule", F.col("rule.rule"))


def op9_query(spark, sf_dir):
    """Every page's host, path, rule and verdict; see ``judge_urls``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")
