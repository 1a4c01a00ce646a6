"""URL filters: rules over host and path, and for the rest a logistic regression on hashed character n-grams.

The model is fitted on the small labelled table of urls below (its size is the bound on what the driver holds); rules go first, and only urls that none fits are scored. A rule fits its host
and all subdomains of it if the path starts with the rule's path; the longest rule wins, then block before allow.

The intercept is below zero: of what the model knows nothing of is allowed.

Defined results: a null url, and one without "://", has an empty host and path, fits no rule and is allowed. Repeated rows are judged alike; other columns of the input are kept, but for
those named host, path, rule, score or verdict.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path); fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BUCKETS, GRAMS, EPOCHS, RATE, RIDGE, BIAS = 1 << 16, (3, 4, 5), 2000, 0.5, 1e-4, -0.5
ENDINGS = ("com", "org", "net")
#: Hosts whose score a task keeps.
CACHE = 100_000

#: The labelled table: urls to keep, then urls to block (gambling, adult, counterfeit and pills, loans, spam, advertising and tracking, malware).
KEEP = """
en.wikipedia.org/wiki/Photosynthesis de.wikipedia.org/wiki/Mathematik www.bbc.co.uk/news/science-environment-65432109 www.theguardian.com/world/2021/may/04/elections
www.reuters.com/business/energy/oil-prices-rise lemonde.fr/planete/article/2020/11/03/climat www.spiegel.de/wissenschaft/natur/artikel-12.html elpais.com/cultura/2019-08-12/libros.html
www.nature.com/articles/s41586-020-2649-2 www.science.org/doi/10.1126/science.abc pubmed.ncbi.nlm.nih.gov/31452104/ www.jstor.org/stable/2118478
stanford.edu/class/cs224n/ ocw.mit.edu/courses/mathematics/18-06/ www.ox.ac.uk/research ethz.ch/de/studium.html www.u-tokyo.ac.jp/en/about.html
docs.python.org/3/library/itertools.html developer.mozilla.org/en-US/docs/Web/HTTP github.com/torvalds/linux/blob/master/README gitlab.com/gitlab-org/gitlab/issues stackoverflow.com/questions/11227809/why
kernel.org/doc/html/latest/ postgresql.org/docs/current/sql-select.html spark.apache.org/docs/latest/sql-programming-guide.html www.w3.org/TR/html52/ rust-lang.org/learn
www.gutenberg.org/ebooks/1342 archive.org/details/texts www.loc.gov/collections/maps/ britannica.com/topic/feudalism plato.stanford.edu/entries/kant/ www.bl.uk/manuscripts/
www.nasa.gov/missions/voyager esa.int/Science_Exploration noaa.gov/weather/forecast www.usgs.gov/programs/earthquake-hazards www.metoffice.gov.uk/weather who.int/health-topics/malaria
www.cdc.gov/vaccines/index.html nhs.uk/conditions/asthma/ mayoclinic.org/diseases-conditions/migraine europa.eu/youreurope/citizens/travel www.un.org/en/about-us legislation.gov.uk/ukpga/2010/15/contents
www.congress.gov/bill/117th-congress bundestag.de/parlament/geschichte www.service-public.fr/particuliers stats.govt.nz/topics/population census.gov/data/tables.html data.worldbank.org/indicator/
www.allrecipes.com/recipe/10813/cookies/ seriouseats.com/bread-baking-guide chefkoch.de/rezepte/12345/Apfelkuchen.html www.bonappetit.com/story/soup gardenersworld.com/how-to/grow-plants/tomatoes/
www.rspb.org.uk/birds-and-wildlife/ nationalgeographic.com/animals/mammals/facts/wolf audubon.org/field-guide/bird/robin www.nationaltrust.org.uk/visit hikingproject.com/trail/7000130
museum.toulouse.fr/expositions www.louvre.fr/en/explore moma.org/collection/works rijksmuseum.nl/en/stories tate.org.uk/art/artists operabase.com/productions imslp.org/wiki/Sonata
www.ravelry.com/patterns/library instructables.com/Bookshelf woodmagazine.com/plans www.fishing-forum.co.uk/topic/lures chess.com/lessons boardgamegeek.com/boardgame/13
www.goodreads.com/book/show/5907 librarything.com/work/1386 poetryfoundation.org/poems/44272 www.thesaurus.com/browse/bright deepl.com/translator wordreference.com/enfr/cheese
www.openstreetmap.org/way/23 rome2rio.com/s/Paris/Lyon www.lonelyplanet.com/japan/kyoto bahn.de/service/fahrplaene nationalrail.co.uk/stations/leeds wanderlust.blogspot.com/2012/03/andes.html
myfamilyhistory.wordpress.com/2015/06/letters sourdough-notes.net/starter oldmaps.ch/zurich choir-of-st-mary.org/concerts riverside-school.k12.or.us/calendar smalltown-gazette.com/council-minutes
www.etsy.com/listing/55/teapot ikea.com/gb/en/p/bookcase johnlewis.com/kitchen powells.com/book/used www.decathlon.fr/velo zeit.de/gesellschaft/schule asahi.com/articles/kyoto.html
""".split()
BLOCK = """
best-online-casino-bonus.com/register casinoroyale888.net/slots/free www.jackpotcity-casino.win/deposit megaslots777.top/spin luckywinnerz.xyz/claim?id=1 pokerstars-bonus.club/signup
bet247live.com/odds/football www.sportbets-tips.info/today freebet-offers.biz/bonus roulette-system-win.net/guaranteed betting-sites-uk.top/list lottowinners.click/prize
888slotgame.vip/login w88bet.xyz/promo judi-bola-online.info/daftar situs-slot-gacor.top/ togel4d.club/main win-big-money-now.com/start bingo-freespins.online/play
hotxxxvideos.tube/watch/123 freeporntube.xxx/video-9 www.livesexcams.cam/room/anna adultdating-local.date/join milfhookup.club/chat nude-teens18.top/gallery sexchat4free.net/
escortgirls-city.info/vip hentai-hd.tube/view eroticstories69.com/read porn4k.download/free camgirlz.live/now onlyfansleaks.xyz/pack fuckbuddies.site/ adultfriend-finder.click/aff
cheapviagra-online.biz/buy cialis-without-prescription.com/order buy-pills-cheap.top/ canadian-pharmacy24.net/meds dietpills-miracle.info/loseweight xanax-overnight.shop/cart steroids4sale.biz/
replica-watches-outlet.com/rolex fakeraybans.shop/sale louisvuitton-cheap.store/bags jerseys-wholesale-china.us/nfl uggboots-discount.top/ cheap-nike-airmax.xyz/shoes outlet-handbags-sale.club/
fast-payday-loans-online.com/apply bad-credit-cash.loan/now instantloan4u.top/form forex-robot-profit.net/invest doubleyourbitcoin.io/send crypto-giveaway-elon.live/ binaryoptions-signals.biz/
make-money-from-home.click/secret earn5000daily.xyz/ref=22 getrichquick-system.info/ workathome-cash.top/offer mlm-leads-pro.biz/
ads.doubleclick-serve.net/adclick?x=1 adserver.popunder-media.com/banner/300x250 track.clickbank-aff.com/aff_c?offer_id=3 pixel.trackerhub.io/collect.gif banner-exchange.biz/rotate.php adnetwork-cpm.info/js/pop.js
pushnotify-ads.xyz/sw.js clicktracking.email-blast.info/open?uid=9 analytics-spy.net/beacon affiliate-redirect.click/go.php?url= popcash-serve.top/serve retarget-ads.co/px
buy-backlinks-cheap.com/seo linkfarm-directory.info/submit article-spinner-spam.biz/ guestpost-spam.top/list bulk-email-sender.net/download blogspam-network.xyz/ expired-domains-parking.com/search
free-keygen-crack.download/serial warez-full-version.top/setup.exe download-codec-now.xyz/player.exe your-pc-infected.click/scan antivirus-alert-warning.info/fix flashplayer-update.download/
paypal-verify-account.xyz/login secure-bank-login-update.top/confirm appleid-unlock.info/verify free-iphone-winner.club/claim giftcard-generator.win/steam survey-prize-claim.top/ nigerian-inheritance.biz/
torrent-movies-free.top/stream watch-hd-free-online.xyz/movie iptv-cracked.shop/list mp3-juice-free.download/ hack-facebook-password.click/ instagram-followers-free.top/
""".split()


def labelled() -> list[tuple[str, int]]:
    """(url, 1 to block) in a fixed order: each url of the table, and its longest label alone under a common ending, so that endings don't stand for names."""
    out = []
    for k, urls in enumerate((KEEP, BLOCK)):
        for url in urls:
            host = split_url(f"https://{url}")[0]
            name = max(host.split(".")[:-1], key=len)
            out += [(f"https://{url}", k), (f"https://{name}.{ENDINGS[zlib.crc32(host.encode()) % len(ENDINGS)]}/", k)]
    return sorted(out, key=lambda r: zlib.crc32(r[0].encode()))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. rules is a short stated list, so it becomes one CASE."""
    rule = verdict = None
    for what, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)) if rule is None else rule.when(fits, F.lit(name + start))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return rule, verdict


def split_url(url: str) -> tuple[str, str]:
    head, mark, rest = url.partition("://")
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest)) if mark else 0
    tail = rest[end:] if mark else ""
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].lower() if mark else "", tail[:stop]


def grams(kind: str, text: str) -> np.ndarray:
    """Buckets of the distinct character n-grams of a host or path; ^ and $ mark its ends."""
    if not text:
        return np.zeros(0, np.int64)
    s = f"^{text}$"
    return np.array(sorted({zlib.crc32(f"{kind}{s[i : i + n]}".encode()) % BUCKETS for n in GRAMS for i in range(len(s) - n + 1)}),
                    np.int64)


class UrlModel:
    """Logistic regression by full-batch gradient steps with a fixed intercept; deterministic."""

    def __init__(self, rows: list[tuple[str, int]]) -> None:
        x = [np.concatenate([grams("h", h), grams("p", p)]) for h, p in (split_url(u) for u, _ in rows)]
        y = np.array([label for _, label in rows], float)
        row = np.repeat(np.arange(len(x)), [len(v) for v in x])
        col = np.concatenate(x) if x else np.zeros(0, np.int64)
        scale = 1 / np.sqrt(np.maximum([len(v) for v in x], 1))
        self.weights, self.bias, self.hosts = np.zeros(BUCKETS), BIAS, {}
        for _ in range(EPOCHS):
            z = np.bincount(row, self.weights[col], len(x)) * scale + self.bias
            gap = 1 / (1 + np.exp(-z)) - y
            grad = np.bincount(col, (gap * scale)[row], BUCKETS) / max(len(x), 1)
            self.weights -= RATE * 10 * (grad + RIDGE * self.weights)

    def score(self, host: str, path: str) -> float:
        """Log odds that the url is to be blocked."""
        if host not in self.hosts:
            if len(self.hosts) >= CACHE:
                self.hosts.clear()
            own = grams("h", host)
            self.hosts[host] = float(self.weights[own].sum()), len(own)
        total, n = self.hosts[host]
        own = grams("p", path)
        return (total + float(self.weights[own].sum())) / max(n + len(own), 1) ** 0.5 + self.bias


def judged(pages: DataFrame, rules=RULES, rows: list[tuple[str, int]] | None = None) -> DataFrame:
    """pages(url, ...) plus host, path, rule, score, verdict."""
    model = UrlModel(labelled() if rows is None else rows)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([model.score(h, p) for h, p in zip(host, path, strict=True)], dtype=float)

    split = pages.drop("host", "path", "rule", "score", "verdict").withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    open_ = split.withColumns({"rule": rule, "__said": verdict})
    # a url that a rule decides is given to the model as nothing
    blank = lambda c: F.when(F.col("__said").isNull(), F.col(c)).otherwise("")
    return (open_.withColumn("score", score(blank("host"), blank("path"))).withColumn("score", F.when(F.col("__said").isNull(), F.col("score")))
            .withColumn("verdict", F.coalesce("__said", F.when(F.col("score") > 0, "block").otherwise("allow"))).drop("__said"))


def op10_urls(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
