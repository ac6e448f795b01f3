"""URL filter: allow and block rules by host suffix and path prefix, then logistic regression on hashed character
n-grams of host and path. Everything on the tables is DataFrame expressions; only the small labelled table of URLs is
trained on the driver, in plain Python, and its weights enter the plan as one array.

A null URL, or one without `://`, has an empty host and path; no rule fits it and the model judges it by its bias.
Repeated rows are kept; an empty table gives no rows. Only page_id and url are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path): a rule fits its host and all subdomains if the URL's path starts with the rule's.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Rules up to which they are kept inside the plan; a larger table is joined.
RULES_IN_PLAN = 1_000
BUCKETS, GRAMS = 4_096, (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The small labelled URL table, 1 is to be blocked: kinds of hosts written by hand, none taken from the pages to be judged.
#: Both kinds come with the same paths, as a number or a language says nothing.
_BLOCKED = """casino-royal best-casino online-casino casino-bonus royalcasino casino-games vegas-slots lucky-slots free-slots spin-win bigwin-jackpot poker-win winpoker poker-room
bets-today sports-bets live-betting bet-online betmaster free-spins bingo-cash lotto-prize cash-prize win-cash cheap-meds pills-online buy-pills pharma-discount viagra-shop
cheap-viagra meds-order diet-pills adult-chat adult-video xxx-adult adult-cams hot-cams porn-tube free-porn sex-dating spam-blast spam-mail bulk-spam mail-spammer
link-farm seo-farm content-farm click-farm farm-links ads-server ads-network popup-ads banner-ads adsclick ad-track track-click click-track pixel-track tracker-ads
payday-loan cheap-loan fast-loans fake-watches replica-bags cheap-replica malware-kit phish-login login-verify warez-crack keygen-crack free-keygen crack-serial""".split()
_ALLOWED = """wikipedia library museum news garden university school cityhall weather recipes history science archive bookshop cinema theatre health forest river mountain islands bbc
guardian python github mozilla nature lemonde spiegel elpais openstreetmap gutenberg nasa europa unesco hospital chemistry physics mathworks linux debian apache kernel
wiki forum docs blog music sports travel cooking planet orchestra academy institute parliament ministry gazette herald tribune observer chronicle journal review
trackside farmers betterment adults-learning winter window enter center winchester pillow casing spinning slotted lotteries-museum banner pixelart clicks-and-mortar
open-data town-hall local-news city-library book-club high-school art-gallery bird-watch night-sky""".split()
#: Invented words of ordinary endings, which hold nothing that either kind is known by.
_PLAIN = [a + b for a in "ar bel cor dun el fen gar hol is jor kel lan mor nor ol pren quil rin sol tar ul ven wes yar".split() for b in ("ton", "dale", "ing", "and", "est", "ion")]
_TOPS, _PATHS = ("example.com", "example.net", "example.org", "test"), ("/en/{}", "/fr/{}", "/de/{}", "/es/{}", "/", "/{}", "/index.html", "/a/{}?page=2")


def labelled_urls() -> list[tuple[int, str]]:
    out = []
    for y, hosts in ((1, _BLOCKED), (0, _ALLOWED + _PLAIN)):
        for i, h in enumerate(hosts):
            front = ("", "www.", "m.", "blog.")[i % 4]
            out += [(y, f"http://{front}{h}.{_TOPS[(i + j) % 4]}{_PATHS[(i + 3 * j) % 8].format(1 + (i * 97 + j * 613) % 9000)}") for j in range(3)]
    return out


LABELLED = labelled_urls()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) after the first ://, and path; both empty where there is none."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def bucket_of(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:4], 16) % BUCKETS


def grams_of(url: str) -> list[str]:
    """The n-grams of a URL on the driver: as gram_buckets(), for the training table."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = host.translate(str.maketrans(UPPER, LOWER))
    return [f"{k}:{s[i:i + n]}" for k, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in GRAMS for i in range(len(s) - n + 1)]


@lru_cache(maxsize=4)
def train(labelled: tuple[tuple[int, str], ...] = tuple(LABELLED), rounds: int = 120, rate: float = 0.5, decay: float = 5e-4) -> tuple[float, ...]:
    """Weights by bucket, then the bias; rounded, so that every engine computes the same sums."""
    rows = []
    for y, url in labelled:
        at: dict[int, float] = {}
        for g in grams_of(url):
            b = bucket_of(g)
            at[b] = at.get(b, 0.0) + 1.0
        norm = math.sqrt(sum(at.values())) or 1.0
        rows.append((y, [(b, v / norm) for b, v in sorted(at.items())]))
    w, bias = [0.0] * BUCKETS, 0.0
    for r in range(rounds):
        for y, at in rows:
            d = 1 / (1 + math.exp(-sum(w[b] * v for b, v in at) - bias)) - y
            bias -= 0.1 * rate * d
            for b, v in at:
                w[b] -= rate * (d * v + decay * w[b])
    return (*[round(x, 4) for x in w], round(bias, 4))


def _grams(kind: str, s: Column) -> list[Column]:
    chars = F.filter(F.split(F.concat(F.lit("^"), s, F.lit("$")), ""), lambda c: c != "")
    out = []
    for n in GRAMS:
        many = F.greatest(F.size(chars) - (n - 1), F.lit(0))
        at = F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(at, _gram_at(kind, chars, n)))
    return out


def _gram_at(kind: str, chars: Column, n: int):
    return lambda i: F.concat(F.lit(f"{kind}:"), F.array_join(F.slice(chars, i, F.lit(n)), ""))


def model_score(host: Column, path: Column, weights: tuple[float, ...]) -> Column:
    """Probability that the URL is to be blocked."""
    grams = F.concat(*_grams("h", host), *_grams("p", path))
    w = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    bucket = lambda g: (F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(w, bucket(g)))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")) + F.lit(weights[-1]))))


def _ruled(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and ruling of the longest rule that fits (ties: the one that sorts first)."""
    parts = [(v, r, *r.split("/", 1)) for v, r in sorted(set(rules), key=lambda x: (-len(x[1]), x[1], x[0]))]
    if len(parts) <= RULES_IN_PLAN:
        fits = lambda h: (F.col("host") == h) | F.endswith("host", F.lit("." + h))
        rule = F.lit(None).cast("string")
        ruling = F.lit(None).cast("string")
        for v, r, h, p in reversed(parts):
            ok = fits(h) & F.startswith("path", F.lit("/" + p))
            rule, ruling = F.when(ok, F.lit(r)).otherwise(rule), F.when(ok, F.lit(v)).otherwise(ruling)
        return df.withColumns({"rule": rule, "ruling": ruling})
    table = df.sparkSession.createDataFrame([(v, r, h, "/" + p) for v, r, h, p in parts], "v string, r string, rh string, rp string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select("host", "path").distinct().withColumn("rh", F.explode(suffixes))
    best = hosts.join(table, "rh").where(F.startswith("path", "rp")).groupBy("host", "path").agg(F.min(F.struct((-F.length("r")).alias("n"), "r", "v")).alias("b"))
    return df.join(best, ["host", "path"], "left").withColumn("rule", F.col("b.r")).withColumn("ruling", F.col("b.v")).drop("b")


def judge(df: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, labelled: list[tuple[int, str]] = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (probability that the URL is to be blocked) of each row."""
    host, path = split_url(F.col(url))
    out = _ruled(df.select("page_id", host.alias("host"), path.alias("path")), rules)
    # a column of its own: the verdict and the rounded score use it, and it is computed once
    scored = out.withColumn("_score", model_score(F.col("host"), F.col("path"), train(tuple(labelled))))
    verdict = F.coalesce("ruling", F.when(F.col("_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("_score", 6).alias("score"))


def oracle() -> str:
    """The same in SQL, with the trained weights as a list."""
    w = train()
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    ordered = sorted(RULES, key=lambda x: -len(x[1]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[i]}'" for r in ordered) + " END"
    grams = " || ".join(f"list_transform(range(1, greatest(length({s}) + 2 - {n} + 1, 0) + 1), lambda i: '{k}:' || substring('^' || {s} || '$', i, {n}))" for k, s in (("h", "host"), ("p", "path")) for n in GRAMS)
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
g AS (SELECT *, {grams} AS grams, [{", ".join(map(str, w[:-1]))}] AS w FROM u),
s AS (SELECT *, coalesce(list_sum(list_transform(grams, lambda g: w[(('0x' || substring(md5(g), 1, 4))::INT % {BUCKETS}) + 1])), 0)
              / sqrt(greatest(len(grams), 1)) + ({w[-1]}) AS z FROM g)
SELECT page_id, host, path, {case(1)} AS rule,
       coalesce({case(0)}, CASE WHEN z >= 0 THEN 'block' ELSE 'allow' END) AS verdict, round(1 / (1 + exp(-z)), 6) AS score FROM s"""
