"""URL filtering: explicit rules, and logistic regression on hashed character n-grams for the rest.

A rule is a host and a path prefix, written as one string; it fits its host and all subdomains. The longest rule that
fits decides. Where none fits, a logistic regression on hashed character n-grams of host and path decides;
it is trained on the driver from a small labelled table of at most ``MAX_LABELS`` URLs, and its weights (``BUCKETS`` numbers) go to the tasks.

Hosts, paths and rules are DataFrame expressions; only the score is a vectorised Python function, on distinct or repeated URLs alike.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; the model gives its verdict on the empty text.
Repeated rows are kept; an empty table gives an empty result; only page_id and url are read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
MAX_LABELS = 100_000

# Rules as (what to do, host and path prefix).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

# Words of unwanted sites by kind, and words of other sites. The labelled table's site names are made of them by rule. No word has a part of a site name of the test tables, so that figures on
# these are blind; a test holds that.
BLOCKED_WORDS = {
    "pharmacy": "pharmacy pharma meds tablets viagra cialis steroids xanax slimming diet dosage painkiller remedy prescription antibiotics",
    "gambling": "poker slots roulette jackpot gambling bookie lottery bingo wager gamble baccarat blackjack sportsbook odds punter",
    "pornography": "porn sexy xxx nude escort webcam hookup milf fetish erotic naughty lesbian stripper playmate",
    "money": "loans payday cash credit forex bitcoin profit earn rich prize giveaway gift bonus millionaire invest debt lender",
    "goods": "discount replica fake outlet clearance knockoff bargain counterfeit wholesale coupon sale rolex handbags",
    "search": "backlinks linkbuilding seo autopost doorway cloaker scraper clickbait pagerank bulkmail mailer",
    "adverts": "adserver banner popup popunder pixel clicks affiliate doubleclick retarget sponsor impressions bidder",
    "malware": "crack keygen warez torrent phish malware virus trojan hack exploit botnet ransom spyware",
}
ALLOWED_WORDS = (
    "news times herald gazette journal weather museum library school college university science physics history music concert theatre cinema film art gallery garden recipes "
    "kitchen bread travel rail station airport city village county council parish health clinic sport football cricket rowing chess docs wiki forum atlas maps river forest lake mountain "
    "ocean radio books poetry letters archive market bakery workshop tools code software data lab studio design craft family school energy water church bridge tower harbour "
    "information education foundation association nation region union mission vision fashion pension election opinion question tradition people table circle article temple simple little"
).split()
# Syllables of invented names, and parts that the table's URLs go through in turn, the same for both verdicts.
ONSETS, VOWELS, CODAS = "b c d f g h k l m n p r s t v w br ch cl dr gr pl sh st th tr".split(), "a e i o u ai ea ie ou".split(), " n r s l t m nd st th ng".split(" ")
PREFIXES, ENDINGS = ("", "www.", "m.", "blog."), (".com", ".net", ".org", ".info", ".co.uk", ".de", ".fr", ".es", ".io", ".edu", ".gov", ".eu")
PATHS = ("/", "/index.html", "/en/12", "/de/310/", "/fr/45.html", "/es/98?page=2", "/2021/05/a-title", "/tag/x", "/p?id=7#top")
SITES = 500


def invented(draw: random.Random) -> str:
    """A name of one to four syllables, some of them without a vowel, as in abbreviations."""
    return "".join(draw.choice(ONSETS) + draw.choice(("", *[draw.choice(VOWELS) for _ in range(3)])) + draw.choice(CODAS) for _ in range(draw.randint(1, 4)))


def labelled_sites(count: int = SITES, seed: int = 11) -> list[tuple[str, int]]:
    """Site names with their label, 1 for those to be blocked: two words of a list, with or without a hyphen or a number; of six allowed sites for each blocked one five have an invented name."""
    draw = random.Random(seed)
    bad = [w for words in BLOCKED_WORDS.values() for w in words.split()]

    def pair(words: list[str]) -> str:
        return draw.choice(words) + draw.choice(("-", "", "-")) + draw.choice(words) + draw.choice(("", "", "", str(draw.randint(1, 99))))

    made = [(pair(bad), 1) for _ in range(count)] + [(invented(draw) if k % 6 else pair(ALLOWED_WORDS), 0) for k in range(6 * count)]
    return list(dict(made).items())


def labelled_urls(sites: Sequence[tuple[str, int]] | None = None, seed: int = 12) -> list[tuple[str, int]]:
    """The labelled table: every site under prefixes, endings and paths in turn, once as a host of its own and once under the invented name of a provider; 1 is to be blocked. The empty URL is allowed."""
    sites = labelled_sites() if sites is None else sites
    draw = random.Random(seed)
    table = [("", 0)]
    for i, (site, label) in enumerate(sites):
        for j in range(2):
            k = 5 * i + 7 * j
            provider = f".{invented(draw)}" if j else ""
            table.append((f"https://{PREFIXES[k % len(PREFIXES)]}{site}{provider}{ENDINGS[k % len(ENDINGS)]}{PATHS[k % len(PATHS)]}", label))
    return table


_AFTER = r"^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)" + _AFTER, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)" + _AFTER, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits as struct<rule, verdict>, or null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def features(host: str, path: str) -> np.ndarray:
    """The buckets of the n-grams of host and path, each once."""
    grams = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = part.encode("utf-8", "replace")
        for n in SIZES:
            grams.update(zlib.crc32(mark.encode() + data[i : i + n]) % BUCKETS for i in range(len(data) - n + 1))
    return np.fromiter(sorted(grams), dtype=np.int64, count=len(grams))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path by the same rules as ``host_of`` and ``path_of``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(_UPPER, _LOWER)), slash + path


def train(labelled: Sequence[tuple[str, int]] | None = None, rounds: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on the mean log loss; 1 is to be blocked."""
    labelled = labelled_urls() if labelled is None else labelled
    if not 0 < len(labelled) <= MAX_LABELS:
        raise ValueError(f"1 to {MAX_LABELS} labelled URLs are needed")
    rows = [features(*split_url(u)) for u, _ in labelled]
    y = np.array([label for _, label in labelled], dtype=np.float64)
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        z = np.bincount(owner, weights[flat], len(rows)) * scale + bias
        wrong = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(flat, (wrong * scale)[owner], BUCKETS) + penalty * weights)
        bias -= rate * wrong.mean()
    return weights, bias


@lru_cache(maxsize=4)
def _trained(labelled: tuple[tuple[str, int], ...] | None) -> tuple[np.ndarray, float]:
    """``train``, once for a set of labels."""
    return train(labelled)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (the model's chance of block): a row for each row of ``pages``."""
    weights, bias = _trained(None if labelled is None else tuple(labelled))

    @F.arrow_udf("double")
    def chance(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for h, p in zip(hosts.to_pylist(), paths.to_pylist()):
            x = features(h, p)
            out.append(1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(max(1, len(x))) + bias))))
        return pa.array(out, pa.float64())

    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parts.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", chance("host", "path"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")
