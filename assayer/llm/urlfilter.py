"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

A rule ``host/path`` fits its host and all subdomains if the URL's path starts with the rule's path; the
longest rule that fits decides. Other URLs get the trees' verdict: logistic boosting over binned lexical
features (lengths, depth, digit ratio, entropy, parameter counts, statistics of the host's suffixes).
The fit takes at most ``TRAINING`` labelled URLs, those with the smallest hashes; every row is judged.
As many trees are kept as give the least log loss on parts of the labelled URLs that they were not grown on,
none if noise is all there is: then every URL has the overall rate.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by
the trees like others; without labelled URLs of both kinds the trees allow everything; a URL of any length
is read whole; a URL with labels of both kinds is bad; of equally long rules that fit a block wins; repeated
rows are judged each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import in_arrow, prepare, table

#: The rules of the query: (verdict, rule).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
TRAINING = 20_000
TREES, LEVELS, BINS, RATE, LEAF, L2 = 60, 4, 32, 0.15, 20, 1.0
#: Least probability of a blocked URL.
CUT = 0.5
#: Parts of the training rows; suffix statistics of a part come from the others.
FOLDS = 5
#: Weight of the overall rate in a suffix's rate.
PRIOR = 20.0
RESULT = "page_id long, host string, path string, rule string, verdict string, score double"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    end = next((i for i in range(host, len(rest)) if rest[i] in "?#"), len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:host]), rest[host:end]


class Rules:
    """Rules by host. A rule is looked up for each suffix of a host at a dot."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host[host.lower()].append((f"/{path}" if "/" in rule else "", rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | tuple[None, None]:
        """The longest rule that fits (of equally long ones a block), and its verdict."""
        best: tuple = ()
        at = 0
        while host and at >= 0:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start):
                    best = max(best, (len(rule), verdict == "block", rule, verdict))
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best[2:] if best else (None, None)


# -- features ---------------------------------------------------------------------------------------

FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digits", "host_digits", "letters", "entropy", "host_entropy", "parameters", "query_length", "fragment", "hyphens", "longest_label", "longest_segment", "percent", "secure", "trailing_slash", "extension")


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host: str) -> list[str]:
    """The last one, two and three labels of a host."""
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2, 3)]


def lexical(url: str | None) -> list[float]:
    url = url or ""
    host, path = split_url(url)
    query = url.partition("#")[0].partition("?")[2]
    segments, labels = [s for s in path.split("/") if s], host.split(".")
    n, h = max(len(url), 1), max(len(host), 1)
    return [
        len(url),
        len(host),
        len(path),
        len(labels),
        len(segments),
        sum(map(str.isdigit, url)) / n,
        sum(map(str.isdigit, host)) / h,
        sum(map(str.isalpha, url)) / n,
        entropy(url),
        entropy(host),
        sum(map(bool, query.split("&"))),
        len(query),
        "#" in url,
        host.count("-"),
        max(map(len, labels)),
        max(map(len, segments), default=0),
        url.count("%"),
        url.startswith("https:"),
        path.endswith("/"),
        "." in (segments[-1] if segments else ""),
    ]


@dataclass
class Suffixes:
    """Smoothed shares of blocked URLs of host suffixes, and their counts."""

    rate: float
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, hosts: list[str], bad: list[int]) -> Suffixes:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for host, y in zip(hosts, bad, strict=True):
            for s in suffixes(host):
                counts[s][0] += 1
                counts[s][1] += y
        return cls(sum(bad) / max(len(bad), 1), {k: (v[0], v[1]) for k, v in counts.items()})

    def features(self, host: str) -> list[float]:
        out = []
        for s in suffixes(host):
            n, bad = self.counts.get(s, (0, 0))
            out += [(bad + PRIOR * self.rate) / (n + PRIOR), n / max(len(self.counts), 1)]
        return out


# -- trees ------------------------------------------------------------------------------------------


class Boosted:
    """Logistic gradient boosting of complete trees over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 0):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.start = math.log(p / (1 - p))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(len(y), self.start)
        for _ in range(trees or TREES):
            q = 1 / (1 + np.exp(-f))
            tree = self.grow(b, y - q, q * (1 - q))
            self.trees.append(tree)
            f += self.apply(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and bins of the inner nodes in level order, and the leaves' values."""
        inner = (1 << LEVELS) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS)
        node = np.zeros(len(g), np.int64)
        for level in range(LEVELS):
            width, base = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-9)
            local = node - base
            G, H = np.bincount(local, g, width), np.bincount(local, h, width)
            whole = G**2 / (H + L2)
            for j in range(b.shape[1]):
                at = local * (BINS + 1) + b[:, j]
                shape = (width, BINS + 1)
                gl, hl, n = (np.cumsum(np.bincount(at, w, width * (BINS + 1)).reshape(shape), 1) for w in (g, h, None))
                gain = gl**2 / (hl + L2) + (G[:, None] - gl) ** 2 / (H[:, None] - hl + L2) - whole[:, None]
                gain[(n < LEAF) | (n[:, -1:] - n < LEAF)] = -1
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                feature[base : base + width][better], cut[base : base + width][better] = j, k[better]
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        return feature, cut, RATE * np.bincount(leaf, g, 1 << LEVELS) / (np.bincount(leaf, h, 1 << LEVELS) + L2)

    @staticmethod
    def apply(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), np.int64)
        for _ in range(LEVELS):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node - len(feature)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.stages(x)[-1]

    def stages(self, x: np.ndarray) -> list[np.ndarray]:
        """Probabilities by no tree, by the first, by the first two, and so on."""
        b, f = self.binned(x), np.full(len(x), self.start)
        out = [1 / (1 + np.exp(-f))]
        for t in self.trees:
            f = f + self.apply(t, b)
            out.append(1 / (1 + np.exp(-f)))
        return out


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def best_number(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> int:
    """Of trees: the number with the least log loss on parts that they were not grown on."""
    total = np.zeros(TREES + 1)
    for k in range(FOLDS):
        out = fold == k
        if out.any() and 0 < y[~out].sum() < (~out).sum():
            total += [log_loss(p, y[out]) * out.sum() for p in Boosted(x[~out], y[~out]).stages(x[out])]
    return int(total.argmin())


class UrlModel:
    """Trees with the suffix statistics that their features need. Without both kinds of labels: allows all."""

    def __init__(self, urls: list[str], bad: list[int]):
        self.trees = None
        if len(set(bad)) < 2:
            return
        hosts = [split_url(u)[0] for u in urls]
        self.suffixes = Suffixes.of(hosts, bad)
        fold = np.arange(len(urls)) % FOLDS
        own: list[list[float]] = [[] for _ in urls]
        for k in range(FOLDS):  # a training row's statistics come from the other folds
            others = Suffixes.of([h for h, f in zip(hosts, fold, strict=True) if f != k], [y for y, f in zip(bad, fold, strict=True) if f != k])
            for i in np.flatnonzero(fold == k):
                own[i] = others.features(hosts[i])
        x, y = np.array([lexical(u) + x for u, x in zip(urls, own, strict=True)]), np.array(bad, np.float64)
        self.trees = Boosted(x, y, TREES)
        self.trees.trees = self.trees.trees[: best_number(x, y, fold)]

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Probabilities of being blocked."""
        if self.trees is None or not urls:
            return np.zeros(len(urls))
        return self.trees.probability(np.array([lexical(u) + self.suffixes.features(split_url(u)[0]) for u in urls]))


def train(labelled: DataFrame) -> UrlModel:
    """Fits on rows (url, bad): bad is 1 for URLs to block, 0 for others."""
    rows = labelled.where("url IS NOT NULL AND bad IS NOT NULL").groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    got = rows.orderBy(F.xxhash64("url"), "url").limit(TRAINING).collect()
    return UrlModel([r["url"] for r in got], [r["bad"] for r in got])


def _judge(rules: Rules, model: UrlModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(1).to_pylist()
            parts = [split_url(u) for u in urls]
            found = [rules.find(*p) for p in parts]
            scores = model.scores(urls)
            verdicts = [f[1] or ("block" if s >= CUT else "allow") for f, s in zip(found, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.string()) for x in ([p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], verdicts)), pa.array(scores, pa.float64())],
                names=[f.split()[0] for f in RESULT.split(", ")],
            )

    return run


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page (page_id, url): page_id, host, path, rule, verdict, score."""
    prepare(pages.sparkSession)
    return in_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), _judge(Rules(rules), train(labelled)), RESULT)


#: Words that mark a host as one to block, where a part of its name between dots or hyphens is one: kinds that public lists of
#: hosts block (gambling, pharmacy and adult spam, link farms, advertising).
MARKED = ("adult", "ads", "adserver", "bet", "bets", "betting", "casino", "gambling", "loans", "pharmacy", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "tracker", "viagra", "xxx")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URLs (url, bad): those of marked hosts are bad; others are labelled if their last number is a labelled document,
    bad if that is of low quality or toxic."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    marked = host.rlike(rf"(^|[.-])({'|'.join(MARKED)})([.-]|$)")
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("url", marked.alias("marked"), F.expr("try_cast(regexp_extract(url, '^[^:]*://[^/?#]*/[a-z]+/([0-9]+)', 1) AS long)").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int").alias("bad"))
    known = pages.where("NOT marked AND doc_id IS NOT NULL").join(labels, "doc_id").select("url", "bad")
    return known.unionByName(pages.where("marked").select("url", F.lit(1).alias("bad")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages``."""
    return filter_urls(table(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir))
