"""URL filtering: rules first, then the ratio of two character language models.

Rules name a host and the start of a path; the longest rule that fits decides. URLs that a rule allows or blocks are
the accepted and rejected examples of two smoothed variable-order Markov models over characters. A URL without a rule
is scored by the difference of the models' log-likelihoods, divided by its length, and blocked below a threshold that
is calibrated on examples which the models haven't seen.

The models are fitted on at most SAMPLE whole examples of each kind (the least hashes of the URL) that have SAMPLE_CHARS
characters in all, so what is broadcast is bounded; every URL is scored, whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SAMPLE, SAMPLE_CHARS, ORDER = 10_000, 2_000_000, 5  # examples of each kind and their characters, characters of context


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or the end; A-Z lower-cased) and path (then up to ? # or the end); both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host or a parent domain of it and the start of the path, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


class MarkovModel:
    """Characters under contexts of up to ORDER characters; each order is smoothed by the one below (Witten-Bell), the lowest by equal chances."""

    def __init__(self, urls: list[str], order: int = ORDER):
        self.order = order
        self.next: list[dict[str, Counter]] = [{} for _ in range(order + 1)]
        for u in urls:
            t = "\x02" * order + u + "\x03"
            for i in range(order, len(t)):
                for n in range(order + 1):
                    self.next[n].setdefault(t[i - n : i], Counter())[t[i]] += 1
        self.total = [{c: (sum(k.values()), len(k)) for c, k in level.items()} for level in self.next]
        self.memo: dict[tuple[str, str], float] = {}

    def chance(self, context: str, c: str) -> float:
        p = 1 / 0x110000
        for n in range(self.order + 1):
            s = context[len(context) - n :]
            got = self.total[n].get(s)
            if got is None:
                break
            total, kinds = got
            p = (self.next[n][s].get(c, 0) + kinds * p) / (total + kinds)
        return p

    def log_likelihood(self, url: str) -> float:
        if len(self.memo) > 500_000:
            self.memo.clear()
        t, out = "\x02" * self.order + url + "\x03", 0.0
        for i in range(self.order, len(t)):
            key = (t[i - self.order : i], t[i])
            got = self.memo.get(key)
            if got is None:
                got = self.memo[key] = math.log(self.chance(*key))
            out += got
        return out


class UrlRatio:
    """Both models and the threshold."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        self.good = MarkovModel([x for i, x in enumerate(accepted) if i % 5 != 4])
        self.bad = MarkovModel([x for i, x in enumerate(rejected) if i % 5 != 4])
        self.threshold = 0.0
        a = np.sort([self.score(x) for x in accepted[4::5]])
        r = np.sort([self.score(x) for x in rejected[4::5]])
        if len(a) and len(r):  # the threshold with the best mean of both kinds' accuracy; the middle of equal ones
            marks = np.unique(np.concatenate([a, r]))
            cuts = np.concatenate([[marks[0]], (marks[1:] + marks[:-1]) / 2, [marks[-1] + 1]])
            right = (len(a) - np.searchsorted(a, cuts)) / len(a) + np.searchsorted(r, cuts) / len(r)
            best = np.flatnonzero(right >= right.max() - 1e-12)
            self.threshold = float(cuts[best[len(best) // 2]])

    def score(self, url: str) -> float:
        return (self.good.log_likelihood(url) - self.bad.log_likelihood(url)) / (len(url) + 1)


def _examples(urls: DataFrame, sample: int) -> list[str]:
    """The URLs of the least hashes, as long as they fit the budget of characters; the first always."""
    sizes = urls.select("h", F.length("u").alias("n")).orderBy("h").limit(sample).collect()
    total, last = 0, None
    for r in sizes:
        total += r.n
        if last is not None and total > SAMPLE_CHARS:
            break
        last = r.h
    return [] if last is None else [r.u for r in urls.filter(F.col("h") <= last).orderBy("h", "u").limit(sample).collect()]


def filter_urls(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """pages with url_host, url_path, url_rule, url_verdict (allow or block) and url_score (null where a rule decides).

    A null URL, or one without ://, has an empty host and path, so no rule fits; it is scored as an empty string or as
    it is. If no rule yields examples of both kinds, all other URLs are allowed with a null score. Repeated rows are judged alike.
    An empty table gives an empty result. Added columns replace those of the same name.
    """
    host, path = url_parts(F.col(url_col))
    name, verdict = rule_columns(F.col("url_host"), F.col("url_path"), rules)
    d = pages.withColumn("url_host", host).withColumn("url_path", path).withColumn("url_rule", name).withColumn("url_verdict", verdict)
    seen = d.filter("url_verdict is not null").select(F.col(url_col).alias("u"), "url_verdict").distinct().withColumn("h", F.xxhash64("u"))
    kinds = {k: _examples(seen.filter(F.col("url_verdict") == k), sample) for k in ("allow", "block")}
    if not all(kinds.values()):
        return d.withColumn("url_score", F.lit(None).cast("double")).withColumn("url_verdict", F.coalesce("url_verdict", F.lit("allow")))
    model = d.sparkSession.sparkContext.broadcast(UrlRatio(kinds["allow"], kinds["block"]))

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        m = model.value
        return urls.map(lambda u: m.score(u or ""))

    d = d.withColumn("url_score", F.when(F.col("url_verdict").isNull(), score(F.coalesce(F.col(url_col), F.lit("")))))
    return d.withColumn("url_verdict", F.coalesce("url_verdict", F.when(F.col("url_score") >= model.value.threshold, "allow").otherwise("block")))
