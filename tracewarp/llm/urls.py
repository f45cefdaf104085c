"""URL verdicts: path rules first, then naive Bayes over segmented host and path tokens.

Host labels and path parts are split at anything that is not a letter; a part
that is several words written together is split by a unigram Viterbi search over
a fixed public vocabulary (probability by Zipf's law on its merge rank, unknown
parts by their length). A multinomial naive Bayes, trained on the short labelled
list below, scores the words. Its vocabulary is closed: unseen words say nothing.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule
and the prior's verdict (allow); repeated urls are judged alike; an empty table
gives no rows; other columns, ``html`` too, are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path

#: (rule, verdict): a host and a path prefix. The longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Labelled host and path phrases from which the naive Bayes learns.
BLOCKED = (
    "cheap pills online", "buy cheap viagra pills", "casino win big", "online casino bonus", "free bets now", "sports bets odds",
    "adult video x", "adult chat cams", "xxx free videos", "spam farm", "spam links farm", "ads track pixel", "track ads click server",
    "poker jackpot slots", "lottery win prize", "payday loan cash", "replica watches cheap", "porn tube", "sex dating", "escort adult",
    "malware download crack", "warez torrent crack keygen", "phishing login verify account", "click bait banner ads", "doubleclick ads tracker",
    "weight loss pills", "betting tips win", "gambling casino slots", "free money win", "hot singles dating", "adware popup ads", "pharmacy cheap meds",
)
ALLOWED = (
    "news daily", "city university library", "science journal article", "history museum archive", "open source project docs", "weather report today",
    "recipes kitchen garden", "travel guide city", "health clinic research", "school education teacher", "government public service", "music review magazine",
    "blog post notes", "page reference index", "book publisher author", "art gallery photo", "engineering software tutorial", "math physics lecture",
    "local community forum", "film theatre review", "sport club results", "language dictionary grammar", "nature park wildlife", "economy market analysis",
    "feed source utm", "www mobile site", "html page list", "wiki encyclopedia entry", "bank annual report", "farm animals village", "track field athletics", "free library books",
)
_LETTERS = re.compile("[a-z]+")
MAX_WORD = 24
THRESHOLD = 0.5


def host_column(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null. The first of equally long rules wins."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def load_unigrams(path: str | None = None) -> dict[str, float]:
    """Log probabilities of a public vocabulary's whole words, by Zipf's law on the rank."""
    with open(path or vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and _LETTERS.fullmatch(w[:-4]) and (len(w) > 5 or w[0] in "aix"))
    norm = math.log(sum(1 / (r + 1) for r in range(len(words))))
    # Merge order makes short letter pairs rank high whether words or not, so a rank costs something per letter saved.
    return {w: -math.log(r + 1) - norm for r, (_, w) in enumerate(words)}


class Segmenter:
    """Splits a run of letters into its most probable words."""

    def __init__(self, unigrams: dict[str, float], cache: int = 200_000):
        self.unigrams, self.cache, self.size = unigrams, {}, cache

    def cost(self, word: str) -> float:
        p = self.unigrams.get(word)
        return p if p is not None else -12.0 - 2.3 * len(word)

    def __call__(self, text: str) -> tuple[str, ...]:
        found = self.cache.get(text)
        if found is None:
            best, back = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
            for end in range(1, len(text) + 1):
                for start in range(max(0, end - MAX_WORD), end):
                    score = best[start] + self.cost(text[start:end])
                    if score > best[end]:
                        best[end], back[end] = score, start
            words, at = [], len(text)
            while at:
                words.append(text[back[at] : at])
                at = back[at]
            found = tuple(reversed(words))
            if len(self.cache) >= self.size:
                self.cache.clear()
            if len(text) <= 256:
                self.cache[text] = found
        return found


class NaiveBayes:
    """Multinomial naive Bayes over a closed vocabulary, with add-one smoothing."""

    def __init__(self, blocked=BLOCKED, allowed=ALLOWED):
        counts = [{}, {}]
        for k, lines in enumerate((allowed, blocked)):
            for line in lines:
                for word in line.split():
                    counts[k][word] = counts[k].get(word, 0) + 1
        vocabulary = sorted(set(counts[0]) | set(counts[1]))
        total = [sum(c.values()) + len(vocabulary) for c in counts]
        self.prior = math.log(len(blocked) / len(allowed)) - 1.0  # blocked hosts are the rarer kind
        self.weights = {w: math.log((counts[1].get(w, 0) + 1) / total[1]) - math.log((counts[0].get(w, 0) + 1) / total[0]) for w in vocabulary}

    def score(self, words) -> float:
        """Probability that the tokens belong to a blocked page."""
        x = self.prior + sum(self.weights.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def url_words(host: str, path: str, segment: Segmenter) -> list[str]:
    out = []
    for part in _LETTERS.findall(host) + _LETTERS.findall(path.lower()):
        out += segment(part)
    return out


def judge_urls(pages: DataFrame, rules=RULES, vocabulary: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, the method's score and the words it saw."""
    url = F.col("url").cast("string")
    host, path = host_column(url), path_column(url)
    split = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    shared = pages.sparkSession.sparkContext.broadcast(load_unigrams(vocabulary))  # a vocabulary of fixed size
    verdicts = dict(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, bayes = Segmenter(shared.value), NaiveBayes()
        for batch in batches:
            found, scores, seen = [], [], []
            for host, path, rule in zip(*(batch.column(n).to_pylist() for n in ("host", "path", "rule"))):
                words = url_words(host, path, segment)
                score = bayes.score(words)
                found.append(verdicts[rule] if rule is not None else "block" if score >= threshold else "allow")
                scores.append(score)
                seen.append(" ".join(words))
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(seen, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "verdict", "score", "words"])

    kind = dict(ruled.dtypes)["page_id"]
    return ruled.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double, words string")
