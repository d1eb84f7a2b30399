"""Subject areas of documents, from latent Dirichlet topics.

1. `clean_labels`: a bounded sample of labelled documents, which is all that anything is learned from.
2. `content_words`: the words of the sample that speak for an area. Words of menus, notices and
   sentence frames stand in pages of all areas alike and fall out here, in whatever language.
3. `teaser_heads`: phrases that announce other pages, known by what follows them: it speaks for
   any area but the page's own.
4. `fit_topics`: latent Dirichlet models over the sample, distributed by Spark, one for each area's documents.
5. `topic_areas`: each topic is mapped to the area that its top terms speak for; topics whose top
   terms speak for none are put together as background.
6. `assign`: the topic proportions of every document, found with the topics held fixed, are its areas.
   The proportion from which an area counts is where the labelled documents agree best.

Only the sample is shuffled; all documents go through one map.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.garbled import repair, words
from tidewell.session import cut, ship

#: Labelled documents that are learned from, at most (by a hash of the key): bounds the words and topics that go to the executors.
LABELLED = 20_000


@dataclass(frozen=True)
class Limits:
    """Parameters of the topics and of the assignment."""

    #: Topics of each area's model, and its passes over the area's labelled documents.
    topics: int = 8
    iterations: int = 20
    #: Top terms of a topic that are inspected, and the share of them that must speak for one area.
    top: int = 40
    speaks: float = 0.6
    #: Words that a page needs, each counted by how far it is above half sure: one sure word is enough, two doubtful words aren't.
    least_words: float = 0.75
    #: Topic proportions among which the threshold is chosen.
    thresholds: tuple[float, ...] = tuple(k / 100 for k in range(10, 31))


_BEFORE_COLON = re.compile(r"([^\s:.!?©/|·>]+ )?([^\s:.!?©/|·>]+ [^\s:.!?©/|·>]+)\s?:([^\n©]{1,60})")
_FOREIGN = re.compile("[^\x00-\x7fЀ-ӿ]+")
#: What an announcement holds: a title, or two with a slash between. Without line breaks the second one ends with its last lower-case word.
_TITLES = r"\s?:[^\n©/]{1,60}(?:/(?:[^\n©]{1,60}(?=\n|©|$)|\s*\S+(?:\s[a-zа-яёß-ÿ]\S*)*))?"


def teaser_pattern(heads: list[str]) -> re.Pattern | None:
    """The pattern of announcements that begin with one of `heads`; letters with accents may have been garbled."""
    return re.compile("(?i:" + "|".join(".{1,2}".join(map(re.escape, h.split("¤"))) for h in heads) + ")" + _TITLES) if heads else None


def own_text(text: str | None, teaser: re.Pattern | None = None) -> list[str]:
    """The words of a page without its teasers; null and empty give none."""
    if not text:
        return []
    text = repair(text)
    return words(teaser.sub(" ", text) if teaser else text)


def clean_labels(labels: DataFrame, areas: list[str], key: str = "doc_id") -> DataFrame:
    """(key, areas): the distinct known areas of at most LABELLED labelled documents, in lower case, `none` as an empty list."""
    rows = labels.select(key, F.lower(F.trim("area")).alias("area")).where(F.col(key).isNotNull() & F.col("area").isin([*areas, "none"]))
    sets = rows.groupBy(key).agg(F.array_sort(F.array_remove(F.collect_set("area"), "none")).alias("areas"))
    return sets.orderBy(F.xxhash64(key), key).limit(LABELLED)


def _sample(documents: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(key, areas, text) of the labelled documents; in fixed order, so that the topics don't depend on how `documents` is stored."""
    rows = documents.where(F.length(text) > 0).select(key, F.col(text).alias("_text")).join(F.broadcast(labels), key)
    return cut(rows.dropDuplicates([key]).repartition(16, key).sortWithinPartitions(key))


def _tokens(sample: DataFrame, key: str, teaser: re.Pattern | None) -> DataFrame:
    """(key, areas, words) of the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "areas": pdf["areas"], "words": [own_text(t, teaser) for t in pdf["_text"]]})

    return sample.mapInPandas(run, f"{key} {dict(sample.dtypes)[key]}, areas array<string>, words array<string>")


def content_words(tokens: DataFrame, areas: list[str]) -> pd.DataFrame:
    """Words of the sample that speak for an area: (word, n, one column for each area).

    The last are shares, corrected for how often each area is labelled; pages labelled
    `none` count as an area of their own, so that words of error pages and forms fall out.
    Documents with several labels say nothing certain about a word, so they aren't taken.
    """
    alone = tokens.where("size(areas) < 2").withColumn("area", F.when(F.size("areas") == 0, "none").otherwise(F.col("areas")[0]))
    size = {r.area: r.n for r in alone.groupBy("area").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = [*areas, "none"]
    seen = alone.select("area", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("area") == a, 1)).alias(f"n_{a}") for a in kinds])
    rates = {a: F.col(f"n_{a}") / F.lit(float(max(1, size.get(a, 0)))) for a in kinds}
    total = sum(rates.values(), F.lit(0.0))
    shares = seen.select("word", "n", *[(rates[a] / total).alias(a) for a in kinds])
    most = F.greatest(F.lit(0.0), *areas)
    sure = most - 1.2 / F.sqrt(F.col("n"))
    return shares.where((sure > 0.25) & (most > 3 * F.col("none"))).drop("none").orderBy("word").toPandas()


def teaser_heads(sample: DataFrame, lexicon: pd.DataFrame, areas: list[str], least: int = 5) -> list[str]:
    """Two or three words before a colon that announce other pages, learned from the sample.

    In at least `least` labelled documents, the words behind the colon speak less for the
    labelled areas than for others. Letters with accents are written ¤.
    """
    speaks = {w: dict(zip(areas, s)) for w, s in zip(lexicon["word"], lexicon[areas].to_numpy())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[tuple[int, str], list[float]] = {}
            for k, (text, labelled) in enumerate(zip(pdf["_text"], pdf["areas"])):
                if not len(labelled):
                    continue
                for m in _BEFORE_COLON.finditer(repair(text)):
                    known = [speaks[w] for w in words(m[3]) if w in speaks]
                    if known:
                        own = sum(s[a] for s in known for a in labelled) / len(known)
                        for head in {m[2], (m[1] or "") + m[2]}:
                            out.setdefault((k, _FOREIGN.sub("¤", head.lower())), []).append(own)
            if out:
                yield pd.DataFrame({"head": [h for _, h in out], "own": [sum(v) / len(v) for v in out.values()]})

    heads = sample.mapInPandas(run, "head string, own double").groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.avg("own").alias("own"))
    # Bounded by the sample: each head stands in at least `least` of its documents.
    return sorted(r.head for r in heads.where((F.col("n") >= least) & (F.col("own") < 0.5)).collect())


def fit_topics(tokens: DataFrame, lexicon: pd.DataFrame, areas: list[str], limits: Limits = Limits(), seed: int = 0) -> pd.DataFrame:
    """Online LDA models over the sample, one for each area: a row for each topic, a column for each word, and `weight`.

    A model sees the documents labelled with one area. The Spark jobs of a few models run side by side.
    """
    vocabulary = lexicon["word"].tolist()
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "words", "features")
    alone = vectors.transform(tokens.where("size(areas) = 1")).select(F.col("areas")[0].alias("area"), "features").persist()

    def fit(area: str) -> pd.DataFrame:
        counts = alone.where(F.col("area") == area).select("features")
        if counts.isEmpty():
            return pd.DataFrame(columns=vocabulary + ["weight"])
        lda = LDA(k=limits.topics, maxIter=limits.iterations, seed=seed, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, learningDecay=0.6,
                  docConcentration=[0.1] * limits.topics, topicConcentration=0.02, optimizeDocConcentration=False)
        matrix = lda.fit(counts).topicsMatrix().toArray().T
        return pd.DataFrame(matrix / matrix.sum(axis=1, keepdims=True), columns=vocabulary).assign(weight=matrix.sum(axis=1) / matrix.sum())

    with ThreadPool(4) as pool:
        fitted = pool.map(inheritable_thread_target(tokens.sparkSession)(fit), areas)
    alone.unpersist()
    return pd.concat([f for f in fitted if len(f)], ignore_index=True) if any(len(f) for f in fitted) else fitted[0]


def topic_areas(topics: pd.DataFrame, lexicon: pd.DataFrame, areas: list[str], limits: Limits = Limits()) -> list[str | None]:
    """The area of each topic: that of at least `speaks` of its `top` terms, weighted by probability; None if there is none.

    It needn't be the area whose documents the topic comes from: wrong labels bring topics of other areas.
    """
    share = lexicon.set_index("word")[areas]
    out: list[str | None] = []
    for _, t in topics.drop(columns="weight").astype(float).iterrows():
        best = t.nlargest(limits.top)
        mix = share.loc[best.index].mul(best, axis=0).sum() / max(best.sum(), 1e-12)
        out.append(str(mix.idxmax()) if mix.max() >= limits.speaks else None)
    return out


@dataclass(frozen=True)
class Topics:
    """What a task needs to infer topic proportions: words, P(word | topic), the area of each topic (-1: background), and the certainty of words."""

    place: dict[str, int]
    beta: np.ndarray
    area: np.ndarray
    certainty: np.ndarray
    areas: list[str]

    @classmethod
    def of(cls, topics: pd.DataFrame, of_topic: list[str | None], lexicon: pd.DataFrame, areas: list[str]) -> Topics:
        """Without the markers, and with all topics of no area put together as one."""
        vocabulary = lexicon["word"].tolist()
        beta, weight = topics[vocabulary].to_numpy(), topics["weight"].to_numpy()
        kept = np.array([a is not None for a in of_topic])
        rest = np.where(kept, 0.0, weight) @ beta if not kept.all() else np.zeros(len(vocabulary))
        rows = np.vstack([beta[kept], rest + 1e-9])
        area = np.array([areas.index(a) for a in of_topic if a is not None] + [-1])
        rows = (rows / rows.sum(axis=1, keepdims=True)).T.astype(np.float32) + np.float32(1e-7)
        return cls({w: i for i, w in enumerate(vocabulary)}, rows, area, np.maximum(2 * lexicon[areas].max(axis=1).to_numpy(dtype=np.float32) - 1, 0), areas)

    def shares(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(proportion of each area, evidence) of documents given as places of words, none of them empty."""
        wide = len(self.place)
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.array([i for x in lists for i in x], dtype=np.int64)
        pair, counts = np.unique(rows * wide + flat, return_counts=True)
        rows, flat, counts = pair // wide, pair % wide, counts.astype(np.float32)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        b = self.beta[flat]
        theta = np.full((len(lists), b.shape[1]), 1.0 / b.shape[1], dtype=np.float32)
        for _ in range(8):
            r = theta[rows] * b
            r *= (counts / r.sum(axis=1))[:, None]
            theta = np.add.reduceat(r, starts, axis=0) + np.float32(0.002)
            theta /= theta.sum(axis=1, keepdims=True)
        of_area = np.stack([theta[:, self.area == a].sum(axis=1) for a in range(len(self.areas))], axis=1)
        return of_area, np.add.reduceat(self.certainty[flat] * counts, starts)

    def best_two(self, lists: list[list[str]], least: float) -> Iterator[tuple[int, list[tuple[str, float]]]]:
        """(position, two largest areas with their proportions) of the documents with enough evidence."""
        places = [[self.place[w] for w in ws if w in self.place] for ws in lists]
        live = [k for k, p in enumerate(places) if p]
        for low in range(0, len(live), 512):
            part = live[low : low + 512]
            share, evidence = self.shares([places[k] for k in part])
            order = np.argsort(-share, axis=1, kind="stable")[:, :2]
            for i, k in enumerate(part):
                if evidence[i] >= least:
                    yield k, [(self.areas[a], float(share[i, a])) for a in order[i]]


def learn_threshold(tokens: DataFrame, topics: Topics, limits: Limits = Limits()) -> float:
    """The proportion from which an area counts: where most labelled documents get exactly their labels; the middle of equally good ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            right = np.zeros(len(limits.thresholds), dtype=np.int64)
            labelled = [set(a) for a in pdf["areas"]]
            for k, best in topics.best_two(pdf["words"].tolist(), limits.least_words):
                for t, least in enumerate(limits.thresholds):
                    right[t] += {a for a, s in best if s >= least} == labelled[k]
            yield pd.DataFrame({"t": np.arange(len(right)), "n": right})

    right = {r.t: r.n for r in tokens.mapInPandas(run, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    most = max(right.values(), default=0)
    good = sorted(t for t, n in right.items() if n >= most * 0.998)
    return limits.thresholds[good[len(good) // 2]] if good else limits.thresholds[len(limits.thresholds) // 2]


def assign(documents: DataFrame, topics: Topics, threshold: float, teaser: re.Pattern | None = None, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(key, area, topic_share): the one or two areas of each document whose topic proportion reaches the threshold.

    The proportions are inferred with the topics held fixed (a few rounds of expectation and
    maximisation). Ties go to the area that comes first.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf[key].to_numpy()
            found = [(keys[k], a, s) for k, best in topics.best_two([own_text(t, teaser) for t in pdf["_text"]], limits.least_words) for a, s in best if s >= threshold]
            if found:
                yield pd.DataFrame(found, columns=[key, "area", "topic_share"])

    rows = documents.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, F.col(text).alias("_text"))
    return rows.mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, area string, topic_share double")


def subject_areas(documents: DataFrame, labels: DataFrame, areas: list[str], key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(key, area, topic_share): all steps over all `documents`; one or two rows for each document that has its own content.

    Documents with a null key, with null or empty text or without enough words that speak for an area have no
    row; so has every document if the labels teach no word at all (an empty or tiny sample).
    Equal documents get equal areas. Other columns are ignored.
    """
    ship(documents.sparkSession)
    nothing = documents.select(key).where(F.lit(False)).select(key, F.lit("").alias("area"), F.lit(0.0).alias("topic_share"))
    if not areas:
        return nothing
    sample = _sample(documents, clean_labels(labels, areas, key), key, text)
    lexicon = content_words(_tokens(sample, key, None), areas)
    if lexicon.empty:
        return nothing
    teaser = teaser_pattern(teaser_heads(sample, lexicon, areas))
    tokens = cut(_tokens(sample, key, teaser))
    lexicon = content_words(tokens, areas)
    fitted = fit_topics(tokens, lexicon, areas, limits)
    of_topic = topic_areas(fitted, lexicon, areas, limits)
    topics = Topics.of(fitted, of_topic, lexicon, areas)
    return assign(documents, topics, learn_threshold(tokens, topics, limits), teaser, key, text, limits)
